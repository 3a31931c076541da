"""The numbered queries: each applies one operator of this subpackage to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, collocations, decontaminate, exact_dedup, mixing, ngram_join, nn_descent, quality_crf, secret_scan, sentencepiece_codec, suffix_dedup, token_counts, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """Where the public SentencePiece model is; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def byte_ranks() -> tuple[str, str]:
    """Where the public byte-level vocabulary is, and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document and of each of its lines."""
    return token_counts.counted(table(spark, sf_dir, "documents"), *byte_ranks(), sections="lines", rule="most")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_report(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_crf.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality_crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality_crf.THRESHOLD).cast("int").alias("predicted"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(table(spark, sf_dir, "documents"), piece_model(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"), outputs=("kept_sha256",))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))[0]


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_secret_scan, op3_mixing, op4_token_counts, op5_exact_dedup, op6_url_filter, op7_embedding_near_dedup, op8_quality_classifier, op9_sentencepiece, op10_suffix_array_dedup, op11_centroid_clustering, op12_phrase_collocations, op13_benchmark_decontamination)}

def _lloyd_sql(turns: int = 3) -> str:
    """Lloyd's rounds written out, one after the other, over a row for each component."""
    parts = ["""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
        p AS MATERIALIZED (SELECT r, unnest(range(64)) AS j, unnest(v) AS x FROM kept),
        first AS (
            SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS k, v FROM kept
            QUALIFY k < 16),
        c0 AS MATERIALIZED (SELECT k, unnest(range(64)) AS j, unnest(v) AS x FROM first)"""]
    for t in range(turns + 1):
        parts.append(f"""
        d{t} AS (SELECT r, k, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM p JOIN c{t} c USING (j) GROUP BY r, k),
        a{t} AS MATERIALIZED (SELECT r, k, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if t < turns:
            parts.append(f"""
        m{t} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM p JOIN a{t} USING (r) GROUP BY k, j),
        c{t + 1} AS MATERIALIZED (SELECT k, j, CASE WHEN n IS NULL THEN x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x FROM c{t} LEFT JOIN m{t} USING (k, j))""")
    tail = f"""
        h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{turns} GROUP BY k)
        SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM kept JOIN a{turns} USING (r) JOIN h USING (k)
    """
    return ",".join(parts) + "," + tail


ORACLE_SQL = {
    "op11_centroid_clustering": _lloyd_sql(),
    "op3_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
            FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM s),
        w AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
                     2.0::DOUBLE * source_size AS cap FROM r),
        l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                     - coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                     / sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
        t AS (SELECT source, source_size, least(cap, w * max(lev) OVER ()) AS target FROM l),
        q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS reps FROM t),
        x AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.reps, q.target - q.reps * q.source_size AS rest,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                     sum(d.size) OVER (PARTITION BY d.source, h) AS mass
              FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * (reps + CASE WHEN upto <= rest OR (upto - mass < rest AND upto - rest < rest - (upto - mass)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM x
    """,
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_cp,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        k AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                     first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS keep_id FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
    """,
    "op12_phrase_collocations": r"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM d),
        n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
        g AS MATERIALIZED (
            SELECT lang, gram, count(*) AS f
            FROM (SELECT lang, words[k:k + size - 1] AS gram
                  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM w, range(1, 5) s(size) WHERE len(words) >= size))
            GROUP BY lang, gram),
        c AS MATERIALIZED (SELECT lang, gram, f AS a FROM g WHERE f >= 30 AND len(gram) > 1),
        p AS MATERIALIZED (SELECT lang || ' ' || array_to_string(gram, ' ') AS key, f FROM g WHERE f >= 30),
        cuts AS (
            SELECT lang, gram, a, k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
            FROM (SELECT *, lang || ' ' || array_to_string(gram[1:k], ' ') AS head, lang || ' ' || array_to_string(gram[k + 1:], ' ') AS tail
                  FROM (SELECT *, unnest(range(1, len(gram))) AS k FROM c))
            JOIN p x ON x.key = head JOIN p y ON y.key = tail),
        weak AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
        inner_ AS (
            SELECT DISTINCT lang, gram[k:k + size - 1] AS gram, a
            FROM (SELECT lang, gram, a, size, unnest(range(1, len(gram) - size + 2)) AS k FROM c, range(2, 4) s(size) WHERE size < len(gram))),
        free AS (SELECT * FROM weak WHERE NOT EXISTS (FROM inner_ i WHERE i.lang = weak.lang AND i.gram = weak.gram AND 100 * i.a >= 80 * weak.a)),
        told AS (SELECT *, array_to_string(gram, ' ') AS phrase FROM free)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM told JOIN n USING (lang) QUALIFY rank <= 2000
    """,
    "op13_benchmark_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents),
        i AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM benchmark),
        iw AS (
            SELECT DISTINCT item, least(len(words), 10) AS n, words[k:k + 9] AS w
            FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS k FROM i WHERE len(words) > 0)),
        dw AS (
            SELECT r, k, n, words[k:k + n - 1] AS w
            FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS k
                  FROM d, (SELECT DISTINCT n FROM iw) WHERE len(words) >= n)),
        m AS (SELECT r, k, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.w = iw.w),
        h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
        t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
    """,
}
