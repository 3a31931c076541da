"""Benchmark decontamination by a distributed positional inverted index.

Words are runs of ``WORD`` after A-Z are lower-cased. A test item gives windows of ``WINDOW`` consecutive
words; an item of fewer words, but not none, is one window. The corpus is cut into words once, and its
postings (row, position) are stored by term for the terms that the search starts from:

1. The corpus frequency of every test term is counted. A window with a term that the corpus lacks ends.
2. Each other window asks for its two rarest terms, the earlier of equal ones, with their distance; windows
   that overlap mostly ask for the same pair. Only lists of such terms are stored: no other list is read.
3. The two lists of a pair are intersected after the later one is shifted by the distance. What both hold
   is a place where the windows of that pair may stand.
4. There the words of the document are compared with the window's (128 bits of them), so a match is exact.

``near_matches`` answers proximity from the same lists: all of an item's rarest terms within some words.

Only built-in functions run. Lists are split by row, not gathered by term: a term that a third of all
words are stays spread over the tasks that hold its documents. Tables of the test items are broadcast
while they fit (``small``), and shuffled beyond that.

Null texts have no words. Rows that repeat a doc_id, or have none, are documents of their own. An item
without words takes no part; items with one item_id are one item, and a null item_id is written as an
empty string. Repeated windows are searched once. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, fits, halves, settle, small

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
RAREST = 3  # terms of an item that a proximity match needs
WITHIN = 20  # words that they must lie in


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A settled table of row (a number of its own for each), doc_id, words and n_words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("words"))
    return settle(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "words", F.size("words").cast("long").alias("n_words")), "leak-words")


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (its id as text) and words of the items that have some."""
    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col).cast("string")).alias("words"))
    return settle(named.filter(F.size("words") > 0), "leak-items")


def windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(distinct windows as w, words and n; which items have them as w, item), both settled."""
    last = F.greatest(F.size("words") - size, F.lit(0))
    every = items.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda at: F.slice("words", at + 1, size))).alias("words"))
    every = settle(every.select("item", halves(F.col("words")).alias("w"), "words").dropDuplicates(["item", "w"]), "leak-windows")
    unique = every.dropDuplicates(["w"]).select("w", "words", F.size("words").alias("n"))
    return settle(unique, "leak-distinct"), every.select("w", "item")


def frequencies(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, count) of the settled, distinct ``terms`` that the corpus has."""
    found = tokens.select(F.explode("words").alias("term"))
    if fits(terms):
        return found.join(F.broadcast(terms), "term").groupBy("term").count()
    return found.groupBy("term").count().join(terms, "term")


def postings(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional lists of some terms, as a settled table of term, row and pos."""
    places = tokens.select("row", F.posexplode("words").alias("pos", "term"))
    return settle(places.join(small(terms), "term", "left_semi").select("term", "row", "pos"), "leak-postings")


def _rarest(phrases: DataFrame, key: str, counts: DataFrame, most: int) -> DataFrame:
    """(key, term, at, place) of the ``most`` rarest positions of each phrase (key, words) whose terms the
    corpus has all of; place 1 is the rarest, then by term and position."""
    spread = phrases.select(key, F.size("words").alias("__n"), F.posexplode("words").alias("at", "term")).join(small(counts), "term")
    own = Window.partitionBy(key)
    ranked = spread.withColumn("__known", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("count", "term", "at")))
    return ranked.filter((F.col("__known") == F.col("__n")) & (F.col("place") <= most)).select(key, "term", "at", "place")


def _pairs(found: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists to intersect as pair, term, shift and need; windows of each pair as pair, w, n, at): at is
    where in the window the pair's first term stands. A window of one word asks for one list."""
    asked = _rarest(found, "w", counts, 2).groupBy("w").agg(F.sort_array(F.collect_list(F.struct("at", "term"))).alias("two"))
    first, second = F.col("two")[0], F.try_element_at("two", F.lit(2))
    asked = asked.select("w", first.at.alias("at"), first.term.alias("a"), second.term.alias("b"), (second.at - first.at).alias("shift"))
    asked = asked.withColumn("pair", F.xxhash64("a", F.coalesce("b", F.lit("")), F.coalesce("shift", F.lit(0))))
    asked = settle(asked.join(found.select("w", "n"), "w"), "leak-asked")
    one = asked.dropDuplicates(["pair"])
    need = F.when(F.col("b").isNull(), 1).otherwise(2).alias("need")
    lists = one.select("pair", F.col("a").alias("term"), F.lit(0).alias("shift"), need).unionByName(one.filter("b IS NOT NULL").select("pair", F.col("b").alias("term"), "shift", need))
    return settle(lists, "leak-lists"), asked.select("pair", "w", "n", "at")


def phrase_matches(tokens: DataFrame, found: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, start, n, w) of every occurrence of a window, a settled table. found: w, words and n of
    distinct windows; counts: of all their terms."""
    lists, places = _pairs(found, counts)
    held = postings(tokens, lists.select("term").distinct())
    shifted = held.join(small(lists), "term").select("row", "pair", (F.col("pos") - F.col("shift")).alias("pos"), "need")
    both = shifted.groupBy("row", "pair", "pos").agg(F.count("*").alias("lists"), F.first("need").alias("need")).filter("lists = need")
    maybe = both.join(small(places), "pair").select("row", (F.col("pos") - F.col("at")).alias("start"), "n", "w").filter("start >= 0")
    maybe = settle(maybe, "leak-candidates")
    per_row = maybe.groupBy("row").agg(F.collect_list(F.struct("start", "n", "w")).alias("maybe"))
    # words move only for the rows that have a candidate
    rows = settle(maybe.select("row").distinct(), "leak-rows")
    texts = tokens.select("row", "words").join(small(rows), "row", "left_semi").join(per_row, "row")
    same = F.filter("maybe", lambda c: halves(F.slice("words", c.start + 1, c.n)) == c.w)
    return settle(texts.select("row", F.explode(same).alias("m")).select("row", "m.start", "m.n", "m.w"), "leak-matches")


def near_matches(tokens: DataFrame, items: DataFrame, terms: int = RAREST, within: int = WITHIN) -> DataFrame:
    """Proximity: (row, item) where the item's ``terms`` rarest distinct terms (all of a shorter item's)
    stand in ``within`` consecutive words, in any order. An item with a term that the corpus lacks among all
    its terms has no match. tokens: as of ``tokenised``; items: as of ``item_words``."""
    phrases = settle(items.dropDuplicates(["item"]).select("item", F.array_distinct("words").alias("words")), "leak-phrases")
    counts = settle(frequencies(tokens, settle(phrases.select(F.explode("words").alias("term")).distinct(), "leak-terms")), "leak-counts")
    asked = settle(_rarest(phrases, "item", counts, terms).select("item", "term", F.expr("shiftleft(1, place - 1)").alias("bit")), "leak-near")
    full = asked.groupBy("item").agg(F.bit_or("bit").alias("full"))
    asked = settle(asked.join(full, "item"), "leak-full")
    held = postings(tokens, asked.select("term").distinct()).join(small(asked), "term")
    ahead = Window.partitionBy("row", "item").orderBy("pos").rangeBetween(0, within - 1)
    return held.withColumn("seen", F.bit_or("bit").over(ahead)).filter("seen = full").select("row", "item").distinct()


def decontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit (words inside an occurrence of a window), items (ids
    as text, in order, of the items with such windows)."""
    tokens = tokenised(docs, id_col, text_col)
    found, of_item = windows(item_words(items, item_id_col, item_text_col), size)
    terms = settle(found.select(F.explode("words").alias("term")).distinct(), "leak-terms")
    counts = settle(frequencies(tokens, terms), "leak-counts")
    matches = phrase_matches(tokens, found, counts)
    spans = matches.groupBy("row", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("until", F.coalesce(F.max("end").over(before), F.lit(0)))
    hit = spans.groupBy("row").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "until"), F.lit(0))).cast("long").alias("n_hit"))
    named = matches.select("row", "w").distinct().join(small(of_item), "w").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    told = settle(hit.join(named, "row"), "leak-told")
    out = tokens.select("row", "doc_id", "n_words").join(told, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The same with its items as a number and a digest: n_items, items_sha256 and contaminated."""
    got = decontaminated(docs, items, **how)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
