"""Technical indicators of all securities in one job.

Indicators with a finite window are window expressions over one (security, date) order: one shuffle, one
sort. The few with unbounded memory (exponential averages and KAMA) follow row by row in the
same order. Values are null until a window is full, except where a default is said.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import Shared, finite, history, ieee_div, lag, last, or_nan, rolling, running
from .calendar import shift_trading_days
from .pit import known


def sma(n: int, c: str = "close") -> Column:
    return rolling(F.avg, c, n)


#: Rows in a block: the longest windows take the extremes of whole blocks.
BLOCK = 21


def returns(s: Shared, n: int, c: str = "close") -> Column:
    return ieee_div(c, s.lag(c, n)) - 1


def slope(s: Shared, n: int, c: str) -> Column:
    """Least-squares slope over the last n rows; nulls count as 0."""
    return F.when(F.col("rn") >= n, s.last(F.regr_slope(F.coalesce(F.col(c), F.lit(0.0)), F.col("rn")), n))


def extreme(s: Shared, best: Callable[..., Column], block: str, count: str, n: int) -> Column:
    """The maximum or minimum of the last n rows, null until they hold n values, from that of the last BLOCK rows
    at each row and the count of values so far."""
    held = F.col(count) - F.coalesce(s.lag(count, n), F.lit(0))
    return F.when(held == n, best(block, *[s.lag(block, k) for k in range(BLOCK, n, BLOCK)]))


def _base(bars: DataFrame) -> DataFrame:
    """The columns that windows need: previous close, change, true range, typical price and so on."""
    rows = {"pc": lag("close"), "rn": F.row_number().over(history()).cast("double"), "ph": lag("high"), "pl": lag("low"), "v": F.col("volume").cast("double")}
    blocks = {"high_block": F.max("high").over(last(BLOCK)), "low_block": F.min("low").over(last(BLOCK)), "n_high": running(F.count, "high"), "n_low": running(F.count, "low")}
    d = bars.withColumns(rows | blocks)
    change, up, down = F.col("close") - F.col("pc"), F.col("high") - F.col("ph"), F.col("pl") - F.col("low")
    clv = ieee_div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low"))
    return d.withColumns(
        {
            "change": change,
            "gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))),
            "loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))),
            "ret": ieee_div("close", "pc") - 1,
            "log_return": F.ln(F.when(F.col("pc") > 0, F.col("close") / F.col("pc"))),
            "true_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("pc")), F.abs(F.col("low") - F.col("pc"))),
            "tp": (F.col("high") + F.col("low") + F.col("close")) / 3,
            "mid": (F.col("high") + F.col("low")) / 2,
            "pos_dm": F.when((up > down) & (up > 0), up).when(up.isNotNull(), 0.0),
            "neg_dm": F.when((down > up) & (down > 0), down).when(down.isNotNull(), 0.0),
            "mfv": clv * F.col("v"),
            "bp": F.greatest(F.col("close") - F.coalesce(F.when(F.col("pc").isNotNull(), F.least("low", "pc")), F.lit(0.0)), F.lit(0.0)),
            "signed_v": F.when(change.isNull(), F.col("v")).when(change > 0, F.col("v")).when(change < 0, -F.col("v")).otherwise(0.0),
        }
    )


def _first(d: DataFrame) -> DataFrame:
    """Windows over bars and base columns."""
    s = Shared()
    rs = or_nan(ieee_div(s.rolling(F.avg, "gain", 14), s.rolling(F.avg, "loss", 14)), 100.0)
    rs = F.when(rs == float("inf"), 100.0).otherwise(rs)
    hh14, ll14 = s.rolling(F.max, "high", 14), s.rolling(F.min, "low", 14)
    high_252, low_252 = extreme(s, F.greatest, "high_block", "n_high", 252), extreme(s, F.least, "low_block", "n_low", 252)
    up = F.col("tp") > s.lag("tp")
    flow = F.col("tp") * F.col("v")
    parts = [F.when(s.last(F.sum("true_range"), n) != 0, s.last(F.sum("bp"), n) / s.last(F.sum("true_range"), n)).otherwise(0.5) * w for n, w in ((7, 4.0), (14, 2.0), (28, 1.0))]
    since = lambda c, agg: F.when(F.col("rn") >= 25, 100.0 * (25 - (25 - F.array_position(s.last(F.collect_list(c), 25), s.last(agg(c), 25)))) / 25)
    centred = lambda agg: s.over(agg, history().rowsBetween(-5, 5), "centred")
    pivot = lambda c, agg: F.when((centred(F.count(c)) == 11) & (F.col(c) == centred(agg(F.col(c)))), F.col(c))
    ahead = s.over(F.collect_list(F.struct("low", "high")), history().rowsBetween(1, 5), "ahead")
    top, bottom = F.greatest("open", "pc"), F.least("open", "pc")
    cols = {f"sma_{n}": s.rolling(F.avg, "close", n) for n in (20, 50, 200)} | {f"return_{n}": returns(s, n) for n in (1, 5, 21, 63, 126, 252)}
    cols |= {
        "rsi_14": 100 - 100 / (1 + rs),
        "rolling_std_20": s.rolling(F.stddev_samp, "close", 20),
        "atr_14": s.rolling(F.avg, "true_range", 14),
        "atr_10": s.rolling(F.avg, "true_range", 10),
        "obv": s.running(F.sum, "signed_v"),
        "flow_sum": s.running(F.sum, flow),
        "v_sum": s.running(F.sum, "v"),
        "vwap": ieee_div(s.running(F.sum, flow), s.running(F.sum, "v")),
        "realized_vol_21": s.rolling(F.stddev_samp, "log_return", 21) * math.sqrt(252),
        "realized_vol_63": s.rolling(F.stddev_samp, "log_return", 63) * math.sqrt(252),
        "rvol": ieee_div("v", s.rolling(F.avg, "v", 20)),
        "v_mean": s.rolling(F.avg, "v", 20),
        "v_std": F.coalesce(s.rolling(F.stddev_samp, "v", 20), F.lit(1.0)),
        "dollar_volume": F.col("close") * F.col("v"),
        "pct_off_52w_high": ieee_div("close", high_252) - 1,
        "pct_off_52w_low": ieee_div("close", low_252) - 1,
        "is_new_52w_high": F.col("high") >= high_252,
        "is_new_52w_low": F.col("low") <= low_252,
        "gap_pct": ieee_div("open", "pc") - 1,
        "di_plus_14": ieee_div(100.0 * s.rolling(F.avg, "pos_dm", 14), s.rolling(F.avg, "true_range", 14)),
        "di_minus_14": ieee_div(100.0 * s.rolling(F.avg, "neg_dm", 14), s.rolling(F.avg, "true_range", 14)),
        "aroon_up_25": since("high", F.max),
        "aroon_down_25": since("low", F.min),
        "chop_14": 100.0 * F.log10(or_nan(ieee_div(s.rolling(F.avg, "true_range", 14) * 14, hh14 - ll14), 1.0)) / math.log10(14),
        "roc_12": returns(s, 12) * 100,
        "stoch_k_14": or_nan(ieee_div(100.0 * (F.col("close") - ll14), hh14 - ll14), 50.0),
        "williams_r_14": ieee_div(-100.0 * (hh14 - F.col("close")), hh14 - ll14),
        "tp_mean": s.rolling(F.avg, "tp", 20),
        "ultimate_osc": 100.0 * (parts[0] + parts[1] + parts[2]) / 7.0,
        "cmo_14": ieee_div(100.0 * (s.rolling(F.sum, "gain", 14) - s.rolling(F.sum, "loss", 14)), s.rolling(F.sum, "gain", 14) + s.rolling(F.sum, "loss", 14)),
        "bop": ieee_div(F.col("close") - F.col("open"), F.col("high") - F.col("low")),
        "ad_line": s.running(F.sum, "mfv"),
        "cmf_20": ieee_div(s.rolling(F.sum, "mfv", 20), s.rolling(F.sum, "v", 20)),
        "pos_flow": F.when(up, flow).when(~up, 0.0),
        "neg_flow": F.when(~up, flow).when(up, 0.0),
        "vpt": s.running(F.sum, F.col("ret") * F.col("v")),
        "raw_force": F.col("change") * F.col("v"),
        "raw_eom": ieee_div(F.col("mid") - s.lag("mid"), F.col("v") / 10000.0),
        "donchian_upper": s.rolling(F.max, "high", 20),
        "donchian_lower": s.rolling(F.min, "low", 20),
        "range_expansion": ieee_div("true_range", s.rolling(F.avg, "true_range", 14)),
        "wma_20": sum((s.lag("close", k) if k else F.col("close")) * float(20 - k) for k in range(20)) / 210.0,
        "linreg_slope_20": slope(s, 20, "close"),
        "linreg_se": F.when(s.last(F.count("close"), 20) == 20, F.sqrt(F.greatest(s.last(F.regr_syy("close", "rn"), 20) - F.pow(s.last(F.regr_sxy("close", "rn"), 20), 2) / s.last(F.regr_sxx("close", "rn"), 20), F.lit(0.0)) / 18)),
        "pivot_high": pivot("high", F.max),
        "pivot_low": pivot("low", F.min),
        "inside_bar": (F.col("high") <= F.col("ph")) & (F.col("low") >= F.col("pl")),
        "outside_bar": (F.col("high") > F.col("ph")) & (F.col("low") < F.col("pl")),
        "gap_fill": F.when(F.col("pc").isNotNull(), F.coalesce(F.exists(ahead, lambda b: (b.low <= top) & (b.high >= bottom)), F.lit(False))),
    }
    return s.add(d, cols)


def _second(d: DataFrame) -> DataFrame:
    """Windows over windows."""
    s = Shared()
    bw = ieee_div(4.0 * F.col("rolling_std_20"), "sma_20")
    rsi_ll, rsi_hh = s.rolling(F.min, "rsi_14", 14), s.rolling(F.max, "rsi_14", 14)
    neg = or_nan(s.rolling(F.sum, "neg_flow", 14), 1.0)
    six = lambda agg: s.last(agg, 6)
    place = lambda c, agg: F.array_position(six(F.collect_list(c)), six(agg(c)))
    rise = (place("close", F.min) > place("rsi_14", F.min)) & (six(F.min("rsi_14")) > six(F.min("close")))
    fall = (place("close", F.max) > place("rsi_14", F.max)) & (six(F.max("rsi_14")) < six(F.max("close")))
    stack = F.when((F.col("sma_20") > F.col("sma_50")) & (F.col("sma_50") > F.col("sma_200")), 1.0).when((F.col("sma_20") < F.col("sma_50")) & (F.col("sma_50") < F.col("sma_200")), -1.0).otherwise(0.0)
    dx = or_nan(ieee_div(100.0 * F.abs(F.col("di_plus_14") - F.col("di_minus_14")), F.col("di_plus_14") + F.col("di_minus_14")), 0.0)
    spike = (F.col("rvol") > 2.5) | (F.col("v") > F.col("v_mean") + 2.5 * F.col("v_std"))
    cols = {f"dist_to_ma_{n}": ieee_div("close", f"sma_{n}") - 1 for n in (20, 50, 200)} | {f"above_ma_{n}": F.col("close") > F.col(f"sma_{n}") for n in (20, 50, 200)} | {f"ma_slope_{n}": (F.col(f"sma_{n}") - s.lag(f"sma_{n}", 5)) / 5 for n in (20, 50, 200)}
    cols |= {
        "bb_middle": F.col("sma_20"),
        "bb_upper": F.col("sma_20") + 2 * F.col("rolling_std_20"),
        "bb_lower": F.col("sma_20") - 2 * F.col("rolling_std_20"),
        "bandwidth": bw,
        "percent_b": ieee_div(F.col("close") - (F.col("sma_20") - 2 * F.col("rolling_std_20")), 4 * F.col("rolling_std_20")),
        "atr_pct": ieee_div("atr_14", "close") * 100,
        "avg_dollar_volume_20": s.rolling(F.avg, "dollar_volume", 20),
        "aroon_osc_25": F.col("aroon_up_25") - F.col("aroon_down_25"),
        "stoch_d_3": s.rolling(F.avg, "stoch_k_14", 3),
        "stoch_rsi_14": or_nan(ieee_div(F.col("rsi_14") - rsi_ll, rsi_hh - rsi_ll), 0.5),
        "abs_dev": F.abs(F.col("tp") - F.col("tp_mean")),
        "mfi_14": 100 - ieee_div(F.lit(100.0), 1 + ieee_div(s.rolling(F.sum, "pos_flow", 14), neg)),
        "obv_slope_20": slope(s, 20, "obv"),
        "volume_spike": spike,
        "donchian_middle": (F.col("donchian_upper") + F.col("donchian_lower")) / 2,
        "linreg_channel_middle": F.when(s.last(F.count("close"), 20) == 20, F.col("sma_20")),
        "linreg_channel_upper": F.col("sma_20") + 2 * F.col("linreg_se"),
        "linreg_channel_lower": F.col("sma_20") - 2 * F.col("linreg_se"),
        "ma_stack": F.when(F.col("sma_200").isNotNull(), stack),
        "rsi_divergence": F.when(F.col("rn") > 10, F.when(rise, 1.0).when(fall, -1.0).otherwise(0.0)),
        "dx": dx,
    }
    d, s = s.add(d, cols), Shared()
    return s.add(d, {"bb_squeeze": F.col("bandwidth") <= s.rolling(F.min, "bandwidth", 126), "cci_20": ieee_div(F.col("tp") - F.col("tp_mean"), 0.015 * F.coalesce(s.rolling(F.avg, "abs_dev", 20), F.lit(1.0)))})


def _against(d: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Beta, alpha, relative strength and correlation against a benchmark's daily returns (0 on a date that
    it lacks). benchmark: effective_date and close of one security, broadcast: one row a day."""
    b = benchmark.select(F.lit("b").alias("security_id"), "effective_date", F.col("close"))
    b = b.withColumn("bench", ieee_div("close", lag("close")) - 1).select("effective_date", "bench")
    d = d.join(F.broadcast(b), "effective_date", "left").withColumn("bench", F.coalesce("bench", F.lit(0.0)))
    s = Shared()

    def beta(n: int) -> Column:
        var = s.before(F.var_pop("bench"), n)
        return F.when(s.before(F.count("ret"), n) == n, F.when(var == 0, 0.0).otherwise(F.try_divide(s.before(F.covar_pop("ret", "bench"), n), var)))

    spread = s.before(F.stddev_pop("ret"), 60) * s.before(F.stddev_pop("bench"), 60)
    cols = {f"beta_{n}d": beta(n) for n in (20, 60)} | {f"rs_spy_{n}d": ieee_div(1 + s.rolling(F.sum, "ret", n), 1 + s.rolling(F.sum, "bench", n)) - 1 for n in (20, 60)}
    cols["corr_spy"] = F.when(s.before(F.count("ret"), 60) == 60, F.try_divide(s.before(F.covar_pop("ret", "bench"), 60), spread))
    return s.add(d, cols).withColumn("alpha", F.col("ret") - F.col("beta_20d") * F.col("bench"))


#: Indicators that depend on all earlier rows, in the order of ``recursive_columns``.
RECURSIVE = ("ema_12", "ema_26", "macd", "macd_ema", "macd_histogram", "ppo", "ppo_signal", "ppo_histogram", "trix_15", "tsi_25_13", "adx_14", "chaikin_osc", "force_index_13", "eom_14", "keltner_upper", "keltner_middle", "keltner_lower", "kama_10")


def _ema(x: np.ndarray, n: int, held: float | None = None) -> np.ndarray:
    """From the first value on, or on from the value that an earlier run ended with; a value that isn't a
    number after that spoils all that follow."""
    a, b = 2 / (n + 1), 1 - 2 / (n + 1)
    step = lambda y, v: y if y == v else b * y + a * v
    if held is not None:
        return np.array(list(accumulate(x.tolist(), step, initial=held))[1:], float)
    out, some = np.full(len(x), np.nan), np.flatnonzero(x == x)
    if len(some):
        out[some[0] :] = list(accumulate(x[some[0] :].tolist(), step))
    return out


def _kama(s: np.ndarray, held: float | None = None, n: int = 10, fast: float = 2 / 3, slow: float = 2 / 31) -> np.ndarray:
    """From the row n on; ``held`` is the value of the row before that, if an earlier run made one."""
    out = np.full(len(s), np.nan)
    if len(s) <= n:
        return out
    change, path = np.abs(s[n:] - s[:-n]), np.lib.stride_tricks.sliding_window_view(np.abs(np.diff(s)), n).sum(1)
    ratio = np.divide(change, path, out=np.zeros_like(path), where=(path != 0) & (change != 0))
    prev, values = s[0] if held is None else held, []
    for sc, old, now in zip(((ratio * (fast - slow) + slow) ** 2).tolist(), s[:-n].tolist(), s[n:].tolist(), strict=True):
        prev = old if prev != prev else prev
        prev += sc * (now - prev)
        values.append(prev)
    out[n:] = values
    return out


def recursive_columns(p: dict[str, np.ndarray], held: dict[str, float], before: np.ndarray) -> list[np.ndarray]:
    """The columns of RECURSIVE for one security's history in date order, or for what follows a history of which
    ``before`` are the last ten closes and ``held`` is what it left. ``held`` then has what this one leaves."""
    c = p["close"]

    def ema(name: str, x: np.ndarray, n: int) -> np.ndarray:
        out = _ema(x, n, held.get(name))
        if name in held or (x == x).any():
            held[name] = float(out[-1])
        return out

    with np.errstate(all="ignore"):
        e12, e26 = ema("e12", c, 12), ema("e26", c, 26)
        macd = e12 - e26
        signal = ema("signal", macd, 9)
        ppo = macd / e26 * 100
        ppo_signal = ema("ppo_signal", ppo, 9)
        last_triple = held.get("t3", np.nan)
        triple = ema("t3", ema("t2", ema("t1", c, 15), 15), 15)
        diff, earlier = np.diff(c, prepend=before[-1:] if len(before) else np.nan), np.append(last_triple, triple[:-1])
        smooth, size = ema("d13", ema("d25", diff, 25), 13), ema("a13", ema("a25", np.abs(diff), 25), 13)
        mid = ema("mid", c, 20)
        kama = _kama(np.concatenate([before, c]), held.get("kama"))
        if len(kama) > 10:
            held["kama"] = float(kama[-1])
        return [
            e12, e26, macd, signal, macd - signal, ppo, ppo_signal, ppo - ppo_signal,
            (triple / earlier - 1) * 100, 100 * smooth / size,
            ema("adx", p["dx"], 14), ema("ad3", p["ad_line"], 3) - ema("ad10", p["ad_line"], 10),
            ema("force", p["raw_force"], 13), ema("eom", p["raw_eom"], 14),
            mid + 2 * p["atr_10"], mid, mid - 2 * p["atr_10"], kama[len(before) :],
        ]


_SCRATCH = ("pc", "rn", "ph", "pl", "v", "change", "gain", "loss", "ret", "tp", "mid", "pos_dm", "neg_dm", "mfv", "bp", "signed_v", "atr_10", "v_mean", "v_std", "tp_mean", "pos_flow", "neg_flow", "raw_force", "raw_eom", "linreg_se", "abs_dev", "dx", "bench", "flow_sum", "v_sum", "high_block", "low_block", "n_high", "n_low")


def finite_indicators(bars: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Bars with every finite-window indicator and the scratch columns of the recursive ones."""
    d = _base(bars)
    d = _against(d, benchmark) if benchmark is not None else d
    return _second(_first(d))


PRICES = ("open", "high", "low", "close", "volume")


#: What the recursive columns read of a row.
SOURCES = ("close", "dx", "ad_line", "raw_force", "raw_eom", "atr_10")
LEFT = "map<string,double>"


def _carry_on(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """The columns of RECURSIVE for rows that come in order, one security's after another's: starts (on a
    security's first row), SOURCES, and where earlier runs left something, fresh and left. What a security has left so far goes on with its rows into the
    next batch. Rows that aren't fresh only set it; the last fresh row of a batch has what is left then."""
    held, before = {}, np.zeros(0)
    for first, *cells in batches:
        starts = first.to_numpy(zero_copy_only=False)
        p = {c: np.asarray(x.to_numpy(zero_copy_only=False), float) for c, x in zip(SOURCES, cells, strict=False)}
        fresh, left = cells[len(SOURCES) :] or (None, None)
        new = np.ones(len(starts), bool) if fresh is None else fresh.to_numpy(zero_copy_only=False)
        out, leaves = np.full((len(RECURSIVE), len(starts)), np.nan), [None] * len(starts)
        cuts = np.flatnonzero(starts[1:] | (new[1:] != new[:-1])) + 1
        for lo, hi in pairwise([0, *cuts.tolist(), len(starts)]):
            if lo == hi:
                continue
            if starts[lo]:
                held, before = {}, np.zeros(0)
            if new[lo]:
                out[:, lo:hi] = recursive_columns({c: x[lo:hi] for c, x in p.items()}, held, before)
                leaves[hi - 1] = list(held.items())
            elif left[hi - 1].is_valid:
                held = dict(left[hi - 1].as_py())
            before = np.concatenate([before, p["close"][lo:hi]])[-10:]
        columns = [pa.array(x) for x in out]
        if fresh is None:
            yield pa.StructArray.from_arrays(columns, list(RECURSIVE))
        else:
            yield pa.StructArray.from_arrays([*columns, pa.array(leaves, pa.map_(pa.string(), pa.float64()))], [*RECURSIVE, "left"])


def with_recursive(d: DataFrame, *left: str, starts: Column | None = None) -> DataFrame:
    """The columns of RECURSIVE beside what ``finite_indicators`` gave, whose rows lie in the order of their
    securities and dates: so they go through Python where they are, and are neither shuffled nor joined. left: the
    columns fresh and left of an earlier run; then there is a column ``leaves`` too. starts: true on a security's
    first row, if that isn't its row 1."""
    kind = ",".join(f"{c}:double" for c in RECURSIVE) + (f",left:{LEFT}" if left else "")

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return _carry_on(batches)

    # from row to row: not deterministic for Spark, which so keeps the order and moves no filter below it
    step = F.arrow_udf(run, f"struct<{kind}>").asNondeterministic()
    made = d.sortWithinPartitions("security_id", "effective_date").withColumn("__r", step(F.col("rn") == 1 if starts is None else starts, *SOURCES, *left))
    extra = [F.col("__r")["left"].alias("leaves")] if left else []
    return made.select(*d.columns, *[F.col("__r")[c].alias(c) for c in RECURSIVE], *extra)


def compute_all(bars: DataFrame, as_of, benchmark: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One wide row for each (security, date) of the bars known at ``as_of``, as a derived fact, with the
    ``carry`` columns of PRICES. Only what the recursive columns read goes through Python."""
    b = known(bars, as_of).select("security_id", "effective_date", *PRICES)
    return as_facts(with_recursive(finite_indicators(b, benchmark)), as_of, carry)


def as_facts(d: DataFrame, as_of, carry: tuple[str, ...] = ()) -> DataFrame:
    """Derived facts of finite and recursive columns; a missing number is null, never NaN."""
    keys = ["security_id", "effective_date"]
    keep = [f for f in d.schema.fields if f.name in carry or f.name not in (*keys, *_SCRATCH, *PRICES)]
    values = [finite(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in keep]
    return d.select(*keys, F.lit(as_of).cast("timestamp").alias("available_at"), F.lit("derived").alias("source_id"), *values)


#: Units of the indicators, by the start of their names; the others are ratios or indices of their own.
UNITS = {
    "price": ("sma_", "ema_", "macd", "bb_", "atr_14", "rolling_std_", "vwap", "donchian_", "wma_", "linreg_", "keltner_", "kama_", "pivot_", "true_range", "ma_slope_"),
    "percent": ("atr_pct", "roc_", "ppo", "trix_", "percentile_"),
    "ratio": ("return_", "dist_to_ma_", "pct_off_", "gap_pct", "bandwidth", "percent_b", "rs_spy_", "log_return", "alpha", "beta_", "corr_", "realized_vol_", "rvol", "range_expansion"),
    "oscillator_100": ("rsi_", "stoch_k", "stoch_d", "williams_", "aroon_", "mfi_", "ultimate_", "chop_", "di_", "adx_", "cmo_", "tsi_"),
    "flag": ("above_ma_", "is_new_", "inside_bar", "outside_bar", "gap_fill", "volume_spike", "bb_squeeze", "ma_stack", "rsi_divergence"),
    "volume": ("obv", "ad_line", "vpt", "chaikin_", "force_index_", "eom_"),
    "currency": ("dollar_volume", "avg_dollar_"),
}


def unit(name: str) -> str:
    """The unit of an indicator."""
    return next((u for u, starts in UNITS.items() if name.startswith(starts)), "index")


def coverage(computed: DataFrame) -> DataFrame:
    """The dimension of indicators with what there is of each: indicator, unit, n_values and n_securities.
    computed: as of ``compute_all``. One pass, a row for each security and one for all."""
    names = [c for c in computed.columns if c not in ("security_id", "effective_date", "available_at", "source_id", *PRICES)]
    per = computed.groupBy("security_id").agg(*[F.count(c).alias(c) for c in names])
    told = per.agg(*[F.struct(F.sum(c).alias("n"), F.count_if(F.col(c) > 0).alias("s")).alias(c) for c in names])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.lit(unit(c)).alias("unit"), F.col(c).n.alias("n_values"), F.col(c).s.alias("n_securities")) for c in names])).alias("r")
    return told.select(rows).select("r.indicator", "r.unit", F.coalesce("r.n_values", F.lit(0)).cast("long").alias("n_values"), F.col("r.n_securities").cast("long").alias("n_securities"))


#: Named indicators with their default arguments, for requests by name over columns of ``compute_all``.
NAMED = {"sma": ("sma_20", "sma_50", "sma_200"), "ema": ("ema_12", "ema_26"), "rsi": ("rsi_14",), "macd": ("macd", "macd_ema", "macd_histogram"), "bollinger": ("bb_upper", "bb_middle", "bb_lower"), "atr": ("atr_14",)}


def warmup_start(calendar: DataFrame, start, sessions: int):
    """The date ``sessions`` sessions before ``start``, or the calendar's first; calendar: exchange, session
    and ordinal, from which one row comes back."""
    day = calendar.select("exchange").distinct().withColumn("day", F.lit(start).cast("date"))
    shifted = shift_trading_days(day, calendar, -sessions).agg(F.min("shifted").alias("s"))
    return shifted.crossJoin(calendar.agg(F.min("session").alias("first"))).select(F.coalesce("s", "first")).first()[0]


def chosen(bars: DataFrame, as_of, names: list[str], start, warmup_sessions: int = 253, calendar: DataFrame | None = None, benchmark: DataFrame | None = None) -> DataFrame:
    """Chosen indicators from ``start`` on, computed with the sessions before it as warm-up; without a
    calendar those count as 400 days to 253 sessions."""
    first = F.date_sub(F.lit(start).cast("date"), round(warmup_sessions * 400 / 253)) if calendar is None else F.lit(warmup_start(calendar, start, warmup_sessions))
    cols = [c for n in names for c in NAMED.get(n, (n,))]
    return compute_all(bars.filter(F.col("effective_date") >= first), as_of, benchmark).filter(F.col("effective_date") >= F.lit(start).cast("date")).select("security_id", "effective_date", *cols)
