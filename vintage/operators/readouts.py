"""Readouts: indicator values of every security classified by threshold profiles."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite, history, ieee_div, lag, rolling
from .indicators import PRICES, RECURSIVE, finite_indicators, with_recursive
from .pit import known


@dataclass(frozen=True)
class Band:
    """A state and its inclusive limits; None is open."""

    state: str
    lo: float | None = None
    hi: float | None = None

    def holds(self, value: Column) -> Column:
        ok = F.lit(True)
        ok = ok if self.lo is None else ok & (value >= self.lo)
        return ok if self.hi is None else ok & (value <= self.hi)


@dataclass(frozen=True)
class Profile:
    method: str
    zones: tuple[Band, ...] = ()
    percentiles: tuple[Band, ...] = field(default=())


def load_profiles(text: str) -> dict[str, Profile]:
    """Profiles from TOML: [profile.<id>] with definition_id, method, zones and percentiles, each state with
    an operator (lte, gte, between) and its limits. States keep the file's order."""

    def bands(table: dict, one: str, lo: str, hi: str) -> tuple[Band, ...]:
        limits = {"lte": lambda d: (None, d.get(one, 0)), "gte": lambda d: (d.get(one, 0), None), "between": lambda d: (d.get(lo), d.get(hi))}
        return tuple(Band(state, *limits[d["operator"]](d)) for state, d in table.items())

    out = {}
    for raw in tomllib.loads(text).get("profile", {}).values():
        if raw["definition_id"] not in READOUTS:
            raise ValueError(f"no readout {raw['definition_id']!r}")
        out[raw["definition_id"]] = Profile(raw["method"], bands(raw.get("zones", {}), "value", "min", "max"), bands(raw.get("percentiles") or {}, "percentile", "min_percentile", "max_percentile"))
    return out


def _first_band(bands: tuple[Band, ...], value: Column) -> Column:
    out = F.lit(None).cast("string")
    for band in reversed(bands):
        out = F.when(band.holds(value), F.lit(band.state)).otherwise(out)
    return out


def resolve_state(profile: Profile, value: Column, history_rows: Column | None = None, below: Column | None = None, lookback: int = 0) -> Column:
    """The state of a value: null gives unavailable, as does a history shorter than the look-back.
    ``below`` is the share of the history under the value. Percentile bands come first; ``combined`` then
    prefers the zone. A value in a gap between bands is unavailable."""
    zone = _first_band(profile.zones, value)
    state = zone if profile.method in ("discrete", "combined") else F.lit(None).cast("string")
    if profile.method in ("percentile", "combined") and profile.percentiles and below is not None:
        by_rank = F.when(below.isNotNull(), _first_band(profile.percentiles, below))
        state = F.coalesce(F.when(by_rank.isNotNull(), zone), by_rank, zone) if profile.method == "combined" else by_rank
    short = F.lit(False) if history_rows is None else history_rows < lookback
    return F.when(value.isNull() | short, "unavailable").otherwise(F.coalesce(state, F.lit("unavailable")))


@dataclass(frozen=True)
class Readout:
    """lookback: rows needed. places: of the shown value. ranked: the history that percentiles rank in.
    up/attention/risk: see ``compute``. good, bad, amber: states by color."""

    lookback: int
    places: int
    good: str
    bad: tuple[str, ...] = ()
    amber: tuple[str, ...] = ()
    ranked: str | None = None
    orientation: str = "none"
    attention: tuple[str, ...] = ()
    risk: tuple[str, ...] = ()
    needs: str = "bars"


_HOT = ("elevated", "extreme")
#: The eighteen readouts.
READOUTS = {
    "price_action.daily_move": Readout(2, 6, "up", ("down",), orientation="sign"),
    "price_action.intraday_volatility": Readout(2, 6, "low", ("extreme",), ("elevated",), "h_range", attention=_HOT, risk=_HOT),
    "price_action.gap": Readout(2, 6, "gap_up", ("gap_down",), orientation="sign"),
    "trend.regime": Readout(15, 2, "trending", needs="indicators"),
    "trend.directional_bias": Readout(15, 2, "upward", ("downward",), orientation="state", needs="indicators"),
    "trend.strength": Readout(15, 2, "strong", ("weak",), ranked="h_move", needs="indicators"),
    "momentum.rsi_14": Readout(15, 2, "oversold", ("overbought",), orientation="fifty", needs="indicators"),
    "momentum.macd_cross": Readout(27, 4, "positive_cross", ("negative_cross",), orientation="state", needs="indicators"),
    "momentum.quality": Readout(22, 6, "constructive", ("weak",), orientation="both"),
    "volatility.atr_percent": Readout(253, 4, "low", ("extreme",), ("elevated",), "h_atr", attention=_HOT, risk=_HOT, needs="indicators"),
    "volatility.bollinger_width": Readout(127, 4, "expanding", ("blown",), ("squeeze",), "h_width", attention=("expanding", "blown"), risk=("expanding", "blown"), needs="indicators"),
    "volatility.regime": Readout(64, 4, "low", ("extreme",), ("elevated",), "h_vol", attention=_HOT, risk=_HOT),
    "participation.rvol": Readout(22, 4, "quiet", ("extreme",), ("elevated",), "h_rvol", attention=_HOT, risk=("extreme",), needs="indicators"),
    "participation.volume_trend": Readout(6, 4, "surging", ("declining",), orientation="sign", attention=("surging",)),
    "relative_strength.vs_benchmark": Readout(22, 6, "leading", ("weak",), orientation="sign", needs="benchmark"),
    "relative_strength.regime": Readout(22, 6, "improving", ("deteriorating",), orientation="sign", needs="benchmark"),
    "market_regime.breakout_state": Readout(21, 4, "breaking_out", ("reversing",), orientation="breakout", attention=("breaking_out", "reversing"), needs="indicators"),
    "market_regime.keltner_touch": Readout(21, 4, "inside", ("break",), ("touch",), orientation="sign", attention=("touch", "break"), risk=("break",), needs="indicators"),
}
#: The indicators that readouts read.
INPUTS = ("adx_14", "di_plus_14", "di_minus_14", "rsi_14", "macd", "macd_ema", "atr_pct", "bandwidth", "rvol", "realized_vol_21", "realized_vol_63", "keltner_upper", "keltner_middle", "keltner_lower")
GRAY = ("unavailable", "normal", "neutral", "mixed", "flat", "no_gap", "no_cross", "range", "inside", "in_line", "stable")


def max_lookback() -> int:
    return max(r.lookback for r in READOUTS.values())


def _color(r: Readout, state: Column) -> Column:
    return F.when(state == r.good, "green").when(state.isin(*GRAY), "gray").when(state.isin(*r.bad), "red").when(state.isin(*r.amber), "amber").otherwise("gray")


def _inputs(bars: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(bars with the finite indicators of INPUTS, the newest recursive ones of each security)."""
    late = [c for c in INPUTS if c in RECURSIVE]
    d = finite_indicators(known(bars, as_of).select("security_id", "effective_date", *PRICES))
    # all prices are named, so that both branches read one shuffle of the bars
    newest = with_recursive(d).groupBy("security_id").agg(F.max_by(F.struct(*late, *PRICES), "effective_date").alias("r"))
    wide = d.select("security_id", "effective_date", *PRICES, *[finite(c).alias(c) for c in INPUTS if c not in late])
    return wide, newest.select("security_id", *[finite(F.col("r")[c]).alias(c) for c in late])


def compute(bars: DataFrame, as_of, profiles: dict[str, Profile], benchmark: DataFrame | None = None, stored: DataFrame | None = None, computed: DataFrame | None = None, places: int | None = None) -> DataFrame:
    """All readouts of all securities in long form: security_id, definition_id, value, state, orientation,
    attention, risk, color. bars: one per cell. stored: indicator rows that are preferred to recomputed
    ones. computed: what ``compute_all`` made of these bars, with their prices, where that exists already.
    Readouts that need a benchmark are left out without one. places: of the values, instead of each
    readout's own.

    One pass: what a row needs comes from windows over its security, and the newest row and the shares of
    the history under its values from one aggregation a security. Of the recursive indicators only the newest
    values are read, so those are made beside it and joined as one row a security: rows of the history stay where
    their windows have them."""
    names = INPUTS
    d, newest = _inputs(bars, as_of) if computed is None else (computed.select("security_id", "effective_date", *PRICES, *names), None)
    d = d.withColumns({"n": F.row_number().over(history()), "pc": lag("close"), "v": F.col("volume").cast("double")})
    if benchmark is not None:
        m = known(benchmark, as_of).select(F.lit("b").alias("security_id"), "effective_date", "close")
        m = m.withColumns({"m1": ieee_div("close", lag("close")) - 1, "m21": ieee_div("close", lag("close", 21)) - 1}).select("effective_date", "m1", "m21")
        d = d.join(F.broadcast(m), "effective_date", "left")  # one row a day
    d = d.withColumns({"r1": ieee_div("close", "pc") - 1, "h_range": finite(ieee_div(F.col("high") - F.col("low"), "close")), "h_vol": finite(ieee_div("realized_vol_21", "realized_vol_63")), "step": F.abs(F.col("close") - F.col("pc"))})
    d = d.withColumns({"h_move": rolling(F.avg, "step", 14), "h_atr": F.col("atr_pct"), "h_width": F.col("bandwidth"), "h_rvol": F.col("rvol")})
    if benchmark is not None:
        d = d.withColumn("rs21", finite(ieee_div(1 + rolling(F.sum, "r1", 21), 1 + rolling(F.sum, "m1", 21)) - 1))
    five = history().rowsBetween(-4, 0)
    # the least-squares slope over five equally spaced rows
    slope = lambda c: F.when(F.count(c).over(five) == 5, (2 * F.col(c) + lag(c, 1) - lag(c, 3) - 2 * lag(c, 4)) / 10)
    hi, lo = rolling(F.max, "close", 20), rolling(F.min, "close", 20)
    roc10, roc21 = finite(ieee_div("close", lag("close", 10)) - 1), finite(ieee_div("close", lag("close", 21)) - 1)
    d = d.withColumns({"roc10": roc10, "roc21": roc21, "v_slope": slope("v"), "v_mean5": F.avg("v").over(five), "hi": hi, "lo": lo, "rs_slope": slope("rs21") if benchmark is not None else F.lit(None).cast("double")})
    if newest is not None:
        d = d.join(newest, "security_id")
    if stored is not None:  # only the newest row's values are read below
        s = known(stored, as_of).groupBy("security_id").agg(F.max_by(F.struct(*names), F.struct("effective_date", "available_at")).alias("s"))
        d = d.join(s, "security_id", "left").withColumns({c: F.coalesce(F.col("s")[c], F.col(c)) for c in names}).drop("s")
    width = F.col("keltner_upper") - F.col("keltner_lower")
    values = {
        "price_action.daily_move": F.try_divide(F.col("close") - F.col("pc"), F.col("pc")),
        "price_action.intraday_volatility": F.col("h_range"),
        "price_action.gap": F.try_divide(F.col("open") - F.col("pc"), F.col("pc")),
        "trend.regime": F.col("adx_14"),
        "trend.directional_bias": F.col("di_plus_14") - F.col("di_minus_14"),
        "trend.strength": F.col("adx_14"),  # ranked among mean moves of the close, as the definition has it
        "momentum.rsi_14": F.col("rsi_14"),
        "momentum.macd_cross": F.col("macd") - F.col("macd_ema"),
        "momentum.quality": (F.col("roc10") + F.col("roc21")) / 2,
        "volatility.atr_percent": F.col("atr_pct"),
        "volatility.bollinger_width": F.col("bandwidth"),
        "volatility.regime": finite(ieee_div("realized_vol_21", "realized_vol_63")),
        "participation.rvol": F.col("rvol"),
        "participation.volume_trend": F.when(F.col("v_mean5") != 0, F.try_divide(F.col("v_slope"), F.col("v_mean5"))).otherwise(F.when(F.col("v_slope").isNotNull(), 0.0)),
        "market_regime.breakout_state": F.try_divide(F.col("close") - F.col("lo"), F.col("hi") - F.col("lo")),
        "market_regime.keltner_touch": F.when(F.col("keltner_middle") != 0, F.try_divide(F.col("close") - F.col("keltner_middle"), width / 2)),
    }
    if benchmark is not None:
        values["relative_strength.vs_benchmark"] = F.when(F.col("m21") > -1, F.try_divide(1 + F.col("roc21"), 1 + F.col("m21")) - 1)
        values["relative_strength.regime"] = F.col("rs_slope")
    ranked = {r: READOUTS[r].ranked for r in values if READOUTS[r].ranked}
    wide = d.select("security_id", "effective_date", F.col("n").alias("rows"), "roc10", "roc21", *dict.fromkeys(ranked.values()), *[c.cast("double").alias(_name(r)) for r, c in values.items()])
    wide = wide.withColumns({_name(r): finite(_name(r)) for r in values})
    # the newest value beside each row of the history, to count those strictly under it; the rows' order is not
    # asked for, so that nothing is sorted again
    whole = Window.partitionBy("security_id")
    wide = wide.withColumns({f"newest_{_name(r)}": F.max_by(_name(r), "effective_date").over(whole) for r in ranked})
    shares = [F.avg((F.col(h) < F.col(f"newest_{_name(r)}")).cast("double")).alias(f"below_{_name(r)}") for r, h in ranked.items()]
    told = F.max_by(F.struct("rows", "roc10", "roc21", *[_name(r) for r in values]), "effective_date").alias("newest")
    wide = wide.groupBy("security_id").agg(told, *shares).select("security_id", "newest.*", *[f"below_{_name(r)}" for r in ranked])
    # values and states first, so that what follows from a state doesn't repeat its expression
    wide = wide.withColumns({_name(r): F.when(F.col("rows") >= READOUTS[r].lookback, F.col(_name(r))) for r in values})
    wide = wide.withColumns({f"state_{_name(r)}": _state(r, profiles.get(r)) for r in values})
    return wide.select("security_id", F.inline(F.array(*[_item(r, places) for r in sorted(values)])))


def _name(readout: str) -> str:
    return readout.replace(".", "__")


def _state(readout: str, profile: Profile | None) -> Column:
    r, value = READOUTS[readout], F.col(_name(readout))
    if profile is None:
        return F.lit("unavailable")
    tested = F.abs(value) if readout == "market_regime.keltner_touch" else value
    return resolve_state(profile, tested, F.col("rows") if r.ranked else None, F.col(f"below_{_name(readout)}") if r.ranked else None, r.lookback)


def _item(readout: str, places: int | None) -> Column:
    r, value, state = READOUTS[readout], F.col(_name(readout)), F.col(f"state_{_name(readout)}")
    sign = lambda x: F.when(x > 0, "upward").when(x < 0, "downward").otherwise("mixed")
    orientation = {
        "none": F.lit("not_applicable"), "sign": sign(value), "fifty": sign(value - 50), "state": state,
        "both": F.when((F.col("roc10") > 0) & (F.col("roc21") > 0), "upward").when((F.col("roc10") < 0) & (F.col("roc21") < 0), "downward").otherwise("mixed"),
        "breakout": F.when(state == "breaking_out", "upward").when(state == "reversing", "downward").otherwise("mixed"),
    }[r.orientation]
    orientation = F.when(value.isNull(), "not_applicable").otherwise(orientation)
    level = lambda states: F.when(state.isin(*states), "elevated").otherwise("normal") if states else F.lit("normal")
    risk = F.when(state == "blown", "extreme").otherwise(level(r.risk))
    return F.struct(F.lit(readout).alias("definition_id"), F.round(value, r.places if places is None else places).alias("value"), state.alias("state"), orientation.alias("orientation"), level(r.attention).alias("attention"), risk.alias("risk"), _color(r, state).alias("color"))
