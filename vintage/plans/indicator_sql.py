"""The DuckDB SQL of all indicators: windows in steps of CTEs, and one recursive CTE for those that depend on
all earlier rows. It states the definitions on its own; nothing here runs in Spark."""

from __future__ import annotations

W = "PARTITION BY security_id ORDER BY effective_date"
NAN = "CAST('NaN' AS DOUBLE)"


def over(n: int, shift: int = 0) -> str:
    """The frame of the last n rows, or of those before the last ``shift``."""
    return f"OVER ({W} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"


def roll(agg: str, c: str, n: int) -> str:
    return f"(CASE WHEN count({c}) {over(n)} = {n} THEN {agg}({c}) {over(n)} END)"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER ({W})"


def run(c: str) -> str:
    return f"sum({c}) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def div(a: str, b: str) -> str:
    """Division as floating point has it."""
    return f"(CASE WHEN ({b}) = 0 THEN (CASE WHEN ({a}) = 0 OR isnan({a}) THEN {NAN} WHEN ({a}) > 0 THEN CAST('inf' AS DOUBLE) WHEN ({a}) < 0 THEN CAST('-inf' AS DOUBLE) END) ELSE ({a}) / ({b}) END)"


def otherwise(c: str, value: float) -> str:
    """``value`` in place of null and NaN."""
    return f"coalesce(CASE WHEN isnan({c}) THEN {value} ELSE {c} END, {value})"


def place(c: str, agg: str, n: int) -> str:
    return f"list_position(list({c}) {over(n)}, {agg}({c}) {over(n)})"


def slope(c: str, n: int = 20) -> str:
    return f"(CASE WHEN count(*) {over(n)} = {n} THEN regr_slope(coalesce({c}, 0.0::DOUBLE), rn) {over(n)} END)"


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT *, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + f" FROM {source}"


_up, _down = "high - ph", "pl - low"
BASE = {
    "change": "close - pc", "ret": f"{div('close', 'pc')} - 1", "log_return": "ln(CASE WHEN pc > 0 THEN close / pc END)",
    "gain": "CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0.0::DOUBLE) END", "loss": "CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0.0::DOUBLE) END",
    "true_range": "greatest(high - low, abs(high - pc), abs(low - pc))", "tp": "(high + low + close) / 3", "mid": "(high + low) / 2",
    "pos_dm": f"CASE WHEN {_up} > {_down} AND {_up} > 0 THEN {_up} WHEN ph IS NOT NULL THEN 0.0::DOUBLE END", "neg_dm": f"CASE WHEN {_down} > {_up} AND {_down} > 0 THEN {_down} WHEN ph IS NOT NULL THEN 0.0::DOUBLE END",
    "mfv": f"{div('(close - low) - (high - close)', 'high - low')} * v", "bp": "greatest(close - coalesce(CASE WHEN pc IS NOT NULL THEN least(low, pc) END, 0.0::DOUBLE), 0.0::DOUBLE)",
    "signed_v": "CASE WHEN pc IS NULL OR close > pc THEN v WHEN close < pc THEN -v ELSE 0.0::DOUBLE END",
}
_hh, _ll = roll("max", "high", 14), roll("min", "low", 14)
_trp = {n: roll("avg", "true_range", n) for n in (10, 14)}
_osc = [f"{w} * (CASE WHEN sum(true_range) {over(n)} <> 0 THEN sum(bp) {over(n)} / sum(true_range) {over(n)} ELSE 0.5 END)" for n, w in ((7, 4), (14, 2), (28, 1))]
FIRST = {f"sma_{n}": roll("avg", "close", n) for n in (20, 50, 200)} | {f"return_{n}": f"{div('close', lag('close', n))} - 1" for n in (1, 5, 21, 63, 126, 252)} | {
    "rs": div(roll("avg", "gain", 14), roll("avg", "loss", 14)), "rolling_std_20": roll("stddev_samp", "close", 20), "atr_14": _trp[14], "atr_10": _trp[10], "obv": run("signed_v"), "vwap": div(run("tp * v"), run("v")),
    "realized_vol_21": f"{roll('stddev_samp', 'log_return', 21)} * sqrt(252)", "realized_vol_63": f"{roll('stddev_samp', 'log_return', 63)} * sqrt(252)", "v_mean": roll("avg", "v", 20), "v_std": f"coalesce({roll('stddev_samp', 'v', 20)}, 1.0)", "rvol": div("v", roll("avg", "v", 20)),
    "dollar_volume": "close * v", "pct_off_52w_high": f"{div('close', roll('max', 'high', 252))} - 1", "pct_off_52w_low": f"{div('close', roll('min', 'low', 252))} - 1", "is_new_52w_high": f"high >= {roll('max', 'high', 252)}", "is_new_52w_low": f"low <= {roll('min', 'low', 252)}",
    "gap_pct": f"{div('open', 'pc')} - 1", "di_plus_14": div(f"100.0 * {roll('avg', 'pos_dm', 14)}", _trp[14]), "di_minus_14": div(f"100.0 * {roll('avg', 'neg_dm', 14)}", _trp[14]),
    "aroon_up_25": f"CASE WHEN rn >= 25 THEN 4.0::DOUBLE * {place('high', 'max', 25)} END", "aroon_down_25": f"CASE WHEN rn >= 25 THEN 4.0::DOUBLE * {place('low', 'min', 25)} END",
    "chop_ratio": div(f"{_trp[14]} * 14", f"{_hh} - {_ll}"), "roc_12": f"({div('close', lag('close', 12))} - 1) * 100", "stoch_ratio": div(f"100.0 * (close - {_ll})", f"{_hh} - {_ll}"), "williams_r_14": div(f"-100.0 * ({_hh} - close)", f"{_hh} - {_ll}"), "tp_mean": roll("avg", "tp", 20),
    "ultimate_osc": f"100.0 * ({' + '.join(_osc)}) / 7.0", "cmo_14": div(f"100.0 * ({roll('sum', 'gain', 14)} - {roll('sum', 'loss', 14)})", f"{roll('sum', 'gain', 14)} + {roll('sum', 'loss', 14)}"), "bop": div("close - open", "high - low"), "ad_line": run("mfv"), "cmf_20": div(roll("sum", "mfv", 20), roll("sum", "v", 20)),
    "pos_flow": f"CASE WHEN tp > {lag('tp')} THEN tp * v WHEN rn > 1 THEN 0.0::DOUBLE END", "neg_flow": f"CASE WHEN tp > {lag('tp')} THEN 0.0::DOUBLE WHEN rn > 1 THEN tp * v END", "vpt": run("ret * v"), "raw_force": "change * v", "raw_eom": div(f"mid - {lag('mid')}", "v / 10000.0::DOUBLE"),
    "donchian_upper": roll("max", "high", 20), "donchian_lower": roll("min", "low", 20), "range_expansion": div("true_range", _trp[14]), "wma_20": "(" + " + ".join(f"{20 - k} * " + (lag("close", k) if k else "close") for k in range(20)) + ") / 210.0::DOUBLE",
    "linreg_slope_20": slope("close"), "linreg_se": f"CASE WHEN rn >= 20 THEN sqrt(greatest(regr_syy(close, rn) {over(20)} - pow(regr_sxy(close, rn) {over(20)}, 2) / regr_sxx(close, rn) {over(20)}, 0.0::DOUBLE) / 18) END",
    **{f"pivot_{c}": f"CASE WHEN count({c}) OVER c5 = 11 AND {c} = {agg}({c}) OVER c5 THEN {c} END" for c, agg in (("high", "max"), ("low", "min"))}, "inside_bar": "high <= ph AND low >= pl", "outside_bar": "high > ph AND low < pl",
    "gap_fill": "CASE WHEN pc IS NOT NULL THEN coalesce(" + " OR ".join(f"coalesce(lead(low, {k}) OVER ({W}) <= greatest(open, pc) AND lead(high, {k}) OVER ({W}) >= least(open, pc), FALSE)" for k in range(1, 6)) + ", FALSE) END",
}
_before = {n: over(n, 1) for n in (20, 60)}
AGAINST = {f"beta_{n}d": f"CASE WHEN count(ret) {_before[n]} = {n} THEN (CASE WHEN var_pop(bench) {_before[n]} = 0 THEN 0.0 ELSE covar_pop(ret, bench) {_before[n]} / var_pop(bench) {_before[n]} END) END" for n in (20, 60)} | {
    f"rs_spy_{n}d": f"{div('1 + ' + roll('sum', 'ret', n), '1 + ' + roll('sum', 'bench', n))} - 1" for n in (20, 60)} | {
    "corr_spy": f"CASE WHEN count(ret) {_before[60]} = 60 THEN covar_pop(ret, bench) {_before[60]} / nullif(stddev_pop(ret) {_before[60]} * stddev_pop(bench) {_before[60]}, 0) END"}
MIDDLE = {
    "rsi_14": f"100 - 100 / (1 + CASE WHEN isinf(rs) THEN 100.0::DOUBLE ELSE {otherwise('rs', 100.0)} END)", "stoch_k_14": otherwise("stoch_ratio", 50.0), "chop_14": f"100.0 * log10({otherwise('chop_ratio', 1.0)}) / log10(14)",
    "bandwidth": div("4.0 * rolling_std_20", "sma_20"), "abs_dev": "abs(tp - tp_mean)", "dx": otherwise(div("100.0 * abs(di_plus_14 - di_minus_14)", "di_plus_14 + di_minus_14"), 0.0),
}
_rl, _rh, _six = roll("min", "rsi_14", 14), roll("max", "rsi_14", 14), over(6)
SECOND = {f"dist_to_ma_{n}": f"{div('close', f'sma_{n}')} - 1" for n in (20, 50, 200)} | {f"above_ma_{n}": f"close > sma_{n}" for n in (20, 50, 200)} | {f"ma_slope_{n}": f"(sma_{n} - {lag(f'sma_{n}', 5)}) / 5" for n in (20, 50, 200)} | {
    "bb_middle": "sma_20", "bb_upper": "sma_20 + 2 * rolling_std_20", "bb_lower": "sma_20 - 2 * rolling_std_20", "percent_b": div("close - (sma_20 - 2 * rolling_std_20)", "4 * rolling_std_20"), "atr_pct": f"{div('atr_14', 'close')} * 100", "avg_dollar_volume_20": roll("avg", "dollar_volume", 20),
    "aroon_osc_25": "aroon_up_25 - aroon_down_25", "stoch_d_3": roll("avg", "stoch_k_14", 3), "stoch_rsi_14": otherwise(div(f"rsi_14 - {_rl}", f"{_rh} - {_rl}"), 0.5), "mfi_14": "100 - " + div("100.0::DOUBLE", f"1 + {div(roll('sum', 'pos_flow', 14), otherwise(roll('sum', 'neg_flow', 14), 1.0))}"),
    "obv_slope_20": slope("obv"), "volume_spike": "(rvol > 2.5) OR (v > v_mean + 2.5 * v_std)", "donchian_middle": "(donchian_upper + donchian_lower) / 2", "linreg_channel_middle": "CASE WHEN rn >= 20 THEN sma_20 END", "linreg_channel_upper": "sma_20 + 2 * linreg_se", "linreg_channel_lower": "sma_20 - 2 * linreg_se",
    "ma_stack": "CASE WHEN sma_200 IS NOT NULL THEN (CASE WHEN sma_20 > sma_50 AND sma_50 > sma_200 THEN 1.0::DOUBLE WHEN sma_20 < sma_50 AND sma_50 < sma_200 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END) END",
    "rsi_divergence": f"CASE WHEN rn > 10 THEN (CASE WHEN {place('close', 'min', 6)} > {place('rsi_14', 'min', 6)} AND min(rsi_14) {_six} > min(close) {_six} THEN 1.0::DOUBLE WHEN {place('close', 'max', 6)} > {place('rsi_14', 'max', 6)} AND max(rsi_14) {_six} < max(close) {_six} THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END) END",
    "bb_squeeze": f"bandwidth <= {roll('min', 'bandwidth', 126)}", "cci_20": div("tp - tp_mean", f"0.015::DOUBLE * coalesce({roll('avg', 'abs_dev', 20)}, 1.0)"),
    "diff": "close - pc", "c10": lag("close", 10), "path10": f"sum(abs(close - coalesce(pc, close))) {over(10)}",
}


def ema(before: str, x: str, n: int) -> str:
    """One step: not started (null), spoilt (NaN) or a value."""
    x = f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"
    return f"(CASE WHEN {before} IS NULL THEN {x} WHEN {x} IS NULL THEN {NAN} ELSE {before} * {1 - 2 / (n + 1)!r}::DOUBLE + {x} * {2 / (n + 1)!r}::DOUBLE END)"


_STATES = {"e12": ("close", 12), "e26": ("close", 26), "t1": ("close", 15), "d1": ("diff", 25), "d2": ("abs(diff)", 25), "mid20": ("close", 20), "adx": ("dx", 14), "ch3": ("ad_line", 3), "ch10": ("ad_line", 10), "fi": ("raw_force", 13), "em": ("raw_eom", 14)}
_LATER = {"t2": ("t1", 15), "s1": ("d1", 13), "s2": ("d2", 13)}
_LAST = {"sig": ("macd", 9), "psig": ("ppo", 9), "t3": ("t2", 15)}
_ALL = [*_STATES, *_LATER, *_LAST, "k"]


def _step(source: str) -> str:
    """States after a row n, from those before it (r)."""
    sc = "pow((CASE WHEN n.path10 <> 0 AND n.close <> n.c10 THEN abs(n.close - n.c10) / n.path10 ELSE 0.0 END) * (2 / 3.0::DOUBLE - 2 / 31.0::DOUBLE) + 2 / 31.0::DOUBLE, 2)"
    own = ", ".join(f"{ema(f'r.{s}', ('abs(n.diff)' if x == 'abs(diff)' else f'n.{x}'), n)} AS {s}" for s, (x, n) in _STATES.items())
    kept = ", ".join(f"r.{s} AS p_{s}" for s in (*_LATER, *_LAST))
    first = f"SELECT n.security_id, n.rn, {own}, {kept}, CASE WHEN n.rn > 10 THEN coalesce(r.k, n.c10) + {sc} * (n.close - coalesce(r.k, n.c10)) END AS k FROM {source}"
    second = f"SELECT *, e12 - e26 AS macd, (e12 - e26) / e26 * 100 AS ppo, {', '.join(f'{ema(f"p_{s}", x, n)} AS {s}' for s, (x, n) in _LATER.items())} FROM ({first})"
    third = f"SELECT *, {', '.join(f'{ema(f"p_{s}", x, n)} AS {s}' for s, (x, n) in _LAST.items())} FROM ({second})"
    return f"SELECT security_id, rn, {', '.join(_ALL)} FROM ({third})"


RECURSIVE = {
    "ema_12": "e12", "ema_26": "e26", "macd": "e12 - e26", "macd_ema": "sig", "macd_histogram": "e12 - e26 - sig", "ppo": "(e12 - e26) / e26 * 100", "ppo_signal": "psig", "ppo_histogram": "(e12 - e26) / e26 * 100 - psig", "trix_15": f"({div('t3', lag('t3'))} - 1) * 100",
    "tsi_25_13": f"100 * {div('s1', 's2')}", "adx_14": "adx", "chaikin_osc": "ch3 - ch10", "force_index_13": "fi", "eom_14": "em", "keltner_upper": "mid20 + 2 * atr_10", "keltner_middle": "mid20", "keltner_lower": "mid20 - 2 * atr_10", "kama_10": "k",
}


def steps(bars: str, benchmark: str | None = None) -> str:
    """CTEs up to ``wide``, one row for each bar with every indicator. bars: the name of a CTE of bars, one
    per cell; benchmark: a security_id in it."""
    bench = f"SELECT x0.*, coalesce(m.bench, 0.0::DOUBLE) AS bench FROM x0 LEFT JOIN (SELECT effective_date, {div('close', lag('close'))} - 1 AS bench FROM {bars} WHERE security_id = '{benchmark}') m USING (effective_date)" if benchmark else "SELECT * FROM x0"
    none = ", ".join(f"NULL::DOUBLE AS {s}" for s in _ALL)
    x2 = f"SELECT *, ret - beta_20d * bench AS alpha FROM ({_select(AGAINST, 'xb')})" if benchmark else "SELECT * FROM xb"
    return f"""x AS (SELECT *, CAST(volume AS DOUBLE) AS v, row_number() OVER ({W}) AS rn, {lag('close')} AS pc, {lag('high')} AS ph, {lag('low')} AS pl FROM {bars}),
        x0 AS ({_select(BASE, 'x')}), xb AS ({bench}), x2 AS ({x2}),
        x3 AS ({_select(FIRST, 'x2')} WINDOW c5 AS ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)), x4 AS ({_select(MIDDLE, 'x3')}), x5 AS MATERIALIZED ({_select(SECOND, 'x4')}),
        z AS MATERIALIZED (SELECT security_id, rn, close, diff, dx, ad_line, raw_force, raw_eom, c10, path10 FROM x5),
        r AS ({_step(f'z n CROSS JOIN (SELECT {none}) r WHERE n.rn = 1')} UNION ALL {_step('r JOIN z n ON n.security_id = r.security_id AND n.rn = r.rn + 1')}),
        wide AS ({_select(RECURSIVE, 'x5 JOIN r USING (security_id, rn)')})"""


#: Columns that count in money or shares and so are rounded to whole numbers; others to four places.
LARGE = ("obv", "vpt", "ad_line", "dollar_volume", "avg_dollar_volume_20", "force_index_13", "chaikin_osc", "obv_slope_20", "eom_14")


#: Both engines add this before they round: prices have few decimals, so some would be ties, which the last
#: bit of a sum would decide.
OFF = 0.00001234


def places(c: str) -> int:
    return 0 if c in LARGE else 4


def shown(c: str, exact: tuple[str, ...] = ("true_range", "pivot_high", "pivot_low")) -> str:
    """A double column as the queries show it."""
    return f"{c} AS {c}" if c in exact else f"CASE WHEN NOT isnan({c}) AND NOT isinf({c}) THEN round({c} + {OFF}, {places(c)}) + 0.0::DOUBLE END AS {c}"


BOOLEANS = ("is_new_52w_high", "is_new_52w_low", "inside_bar", "outside_bar", "gap_fill", "above_ma_20", "above_ma_50", "above_ma_200", "volume_spike", "bb_squeeze")
_INNER = ("change", "ret", "gain", "loss", "tp", "mid", "pos_dm", "neg_dm", "mfv", "bp", "signed_v", "rs", "v_mean", "v_std", "tp_mean", "pos_flow", "neg_flow", "raw_force", "raw_eom", "linreg_se", "chop_ratio", "stoch_ratio", "abs_dev", "dx", "atr_10", "diff", "c10", "path10")


def names(benchmark: bool) -> list[str]:
    """The public indicators."""
    found = {**BASE, **FIRST, **(AGAINST | {"alpha": ""} if benchmark else {}), **MIDDLE, **SECOND, **RECURSIVE}
    return [c for c in found if c not in _INNER]


def listed(columns: list[str]) -> str:
    return ", ".join(c if c in BOOLEANS else shown(c) for c in columns)
