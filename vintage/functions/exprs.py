"""Column helpers: IEEE division and full-frame windows over one security's history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history():
    """The order that every time-series expression shares, so one shuffle and one sort serve them all."""
    return Window.partitionBy("security_id").orderBy("effective_date")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ieee_div(a: str | Column, b: str | Column) -> Column:
    """a / b as floating point has it: infinite or NaN for a zero divisor, where ANSI SQL raises."""
    a, b = col(a), col(b)
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def finite(c: str | Column) -> Column:
    """Null for NaN and infinities."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def half_up(c: str | Column, places: int) -> Column:
    """As ``round``, halves away from zero, in floating point where all digits fit it: no decimal is built."""
    c, scale = col(c), 10.0**places
    up = F.when(c < 0, -F.floor(0.5 - c * scale)).otherwise(F.floor(c * scale + 0.5)) / F.lit(scale)
    return F.when(F.abs(c) * scale < 1e14, up).otherwise(F.round(c, places))


def or_nan(c: Column, value: float) -> Column:
    """``value`` in place of null and NaN."""
    return F.coalesce(F.nanvl(c, F.lit(value)), F.lit(value))


def lag(c: str | Column, n: int = 1) -> Column:
    return F.lag(c, n).over(history())


def last(n: int):
    return history().rowsBetween(-(n - 1), 0)


def rolling(agg: Callable[[Column], Column], c: str | Column, n: int) -> Column:
    """The aggregate of the last n rows, null until they hold n values."""
    return F.when(F.count(col(c)).over(last(n)) == n, agg(col(c)).over(last(n)))


def running(agg: Callable[[Column], Column], c: str | Column) -> Column:
    return agg(col(c)).over(history().rowsBetween(Window.unboundedPreceding, 0))


class Shared:
    """The window expressions of one step, each once. Formulas repeat their operands (``ieee_div`` names each
    several times), and Spark evaluates every copy of a window; here a formula gets the column that holds it.
    ``add`` puts windows and formulas beside a frame's columns and lets the windows go."""

    def __init__(self):
        self.windows: dict[tuple[str, str], tuple[str, Column]] = {}

    def over(self, agg: Column, frame, key: str) -> Column:
        """An aggregate over a frame, which ``key`` names."""
        name, _ = self.windows.setdefault((str(agg), key), (f"__w{len(self.windows)}", agg.over(frame)))
        return F.col(name)

    def lag(self, c: str, n: int = 1) -> Column:
        return self.over(F.lag(c, n), history(), "")

    def last(self, agg: Column, n: int) -> Column:
        return self.over(agg, last(n), f"last {n}")

    def before(self, agg: Column, n: int) -> Column:
        """Over the n rows before this one."""
        return self.over(agg, history().rowsBetween(-n, -1), f"before {n}")

    def rolling(self, agg: Callable[[Column], Column], c: str | Column, n: int) -> Column:
        """As ``rolling`` above."""
        return F.when(self.last(F.count(col(c)), n) == n, self.last(agg(col(c)), n))

    def running(self, agg: Callable[[Column], Column], c: str | Column) -> Column:
        return self.over(agg(col(c)), history().rowsBetween(Window.unboundedPreceding, 0), "running")

    def add(self, d: DataFrame, cols: dict[str, Column]) -> DataFrame:
        return d.withColumns(dict(self.windows.values())).withColumns(cols).drop(*[name for name, _ in self.windows.values()])
