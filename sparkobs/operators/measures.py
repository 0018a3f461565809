"""Measures over spans and logs, and the orders that rank groups by them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

Z, FLOOR = 1.96, 20


def count() -> Column:
    return F.count(F.lit(1)).cast("double")


def rate(seconds: float) -> Column:
    return count() / F.lit(float(seconds))


def is_error() -> Column:
    return F.col("status") == "ERROR"


def log_error(number: Column | None = None) -> Column:
    """By severity's name, or by its number where the records carry one."""
    named = F.upper("severity").isin("ERROR", "FATAL", "CRITICAL")
    return named if number is None else F.coalesce(number >= 17, F.lit(False)) | F.coalesce(named, F.lit(False))


def error_rate(bad: Column | None = None) -> Column:
    return F.lit(100.0) * F.avg(F.when(is_error() if bad is None else bad, 1.0).otherwise(0.0))


def count_if(p: Column) -> Column:
    return F.count_if(F.coalesce(p, F.lit(False))).cast("double")


def quantile(field: Column, q: float) -> Column:
    return F.percentile(field, F.lit(q))


def last(field: Column, *clock: Column) -> Column:
    return F.max_by(field, F.struct(*clock))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def share(n: Column, *within: str) -> Column:
    """Percent of ``n`` in its bucket."""
    return F.lit(100.0) * n / F.sum(n).over(Window.partitionBy(*within))


def wilson(hits: Column, n: Column, upper: bool = False) -> Column:
    """Bound of the 95 % interval of hits / n."""
    p, z2 = hits / n, Z * Z
    root = F.lit(Z) * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n))
    middle = p + F.lit(z2) / (2 * n)
    return F.least(F.lit(1.0), (middle + root) / (1 + F.lit(z2) / n)) if upper else F.greatest(F.lit(0.0), (middle - root) / (1 + F.lit(z2) / n))


def apdex(field: Column, limit: float) -> Column:
    """(satisfied + tolerating / 2) / all, over rows that have the field."""
    return ratio(count_if(field <= limit) + count_if((field > limit) & (field <= 4 * limit)) / 2, count_if(field.isNotNull()))


FLIPPED = {"lower": "higher", "higher": "lower", "": ""}


@dataclass(frozen=True)
class Expression:
    """A measure's column with what a panel asks of it: its unit, the better direction, and the measure that it is a multiple of.

    ``part`` is a leaf's kind: count, count_if, value or constant; a * base + b with a and b constant keeps the base's rules."""

    column: Column
    fn: str
    unit: str = "none"
    good: str = ""
    part: str = "value"
    field: str | None = None
    constant: float | None = None
    base: Expression | None = None
    a: float = 1.0
    b: float = 0.0

    @property
    def root(self) -> Expression:
        return self.base or self

    @property
    def better(self) -> str:
        return self.root.good if self.a > 0 else FLIPPED[self.root.good] if self.a < 0 else ""

    def _line(self, column: Column, unit: str, a: float, b: float) -> Expression:
        return Expression(column, "expression", unit, base=self.root, a=a, b=b, part="line")

    def __neg__(self) -> Expression:
        return constant(-self.constant) if self.constant is not None else self._line(-self.column, self.unit, -self.a, -self.b)

    def __add__(self, other: Expression | float) -> Expression:
        return combined(self, "+", other)

    def __sub__(self, other: Expression | float) -> Expression:
        return combined(self, "-", other)

    def __mul__(self, other: Expression | float) -> Expression:
        return combined(self, "*", other)

    def __truediv__(self, other: Expression | float) -> Expression:
        return combined(self, "/", other)

    def __radd__(self, other: float) -> Expression:
        return combined(constant(other), "+", self)

    def __rsub__(self, other: float) -> Expression:
        return combined(constant(other), "-", self)

    def __rmul__(self, other: float) -> Expression:
        return combined(constant(other), "*", self)


def constant(x: float) -> Expression:
    return Expression(F.lit(float(x)), "constant", constant=float(x), part="constant")


def combined(x: Expression, op: str, other: Expression | float) -> Expression:
    """Units of sums must agree; a count over a count is a ratio, and 100 of those are percent; a constant factor keeps the unit."""
    y = other if isinstance(other, Expression) else constant(other)
    column = {"+": lambda: x.column + y.column, "-": lambda: x.column - y.column, "*": lambda: x.column * y.column, "/": lambda: ratio(x.column, y.column)}[op]()
    m, k = x.constant, y.constant
    if m is not None and k is not None and (op != "/" or k):
        return constant({"+": m + k, "-": m - k, "*": m * k, "/": m / k if k else 0.0}[op])
    scaled = lambda unit, by: "percent" if unit == "ratio" and by == 100 else unit
    unit = x.unit if op in "+-" and x.unit == y.unit or op == "/" and k is not None else "ratio" if op == "/" and x.unit == y.unit == "count" else "none"
    if op == "*" and (m is not None or k is not None):
        unit = scaled(x.unit, k) if k is not None else scaled(y.unit, m)
    if k is not None and (op != "/" or k):
        a, b = {"+": (x.a, x.b + k), "-": (x.a, x.b - k), "*": (x.a * k, x.b * k), "/": (x.a / (k or 1), x.b / (k or 1))}[op]
        return x._line(column, unit, a, b)
    if m is not None and op != "/":
        a, b = {"+": (y.a, y.b + m), "-": (-y.a, m - y.b), "*": (y.a * m, y.b * m)}[op]
        return y._line(column, unit, a, b)
    share = op == "/" and x.part == "count_if" and y.part == "count"  # a share of rows: as good as its rows
    return Expression(column, "expression", unit, x.good if share else "", "share" if share else "expression")


def counted(errors: bool = False) -> Expression:
    """All rows; of a query that asks for errors, fewer are better."""
    return Expression(count(), "count", "count", "lower" if errors else "higher", "count")


def counted_if(p: Column, errors: bool = False) -> Expression:
    return Expression(count_if(p), "count_if", "count", "lower" if errors else "", "count_if")


def failed() -> Expression:
    return Expression(error_rate(), "error_rate", "percent", "lower", "rate")


def measured(fn: str, field: str, unit: str = "none", q: float = 0.5) -> Expression:
    """avg, min, max, sum or a quantile of a field; less of a duration is better."""
    column = quantile(F.col(field), q) if fn.startswith("p") or fn == "quantile" else {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[fn](field)
    return Expression(column, fn, unit, "lower" if unit in ("ms", "s", "ns") else "", field=field)


def aliases(measures: Sequence[Expression]) -> list[str]:
    """A measure's function, with its field where two share the function."""
    uses = Counter(m.fn for m in measures)
    out = [f"{m.fn}_{m.field}" if uses[m.fn] > 1 and m.field else m.fn for m in measures]
    if len(set(out)) < len(out):
        raise ValueError(f"two measures have one name: {out}")
    return out


def ranking(e: Expression, value: str, n: str, *ties: str) -> list[Column]:
    """Worst first: counts and sums by value, all else by enough support (FLOOR rows) and then by value; a negative multiple turns the order."""
    additive = e.root.fn in ("count", "rate", "sum", "share", "count_if")
    upward = e.a < 0 if additive else e.better == "higher"
    order = [F.asc_nulls_last(value) if upward else F.desc_nulls_last(value), F.desc(n), *map(F.asc, ties)]
    return order if additive else [F.desc(F.col(n) >= FLOOR), *order]
