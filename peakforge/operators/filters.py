"""Filter algebra over metadata columns with two-valued logic: a condition that is null is false, also under ``~``."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule:
    """A named condition; combines with ``&``, ``|`` and ``~``."""

    def __init__(self, build: Callable[[list[str]], Column]) -> None:
        self._build = build

    def column(self, names: list[str]) -> Column:
        """The condition for a frame with these columns, never null."""
        return F.coalesce(self._build(names), F.lit(False))

    def __and__(self, other: Rule) -> Rule:
        return Rule(lambda n: self.column(n) & other.column(n))

    def __or__(self, other: Rule) -> Rule:
        return Rule(lambda n: self.column(n) | other.column(n))

    def __invert__(self) -> Rule:
        return Rule(lambda n: ~self.column(n))


def species(names: str | Iterable[str], column: str = "species") -> Rule:
    wanted = [names] if isinstance(names, str) else list(names)
    return Rule(lambda n: F.col(column).isin(wanted) if column in n else F.lit(False))


def drug(column: str, status: str | Iterable[str] | None = None) -> Rule:
    """The drug has a value, one of ``status`` if given."""
    wanted = None if status is None else [status] if isinstance(status, str) else list(status)

    def build(n: list[str]) -> Column:
        if column not in n:
            return F.lit(False)
        known = F.col(column).isNotNull() & (F.col(column).cast("string") != "NaN")
        return known if wanted is None else known & F.col(column).isin(wanted)

    return Rule(build)


def quality(min_snr: float | None = None, min_peaks: int | None = None, max_baseline_fraction: float | None = None) -> Rule:
    """Thresholds on snr, n_peaks and baseline_fraction; a missing column or null fails, NaN passes."""

    def build(n: list[str]) -> Column:
        out = F.lit(True)
        for name, limit, low in (("snr", min_snr, True), ("n_peaks", min_peaks, True), ("baseline_fraction", max_baseline_fraction, False)):
            if limit is None:
                continue
            if name not in n:
                return F.lit(False)
            c = F.col(name).cast("double")
            out = out & c.isNotNull() & (F.isnan(c) | ((c >= limit) if low else (c <= limit)))
        return out

    return Rule(build)


def metadata(column: str, condition: Callable[[Column], Column]) -> Rule:
    """Any condition on one column, given as a function of the column."""
    return Rule(lambda n: condition(F.col(column)) if column in n else F.lit(False))


def apply(df: DataFrame, *rules: Rule) -> DataFrame:
    """Rows that meet all rules; the conditions reach the scan like any other filter."""
    for r in rules:
        df = df.where(r.column(df.columns))
    return df


def any_drug(df: DataFrame, drugs: list[str], one_species: str | None = None, column: str = "species") -> DataFrame:
    """Rows with a value for any of the drugs, of one species if given; no row left is an error."""
    if drugs:
        df = df.where(F.coalesce(*[F.col(d).cast("string") for d in drugs]).isNotNull())
    if one_species is not None:
        df = df.where(F.col(column) == one_species)
        if df.limit(1).count() == 0:
            raise ValueError(f"no row of {one_species}")
    return df
