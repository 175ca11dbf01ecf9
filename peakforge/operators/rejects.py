"""Rows that fail to parse: text in, typed rows and reasons out.

Every line stays text until its rules have run. The rules fill an array of reasons in their fixed order; lines with an
empty array are loaded, the others are set apart with the first reason. All rules are built-in expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.functions.arrays import let
from peakforge.functions.numbers import finite, number

DELIMITERS = {"space": " +", "tab": "\t", "comma": ",", "semicolon": ";"}
MZ_RANGE = (1000.0, 30000.0)


def _by_delimiter(make) -> Column:
    """``make(regex, class)`` per delimiter; an unknown or null delimiter reads as space."""
    other = [(k, v) for k, v in DELIMITERS.items() if k != "space"]
    col = reduce(lambda c, kv: c.when(F.col("delimiter") == kv[0], make(kv[1])), other[1:], F.when(F.col("delimiter") == other[0][0], make(other[0][1])))
    return col.otherwise(make(DELIMITERS["space"]))


def _quoted(d: str) -> str:
    # Possessive throughout: the pattern engine then loops instead of recursing, however long a hostile line is.
    return rf'[ ]*+"[^"]*+(?:""[^"]*+)*+"[ ]*+(?={d}|$)'


def _fields(line: Column) -> Column:
    """Fields of a line, quotes respected; an empty field is a field."""

    def with_quotes(d: str) -> Column:
        return F.regexp_extract_all(line, F.lit(rf'(?:^|{d})({_quoted(d)}|[^"{d[0]}]*)'), 1)

    return F.when(F.contains(line, F.lit('"')), _by_delimiter(with_quotes)).otherwise(_by_delimiter(lambda d: F.split(line, d)))


def _open_quotes(line: Column) -> Column:
    """True if a double quote is left once every field that is wholly enclosed in quotes is taken out."""
    rest = _by_delimiter(lambda d: F.regexp_replace(line, rf"(?:^|(?<={d[0]})){_quoted(d)}", "Q"))
    return F.contains(line, F.lit('"')) & F.contains(rest, F.lit('"'))


def _unquote(field: Column) -> Column:
    bare = F.trim(field, F.lit(" \t\r"))
    inner = F.replace(F.regexp_replace(bare, '^"|"$', ""), F.lit('""'), F.lit('"'))
    return F.when(F.startswith(bare, F.lit('"')), inner).otherwise(bare)


def judged_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Adds to each line ``mz``, ``intensity`` and ``errors`` (array of quoting, columns, value, in this order).

    ``lines`` needs line_no, file_no, raw, ``files`` file_no and delimiter (one of space, tab, comma, semicolon); both
    may carry further columns, those of ``lines`` are kept except delimiter, mz, intensity and errors. A file listed
    twice counts once (smallest delimiter name). A null line counts as empty text, a line whose file is unknown or has no
    delimiter reads as space separated. Lines starting with ``#`` are comments and are left out. Blanks around a line
    of a space separated file separate nothing.
    """
    files = files.where("file_no is not null").groupBy("file_no").agg(F.min("delimiter").alias("delimiter"))
    keep = [c for c in lines.columns if c.lower() not in ("delimiter", "mz", "intensity", "errors")]
    rows = lines.select(*keep).where(~F.startswith(F.coalesce("raw", F.lit("")), F.lit("#")))
    rows = rows.join(files, "file_no", "left")
    text = F.coalesce(F.col("raw"), F.lit(""))
    spaced = F.coalesce(~F.col("delimiter").isin("tab", "comma", "semicolon"), F.lit(True))
    rows = rows.withColumn("_line", F.when(spaced, F.trim(text)).otherwise(text))
    comma = F.coalesce(F.col("delimiter") == "semicolon", F.lit(False))

    def read(f: Column) -> Column:
        return F.struct(F.size(f).alias("n"), number(_unquote(F.get(f, F.lit(0))), comma).alias("mz"), number(_unquote(F.get(f, F.lit(1))), comma).alias("intensity"))

    # Each line is read once: what one generator gives isn't computed again by whatever asks for it.
    rows = rows.withColumn("_r", F.explode(F.array(let(_fields(F.col("_line")), read))))
    two = F.col("_r.n") == 2
    good = F.coalesce(F.col("_r.mz").between(*MZ_RANGE), F.lit(False)) & finite(F.col("_r.intensity")) & F.coalesce(F.col("_r.intensity") >= 0, F.lit(False))
    errors = F.array_compact(F.array(F.when(_open_quotes(F.col("_line")), F.lit("quoting")), F.when(~two, F.lit("columns")), F.when(~good, F.lit("value"))))
    return rows.withColumn("errors", errors).select(*keep, F.col("_r.mz").alias("mz"), F.col("_r.intensity").alias("intensity"), "errors")


def rejected_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(line_no, reason): each line that can't be loaded, with the first reason that applies."""
    return judged_lines(lines, files).where(F.size("errors") > 0).select("line_no", F.get("errors", F.lit(0)).alias("reason"))


def loaded_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """All other lines with typed mz and intensity; lines sent twice stay twice."""
    rows = judged_lines(lines, files).where(F.size("errors") == 0)
    return rows.drop("errors", "raw")
