"""Queries of the data preparation operators of the core: merging small files (p3) and rows that fail to parse (p5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakforge.operators import compaction, rejects
from peakforge.plans.registry import Registry
from peakforge.sources.tables import table

R = Registry()

#: The data files are a few hundred bytes; in test data an output file of 128 KiB is "well-sized".
TARGET = 131_072

_FILES = r"""
WITH bare AS (
  SELECT file_no, size_bytes, n_points,
         list_filter(string_split(replace(url_decode(regexp_replace(path, '^[A-Za-z][A-Za-z0-9+.\-]+:([/\\])', '\1')), '\', '/'), '/'), lambda s: s <> '' AND s <> '.') AS parts
  FROM raw_input WHERE path IS NOT NULL AND file_no IS NOT NULL),
paths AS (
  SELECT file_no, size_bytes, n_points,
         list_reduce(parts, lambda done, s: CASE WHEN s = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || s END, '') AS path
  FROM bare),
files AS (
  SELECT path, min(file_no) AS file_no, coalesce(arg_min_null(size_bytes, file_no), max(size_bytes)) AS size_bytes, max(n_points) AS n_points
  FROM paths GROUP BY path),
small AS (
  SELECT file_no, path, n_points, coalesce(size_bytes, 4095) AS bytes FROM files
  WHERE lower(regexp_extract(path, '[^/]*$')) LIKE '%.txt' AND regexp_extract(path, '[^/]*$')[1] NOT IN ('.', '_')
    AND (size_bytes IS NULL OR (size_bytes > 0 AND size_bytes < 4096)))
"""

_PLAN = _FILES + f""",
plan AS (
  SELECT *, CAST(floor(coalesce(sum(bytes) OVER (ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {TARGET}.0) AS BIGINT) AS group_no
  FROM small)
"""


def _plan(spark, d):
    return compaction.merge_plan(table(spark, d, "raw_input", "file_no", "path", "size_bytes", "n_points"), target=TARGET)


@R.add("p3_found", _FILES + "SELECT file_no FROM small")
def p3_found(spark, d):
    # Only files that the plan puts into a group are found.
    return _plan(spark, d).where("group_no >= 0").select("file_no")


@R.add("p3_groups", _PLAN + "SELECT group_no, count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS bytes, min(file_no) AS first_file, max(file_no) AS last_file FROM plan GROUP BY group_no")
def p3_groups(spark, d):
    return _plan(spark, d).groupBy("group_no").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"), F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file")
    )


@R.add(
    "p3_reconcile",
    _PLAN
    + """, lines AS (SELECT DISTINCT file_no, pos FROM peak_set_raw WHERE file_no IS NOT NULL),
per_file AS (SELECT file_no, count(*) AS n FROM lines GROUP BY file_no)
SELECT group_no, count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(sum(CASE WHEN n IS NOT NULL THEN n_points END), 0) AS BIGINT) AS n_expected, count(*) FILTER (n <> n_points) AS n_incomplete
FROM plan LEFT JOIN per_file USING (file_no) GROUP BY group_no""",
)
def p3_reconcile(spark, d):
    lines = table(spark, d, "peak_set_raw", "line_no", "file_no", "pos", "raw")
    return compaction.reconcile(lines, table(spark, d, "raw_input", "file_no", "path", "size_bytes", "n_points"), _plan(spark, d))


@R.add(
    "p3_merged_lines",
    _PLAN
    + """SELECT group_no, file_no, pos, arg_min(raw, line_no) AS raw FROM peak_set_raw JOIN plan USING (file_no) GROUP BY group_no, file_no, pos""",
)
def p3_merged_lines(spark, d):
    return compaction.merged_lines(table(spark, d, "peak_set_raw", "line_no", "file_no", "pos", "raw"), _plan(spark, d))


def _lines(spark, d):
    return table(spark, d, "peak_set_raw", "line_no", "file_no", "sample_id", "pos", "raw"), table(spark, d, "raw_input", "file_no", "delimiter")


# A line's quoted fields give way to one sign, so that what is left can be split plainly.
_READ = r"""
WITH files AS (SELECT file_no, min(delimiter) AS delimiter FROM raw_input WHERE file_no IS NOT NULL GROUP BY file_no),
lines AS (SELECT l.*, coalesce(delimiter, 'space') AS d, coalesce(raw, '') AS text FROM peak_set_raw l LEFT JOIN files USING (file_no) WHERE NOT starts_with(coalesce(raw, ''), '#')),
bare AS (SELECT *, CASE WHEN d IN ('tab', 'comma', 'semicolon') THEN text ELSE trim(text, ' ') END AS line FROM lines),
held AS (SELECT *, regexp_extract_all(line, '"(?:[^"]|"")*"') AS quoted, regexp_replace(line, '"(?:[^"]|"")*"', chr(1), 'g') AS rest FROM bare),
cut AS (SELECT *, CASE d WHEN 'tab' THEN string_split(rest, chr(9)) WHEN 'comma' THEN string_split(rest, ',') WHEN 'semicolon' THEN string_split(rest, ';') ELSE string_split_regex(rest, ' +') END AS f FROM held),
typed AS (SELECT *, contains(rest, '"') OR len(list_filter(f, lambda v: contains(v, chr(1)) AND trim(v, ' ') <> chr(1))) > 0 AS open_,
  CASE WHEN trim(f[1], ' ') = chr(1) THEN replace(quoted[1][2:-2], '""', '"') ELSE f[1] END AS a,
  CASE WHEN trim(f[2], ' ') = chr(1) THEN replace(quoted[CASE WHEN trim(f[1], ' ') = chr(1) THEN 2 ELSE 1 END][2:-2], '""', '"') ELSE f[2] END AS b FROM cut),
plain AS (SELECT *, CASE WHEN d = 'semicolon' AND NOT contains(a, '.') THEN regexp_replace(trim(a, ' ' || chr(9) || chr(13)), '^([^,]*),([^,]*)$', '\1.\2') ELSE trim(a, ' ' || chr(9) || chr(13)) END AS na,
  CASE WHEN d = 'semicolon' AND NOT contains(b, '.') THEN regexp_replace(trim(b, ' ' || chr(9) || chr(13)), '^([^,]*),([^,]*)$', '\1.\2') ELSE trim(b, ' ' || chr(9) || chr(13)) END AS nb FROM typed),
numbers AS (SELECT *, CASE WHEN regexp_full_match(na, NUMBER) THEN try_cast(na AS DOUBLE) END AS mz, CASE WHEN regexp_full_match(nb, NUMBER) THEN try_cast(nb AS DOUBLE) END AS intensity FROM plain),
judged AS (SELECT *, CASE WHEN open_ THEN 'quoting' WHEN len(f) <> 2 THEN 'columns' WHEN NOT coalesce(mz BETWEEN 1000 AND 30000 AND intensity >= 0 AND isfinite(intensity), false) THEN 'value' END AS reason FROM numbers)
""".replace("NUMBER", r"'[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?'")


@R.add("p5_found", _READ + "SELECT line_no, reason FROM judged WHERE reason IS NOT NULL")
def p5_found(spark, d):
    return rejects.rejected_lines(*_lines(spark, d))


@R.add("p5_loaded", _READ + "SELECT line_no, file_no, sample_id, pos, mz, intensity FROM judged WHERE reason IS NULL")
def p5_loaded(spark, d):
    return rejects.loaded_lines(*_lines(spark, d)).select("line_no", "file_no", "sample_id", "pos", "mz", "intensity")


@R.add("p5_reasons", _READ + "SELECT coalesce(reason, 'loaded') AS outcome, count(*) AS n_lines, count(DISTINCT file_no) AS n_files FROM judged GROUP BY 1")
def p5_reasons(spark, d):
    lines, files = _lines(spark, d)
    judged = rejects.judged_lines(lines, files)
    return judged.groupBy(F.coalesce(F.get("errors", F.lit(0)), F.lit("loaded")).alias("outcome")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("file_no").alias("n_files"))
