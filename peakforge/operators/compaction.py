"""Merging many small files: a frozen manifest, groups by cumulative size, rewrite and reconciliation.

Planning is SQL only: paths are brought to one notation, listings of one physical file are folded, sizes are summed in
two levels (inside ranges of the manifest, then over the ranges' totals), and a file's group is the target-sized
interval in which its first byte falls. No path list ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.functions.numbers import running_total

SMALL_BELOW = 4096
TARGET_BYTES = 128 * 1024 * 1024
RANGE = 65_536


def one_notation(path: Column) -> Column:
    """``/a/b/c`` for any notation of a path: URI scheme, percent escapes, slash direction, empty, ``.`` and ``..`` segments.

    A path whose escapes are malformed keeps them as they stand. Letter case is kept. Null stays null.
    """
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]+:(?=[/\\])", "")
    decoded = F.when(F.contains(bare, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)).otherwise(bare)
    slashed = F.translate(decoded, "\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != "."))
    up = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s)),
    )
    folded = F.when(F.array_contains(parts, ".."), up).otherwise(parts)
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def manifest(listing: DataFrame) -> DataFrame:
    """One row per physical file (file_no, path, size_bytes, n_points, n_listed).

    ``listing`` needs file_no, path, size_bytes, n_points; further columns are ignored. Rows with a null path or
    file_no name no file and are left out. Of several listings the smallest file_no names the file and gives its size;
    where that size is unknown, the largest known one of the other listings holds.
    """
    rows = listing.where(F.col("path").isNotNull() & F.col("file_no").isNotNull()).select("file_no", one_notation(F.col("path")).alias("path"), "size_bytes", "n_points")
    first = F.min_by("size_bytes", "file_no")
    return rows.groupBy("path").agg(
        F.min("file_no").alias("file_no"),
        F.coalesce(first, F.max("size_bytes")).alias("size_bytes"),
        F.max("n_points").alias("n_points"),
        F.count(F.lit(1)).alias("n_listed"),
    )


def small_files(files: DataFrame, below: int = SMALL_BELOW, suffix: str = ".txt") -> DataFrame:
    """Files of the manifest to be merged: data files by name whose size is above 0 and below ``below``, or unknown."""
    name = F.substring_index("path", "/", -1)
    size = F.col("size_bytes")
    return files.where(
        F.endswith(F.lower(name), F.lit(suffix)) & ~F.startswith(name, F.lit(".")) & ~F.startswith(name, F.lit("_")) & (size.isNull() | ((size > 0) & (size < below)))
    )


def merge_plan(listing: DataFrame, target: int = TARGET_BYTES, below: int = SMALL_BELOW) -> DataFrame:
    """(file_no, path, bytes, group_no): each small file once, with the output file it goes to.

    A file of unknown size counts with the largest size a small file may have, so that groups stay below the target.
    An empty listing gives an empty plan.
    """
    small = small_files(manifest(listing), below).select("file_no", "path", F.coalesce("size_bytes", F.lit(below - 1)).cast("bigint").alias("bytes"))
    summed = running_total(small, "bytes", F.floor(F.col("file_no") / RANGE), ["file_no"])
    return summed.select("file_no", "path", "bytes", F.floor(F.col("before") / F.lit(target)).cast("bigint").alias("group_no"))


def merged_lines(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """(group_no, file_no, pos, raw): every line of every planned file exactly once.

    ``lines`` needs file_no, pos, raw and line_no; a line sent twice (same file_no and pos) is kept under its smallest
    line_no. Duplicates are folded before the join, with a partial aggregate on the map side.
    """
    once = lines.where("file_no is not null").groupBy("file_no", "pos").agg(F.min_by("raw", "line_no").alias("raw"))
    return once.join(plan.select("file_no", "group_no"), "file_no").select("group_no", "file_no", "pos", "raw")


def write_merged(lines: DataFrame, plan: DataFrame, path: str) -> None:
    """Write the merged lines partitioned by group_no, one sorted file per group.

    Rows are placed by group and file range, so a group is the only unit a task must hold, and its size is the target.
    """
    merged_lines(lines, plan).repartition("group_no").sortWithinPartitions("group_no", "file_no", "pos").write.partitionBy("group_no").mode("overwrite").parquet(path)


def reconcile(lines: DataFrame, listing: DataFrame, plan: DataFrame) -> DataFrame:
    """(group_no, n_files, bytes, n_lines, n_expected, n_incomplete): lines per output file against the listing.

    n_expected sums the listed number of lines of the files that have any line, n_incomplete counts the files whose
    lines in the result differ from it. Files without lines in ``lines`` count in n_files only.
    """
    per_file = merged_lines(lines, plan).groupBy("file_no").agg(F.count(F.lit(1)).alias("n"))
    points = manifest(listing).select("file_no", "n_points")
    full = plan.join(per_file, "file_no", "left").join(points, "file_no", "left")
    return full.groupBy("group_no").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("bytes").alias("bytes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("n_points").cast("bigint"))), F.lit(0)).alias("n_expected"),
        F.count_if(F.col("n") != F.col("n_points")).alias("n_incomplete"),
    )
