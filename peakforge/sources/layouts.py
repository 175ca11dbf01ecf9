"""Built datasets on disk: stages in folders by year, and instrument folders named by the metadata."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.operators import replicates, transforms
from peakforge.sources import bruker, records, text


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder of any file system, folders ending with a slash, in order; none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() + ("/" if s.isDirectory() else "") for s in fs.listStatus(at))


def stage_of(names: list[str]) -> str:
    """The stage to read where none is asked for: the binned one with the most bins, else preprocessed, else raw."""
    binned = sorted((int(m[1]), m[0].rstrip("/")) for n in names if (m := re.fullmatch(r"binned_(\d+)/", n)))
    if binned:
        return binned[-1][1]
    for stage in ("preprocessed", "raw"):
        if f"{stage}/" in names:
            return stage
    raise FileNotFoundError("no stage folder: binned_N, preprocessed or raw")


@dataclass
class StagedLayout:
    """Folder per stage (``binned_N``, ``preprocessed``, ``raw``), below it one per year or the files, and metadata in ``id`` (by year or flat).

    What isn't given comes from the dataset's manifest, else from the defaults.
    """

    root: str
    stage: str | None = None
    year: int | None = None
    id_column: str | None = None
    species_column: str | None = None
    metadata_dir: str = "id"
    metadata_suffix: str = "clean"
    glob: str = "*.txt"
    duplicates: str = "first"
    id_transform: Callable[[Column], Column] | None = None
    collapse_replicates: bool = False
    low: float = 2000.0
    high: float = 20000.0
    normalise_tic: bool = False

    def years(self, spark: SparkSession, folder: str) -> list[str]:
        found = [n.rstrip("/") for n in children(spark, folder) if re.fullmatch(r"\d{4}/", n)]
        return [y for y in found if self.year is None or int(y) == self.year]

    def _key(self, column: Column) -> Column:
        key = F.trim(column)
        if self.collapse_replicates:
            key = replicates.isolate_key(key, r"_MALDI\d+$")
        return self.id_transform(key) if self.id_transform else key

    def metadata(self, spark: SparkSession) -> DataFrame:
        """All tables of the year folders united, else the first file with the suffix, else the first CSV file; one row per id."""
        base = f"{self.root.rstrip('/')}/{self.metadata_dir}"
        years = self.years(spark, base)
        places = [(int(y), f"{base}/{y}", children(spark, f"{base}/{y}")) for y in years] or [(None, base, children(spark, base))]
        out = None
        for year, folder, names in places:
            csv = [n for n in names if n.endswith(".csv")]
            for n in csv if year is not None else [n for n in csv if n[:-4].endswith(self.metadata_suffix)][:1] or csv[:1]:
                part = spark.read.option("header", True).csv(f"{folder}/{n}")
                part = part if year is None else part.withColumn("year", F.lit(year))
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise FileNotFoundError(f"no metadata below {base}")
        key = self.id_column or records.id_column(out.columns)
        named = self.species_column or records.species_column(out.columns)
        if named and named != "species" and "species" not in out.columns:
            out = out.withColumnRenamed(named, "species")
        out = out.withColumn("spectrum_id", self._key(F.col(key)))
        return replicates.resolve_duplicates(out, "spectrum_id", [c for c in out.columns if c != "spectrum_id"], self.duplicates)

    def spectra(self, spark: SparkSession) -> DataFrame:
        """(spectrum_id, path, mz, intensity) of the stage; bin numbers become m/z, shares add up to 1 where that is asked for."""
        from peakforge.sources.dataset import from_bin_index

        root = self.root.rstrip("/")
        stage = self.stage or stage_of(children(spark, root))
        folder = f"{root}/{stage}"
        years = self.years(spark, folder)
        if self.year is not None and not years:
            raise FileNotFoundError(f"no year {self.year} below {folder}")
        s = text.read_spectra(spark, [f"{folder}/{y}" for y in years] or folder, self.glob)
        s = replicates.resolve_duplicates(s.withColumn("spectrum_id", self._key(F.col("spectrum_id"))), "spectrum_id", ["path"], self.duplicates)
        s = from_bin_index(s, self.low, self.high) if stage.startswith("binned") else s
        return s.withColumn("intensity", transforms.tic(F.col("intensity"))) if self.normalise_tic else s


def below(root: str, named: Column) -> Column:
    """A path of the metadata below ``root``; folders that both the end of ``root`` and the start of the path name count once. A full path stays."""
    parts = [p for p in root.rstrip("/").split("/") if p]
    clean = F.regexp_replace(F.replace(F.trim(named), F.lit("\\"), F.lit("/")), r"^(?:\./)+|/+$", "")
    out = F.concat(F.lit(root.rstrip("/") + "/"), clean)
    # The longest common part is tried last and so holds.
    for n in range(1, len(parts) + 1):
        lead = "/".join(parts[-n:])
        out = F.when(F.startswith(clean, F.lit(lead + "/")) | (clean == lead), F.concat(F.lit(root.rstrip("/")), F.substring(clean, len(lead) + 1, 1_000_000))).otherwise(out)
    return F.when(F.startswith(clean, F.lit("/")) | clean.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), clean).otherwise(out)


@dataclass
class RecordedLayout:
    """Instrument folders that a metadata table names by their paths; only raw spectra."""

    root: str
    metadata_csv: str
    id_column: str = "Identifier"
    path_column: str = "Path"
    position_column: str | None = None
    year: int | None = None
    duplicates: str = "first"
    id_transform: Callable[[Column], Column] | None = None
    source: str = "1r"

    def metadata(self, spark: SparkSession) -> DataFrame:
        """Metadata with spectrum_id and folder; ids with a target position get it behind an underscore."""
        meta = spark.read.option("header", True).csv(self.metadata_csv)
        missing = [c for c in (self.id_column, self.path_column) if c not in meta.columns]
        if missing:
            raise ValueError(f"columns missing: {', '.join(missing)}")
        if self.year is not None:
            year = next((c for c in meta.columns if c.lower() == "year"), None)
            if year is None:
                raise ValueError("there is no year column")
            meta = meta.where(records.year_of(F.col(year)) == self.year)
        key = F.trim(F.col(self.id_column))
        if self.position_column:
            key = F.concat_ws("_", key, F.trim(F.col(self.position_column)))
        key = self.id_transform(key) if self.id_transform else key
        meta = meta.withColumn("spectrum_id", key).withColumn("folder", below(self.root, F.col(self.path_column)))
        return replicates.resolve_duplicates(meta, "spectrum_id", [self.path_column], self.duplicates)

    def spectra(self, spark: SparkSession) -> DataFrame:
        """(spectrum_id, path, mz, intensity): the readable spectra at or below each named folder, the first in order of paths."""
        found = bruker.read_bruker(spark, self.root, self.source).where("error is null").select("path", "mz", "intensity")
        plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/+", "/"), "/+$", "")
        # A spectrum lies at most three folders below the one that is named.
        parts = F.split(plain(F.col("path")), "/")
        found = found.withColumn("folder", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda n: F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - n, F.lit(1))), "/"))))
        named = self.metadata(spark).select("spectrum_id", plain(F.col("folder")).alias("folder"))
        near = found.join(named, "folder").withColumn("depth", F.size(F.split(plain(F.col("path")), "/")))
        return replicates.resolve_duplicates(near, "spectrum_id", ["depth", "path"], "first").select("spectrum_id", "path", "mz", "intensity")
