"""Sets of spectra with metadata: input layouts, building and loading of datasets, export."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.operators import binning, filters, replicates
from peakforge.operators.pipeline import Pipeline
from peakforge.sources import bruker, records, text

STAGES = ("raw", "preprocessed", "binned")


@dataclass
class FlatLayout:
    """Text files in a folder tree and one metadata CSV; years from a column, overrides or a four-digit folder."""

    spectra_dir: str
    metadata_csv: str
    id_column: str | None = None
    year_column: str | None = None
    year_overrides: dict[str, int] = field(default_factory=dict)
    glob: str = "*.txt"

    def spectra(self, spark: SparkSession) -> DataFrame:
        s = text.read_spectra(spark, self.spectra_dir, self.glob)
        return s.withColumn("folder_year", F.regexp_extract("path", r"/(\d{4})/[^/]*$", 1).try_cast("int"))

    def metadata(self, spark: SparkSession) -> DataFrame:
        meta = records.read_metadata(spark, self.metadata_csv)
        key = self.id_column or records.id_column(meta.columns)
        return meta.withColumn("spectrum_id", F.trim(F.col(key)))

    def joined(self, spark: SparkSession) -> DataFrame:
        meta, s = self.metadata(spark), self.spectra(spark)
        over = F.try_element_at(F.create_map(*[F.lit(v) for kv in self.year_overrides.items() for v in kv]), F.col("spectrum_id")) if self.year_overrides else F.lit(None).cast("int")
        col = records.year_of(F.col(self.year_column)) if self.year_column else F.lit(None).cast("int")
        meta = replicates.resolve_duplicates(meta.withColumn("_meta_year", F.coalesce(col, over)), "spectrum_id", [c for c in meta.columns if c != "spectrum_id"] or ["spectrum_id"], "first")
        first = replicates.resolve_duplicates(s, "spectrum_id", ["path"], "first")
        return first.join(meta, "spectrum_id").withColumn("year", F.coalesce("_meta_year", "folder_year")).drop("_meta_year", "folder_year")


@dataclass
class InstrumentLayout(FlatLayout):
    """Instrument directories below a root; all-zero spectra are skipped."""

    source: str = "fid"

    def spectra(self, spark: SparkSession) -> DataFrame:
        s = bruker.read_bruker(spark, self.spectra_dir, self.source).where("error is null").where(F.exists("intensity", lambda v: v != 0))
        return s.drop("error", "content_hash").withColumn("folder_year", F.regexp_extract("path", r"/(\d{4})/", 1).try_cast("int"))


@dataclass(frozen=True)
class Output:
    """A further output of a build: a name, a pipeline and, for binned output, a bin width."""

    name: str
    pipeline: Pipeline
    bin_width: float | None = None


class SpectrumSet:
    """Spectra (spectrum_id, mz, intensity) with metadata (spectrum_id, ...); every method returns lazily planned frames."""

    def __init__(self, spectra: DataFrame, meta: DataFrame, drugs: list[str] = (), species: str | None = None, isolate_pattern: str = r"_MALDI\d+$", isolate_column: str | None = None) -> None:
        self.spectra, self.meta, self.drugs, self.species = spectra, meta, list(drugs), species
        self.isolate_pattern, self.isolate_column = isolate_pattern, isolate_column

    @classmethod
    def from_directory(cls, spark: SparkSession, spectra_dir: str, metadata_csv: str, drugs: list[str] = (), species: str | None = None, pipeline: Pipeline | None = None, id_column: str | None = None) -> SpectrumSet:
        """Text spectra whose id is in the metadata, preprocessed."""
        layout = FlatLayout(spectra_dir, metadata_csv, id_column)
        meta = layout.metadata(spark)
        s = layout.spectra(spark).join(meta.select("spectrum_id").distinct(), "spectrum_id", "left_semi").where(F.size("mz") > 0)
        return cls((pipeline or Pipeline.default()).run(s, "spectrum_id"), meta, drugs, species)

    def filter(self, *rules: filters.Rule) -> SpectrumSet:
        meta = filters.apply(self.meta, *rules)
        return SpectrumSet(self.spectra.join(meta.select("spectrum_id").distinct(), "spectrum_id", "left_semi"), meta, self.drugs, self.species, self.isolate_pattern, self.isolate_column)

    def kept(self) -> DataFrame:
        return filters.any_drug(self.meta, self.drugs, self.species, records.species_column(self.meta.columns) or "species")

    def matrix(self, width: float = 3.0, method: str = "uniform", low: float = 2000.0, high: float = 20000.0) -> DataFrame:
        """(spectrum_id, bin_index, intensity) of the spectra whose metadata are kept, zeros filled in."""
        edges = binning.edges_of(method, low, high, width)
        chosen = self.spectra.join(self.kept().select("spectrum_id").distinct(), "spectrum_id", "left_semi")
        points = chosen.select("spectrum_id", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("spectrum_id", "p.mz", "p.intensity")
        index = binning.uniform_bin(F.col("mz"), low, width, len(edges) - 1) if method == "uniform" else binning.edge_bin(F.col("mz"), edges)
        return binning.bin_points(points, index, len(edges) - 1, "spectrum_id")

    def labels(self, drug: str | None = None) -> DataFrame:
        return self.kept().select("spectrum_id", *([drug] if drug else self.drugs))

    def isolates(self) -> DataFrame:
        """(spectrum_id, isolate) by the isolate column, else the id without its replicate mark."""
        c = F.col(self.isolate_column) if self.isolate_column else replicates.isolate_key(F.col("spectrum_id"), self.isolate_pattern)
        return self.meta.select("spectrum_id", c.alias("isolate"))

    def averaged(self) -> SpectrumSet:
        """One spectrum per isolate, the mean of its replicates on the range they share."""
        keyed = self.spectra.join(self.isolates(), "spectrum_id")
        merged = replicates.merge_overlap(keyed, "isolate").withColumnRenamed("isolate", "spectrum_id")
        meta = self.meta.join(self.isolates(), "spectrum_id")
        first = replicates.resolve_duplicates(meta, "isolate", ["spectrum_id"], "first").withColumn("spectrum_id", F.col("isolate")).drop("isolate")
        return SpectrumSet(merged, first, self.drugs, self.species)

    def to_parquet(self, path: str, **how) -> None:
        self.matrix(**how).write.mode("overwrite").parquet(path)

    def to_csv(self, path: str, width: float = 3.0, low: float = 2000.0, high: float = 20000.0) -> None:
        """Wide export: one column per bin, named by its start."""
        edges = binning.uniform_edges(low, high, width)
        rows = self.matrix(width, low=low, high=high).groupBy("spectrum_id").agg(F.array_sort(F.collect_list(F.struct("bin_index", "intensity"))).alias("b"))
        rows.select("spectrum_id", *[F.get("b", F.lit(i))["intensity"].alias(str(e)) for i, e in enumerate(edges[:-1])]).write.mode("overwrite").option("header", True).csv(path)

    def save_spectra(self, path: str, fmt: str = "csv", stage: str = "preprocessed", width: float = 3.0) -> None:
        """Points of every spectrum below ``spectrum_id=...``, as CSV or tab-separated text; the binned stage has the starts of the bins as m/z.

        A set holds the spectra of one stage; their raw state is that of the frame it was made from.
        """
        if stage not in STAGES or fmt not in ("csv", "txt"):
            raise ValueError("stage is raw, preprocessed or binned, fmt csv or txt")
        held = self.spectra
        if stage == "binned":
            rows = self.matrix(width).groupBy("spectrum_id").agg(F.array_sort(F.collect_list(F.struct((F.col("bin_index") * width + 2000.0).alias("mz"), "intensity"))).alias("p"))
            held = rows.select("spectrum_id", F.transform("p", lambda v: v["mz"]).alias("mz"), F.transform("p", lambda v: v["intensity"]).alias("intensity"))
        p = held.select("spectrum_id", F.posexplode(F.arrays_zip("mz", "intensity")).alias("pos", "p")).select("spectrum_id", "pos", "p.mz", "p.intensity")
        p = p.repartition("spectrum_id").sortWithinPartitions("spectrum_id", "pos").drop("pos")
        p.write.mode("overwrite").partitionBy("spectrum_id").option("header", True).option("sep", "," if fmt == "csv" else "\t").csv(path)


def write_text(spectra: DataFrame, path: str, binned: bool = False) -> None:
    """One line per point below ``spectrum_id=...``: m/z and intensity with six decimals, of binned spectra the bin's number and all digits."""
    p = spectra.select("spectrum_id", F.posexplode(F.arrays_zip("mz", "intensity")).alias("pos", "p"))
    line = F.concat(F.col("pos").cast("string"), F.lit(" "), F.col("p.intensity").cast("double").cast("string")) if binned else F.format_string("%.6f %.6f", F.col("p.mz").cast("double"), F.col("p.intensity").cast("double"))
    rows = p.select("spectrum_id", "pos", line.alias("value")).repartition("spectrum_id").sortWithinPartitions("spectrum_id", "pos").drop("pos")
    if binned:
        head = rows.select("spectrum_id", F.lit(-1).alias("pos"), F.lit("bin_index binned_intensity").alias("value")).distinct()
        both = p.select("spectrum_id", "pos", line.alias("value")).union(head.select("spectrum_id", "pos", "value"))
        rows = both.repartition("spectrum_id").sortWithinPartitions("spectrum_id", "pos").drop("pos")
    rows.write.mode("overwrite").partitionBy("spectrum_id").text(path)


def build(spark: SparkSession, layout: FlatLayout, out: str, name: str, pipeline: Pipeline | None = None, bin_width: float = 3.0, extra: list[Output] = (), on_error: str = "warn") -> dict:
    """Write raw, preprocessed and binned spectra as parquet by stage and year, the metadata by year, the failures and a manifest.

    Spectra that can't be read fail by themselves and stand in ``errors`` (spectrum_id, reason); ``on_error="raise"`` stops before the manifest.
    """
    pipeline = pipeline or Pipeline.default()
    low, high = pipeline.mz_range
    outputs = [Output("preprocessed", pipeline), Output(f"binned_{len(binning.uniform_edges(low, high, bin_width)) - 1}", pipeline, bin_width), *extra]
    names = [o.name for o in outputs]
    if len({*names, "raw"}) != len(names) + 1:
        raise ValueError("output names must differ")
    rows = layout.joined(spark)
    good, bad = rows.where(F.size("mz") > 0), rows.where(F.size("mz") == 0).select("spectrum_id", F.lit("no numeric line").alias("reason"))
    bad.write.mode("overwrite").parquet(f"{out}/errors")
    n_bad = spark.read.schema(bad.schema).parquet(f"{out}/errors").count()
    if n_bad and on_error == "raise":
        raise ValueError(f"{n_bad} spectra failed")
    good.select("spectrum_id", "year", "mz", "intensity").write.mode("overwrite").partitionBy("year").parquet(f"{out}/stage=raw")
    raw = spark.read.parquet(f"{out}/stage=raw")
    rows.drop("path", "mz", "intensity").write.mode("overwrite").partitionBy("year").parquet(f"{out}/metadata")
    years = raw.select("spectrum_id", "year")
    for o in outputs:
        done = o.pipeline.run(raw, "spectrum_id")
        if o.bin_width:
            lo, hi = o.pipeline.mz_range
            n = len(binning.uniform_edges(lo, hi, o.bin_width)) - 1
            p = done.select("spectrum_id", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("spectrum_id", "p.mz", "p.intensity")
            done = binning.bin_points(p, binning.uniform_bin(F.col("mz"), lo, o.bin_width, n), n, "spectrum_id")
        done.join(years, "spectrum_id").write.mode("overwrite").partitionBy("year").parquet(f"{out}/stage={o.name}")
    report = {"name": name, "stages": ["raw", *names], "n_spectra": raw.count(), "n_failed": n_bad, "pipeline": pipeline.to_dict(), "bin_width": bin_width}
    records.write_manifest(out, report)
    return report


def load(spark: SparkSession, path: str, stage: str | None = None, year: int | None = None, species: str | None = None, drugs: list[str] = (), id_transform: Callable | None = None, average: bool = False, then: Callable[[SpectrumSet], SpectrumSet] | None = None) -> SpectrumSet:
    """A built dataset: the named stage or preprocessed, pruned to a year, metadata filtered before spectra are read; ``then`` is applied before averaging."""
    meta = records.prefiltered(spark.read.parquet(f"{path}/metadata"), species, list(drugs))
    s = spark.read.parquet(f"{path}/stage={stage or 'preprocessed'}")
    if year is not None:
        meta, s = meta.where(F.col("year") == year), s.where(F.col("year") == year)
    if id_transform is not None:
        meta, s = (df.withColumn("spectrum_id", id_transform(F.col("spectrum_id"))) for df in (meta, s))
    out = SpectrumSet(s.drop("year").join(meta.select("spectrum_id").distinct(), "spectrum_id", "left_semi"), meta, drugs, species)
    out = then(out) if then else out
    return out.averaged() if average else out


def load_layout(spark: SparkSession, layout, species: str | None = None, drugs: list[str] = (), average: bool = False, then: Callable[[SpectrumSet], SpectrumSet] | None = None) -> SpectrumSet:
    """A set from any layout with ``metadata`` and ``spectra``: metadata filtered first, spectra only of ids that are left."""
    meta = records.prefiltered(layout.metadata(spark), species, list(drugs))
    s = layout.spectra(spark).where(F.size("mz") > 0).join(meta.select("spectrum_id").distinct(), "spectrum_id", "left_semi")
    out = SpectrumSet(s.select("spectrum_id", "mz", "intensity"), meta, drugs, species)
    out = then(out) if then else out
    return out.averaged() if average else out


def from_bin_index(spectra: DataFrame, low: float = 2000.0, high: float = 20000.0) -> DataFrame:
    """Arrays whose mz are bin numbers 0..N-1 get the m/z of their bins; others are unchanged."""
    n = F.size("mz")
    numbered = (n > 1) & F.forall(F.transform("mz", lambda v, i: v == i), lambda b: b) & (F.get("mz", F.lit(0)) <= low / 2)
    step = F.try_divide(F.lit(high - low), n - 1)
    return spectra.withColumn("mz", F.when(numbered, F.transform("mz", lambda v: F.lit(low) + v * step)).otherwise(F.col("mz")))
