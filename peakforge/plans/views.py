"""Views all queries share: peaks, the binned matrix, records and labels, each as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.operators import replicates, susceptibility
from peakforge.sources.tables import table

#: m/z of the first bin and width of the bins of ``maldiset.x``.
START, WIDTH, BINS = 2000.0, 75.0, 240
#: MIC above which a row counts as resistant in the cohort queries.
RESISTANT_ABOVE = 4.0


def peaks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "peak_set", "spectrum_no", "mz", "intensity").where("mz is not null and intensity is not null")


def points(spark: SparkSession, d: str) -> DataFrame:
    return peaks(spark, d).select("spectrum_no", F.posexplode(F.arrays_zip("mz", "intensity")).alias("pos", "p")).select("spectrum_no", "pos", "p.mz", "p.intensity")


def spectra(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "maldiset", "spectrum_no", "id", "instrument", "acquired_at", "x").where("x is not null")
    return x.withColumn("x", F.transform("x", lambda v: v.cast("double")))


def matrix(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spectra(spark, d).select("spectrum_no", *more, F.posexplode("x").alias("bin_index", "intensity"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """metadata with one row per id, the first loaded."""
    return replicates.resolve_duplicates(table(spark, d, "metadata").where("id is not null"), "id", ["row_no"], "first")


def labels(spark: SparkSession, d: str) -> DataFrame:
    """(spectrum_no, y): 1 above the MIC limit, 0 at or below; spectra without MIC are left out."""
    r = records(spark, d).select("id", susceptibility.mic_value(F.col("mic")).alias("v")).where("v is not null")
    return table(spark, d, "maldiset", "spectrum_no", "id").join(r, "id").select("spectrum_no", (F.col("v") > RESISTANT_ABOVE).cast("int").alias("y"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


MIC = r"'^\s*([<>]=?|=)?\s*([0-9]+[,.]?[0-9]*)\s*$'"
WITH = rf"""WITH peaks AS (SELECT spectrum_no, mz, intensity FROM peak_set WHERE mz IS NOT NULL AND intensity IS NOT NULL),
points AS (SELECT spectrum_no, CAST(generate_subscripts(mz, 1) - 1 AS INTEGER) AS pos, unnest(mz) AS mz, unnest(intensity) AS intensity FROM peaks),
spectra AS (SELECT spectrum_no, id, instrument, acquired_at, CAST(x AS DOUBLE[]) AS x FROM maldiset WHERE x IS NOT NULL),
matrix AS (SELECT spectrum_no, id, instrument, acquired_at, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS bin_index, unnest(x) AS intensity FROM spectra),
records AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no) AS rn FROM metadata WHERE id IS NOT NULL) WHERE rn = 1),
mics AS (SELECT *, CASE WHEN regexp_matches(mic, {MIC}) THEN CAST(replace(regexp_extract(mic, {MIC}, 2), ',', '.') AS DOUBLE) END AS mic_value FROM metadata),
labels AS (SELECT m.spectrum_no, CAST(v > {RESISTANT_ABOVE} AS INTEGER) AS y FROM maldiset m JOIN (SELECT id, CAST(replace(regexp_extract(mic, {MIC}, 2), ',', '.') AS DOUBLE) AS v FROM records WHERE regexp_matches(mic, {MIC})) r ON m.id = r.id)
"""


def sql(body: str, *doubles: str, ctes: str = "", digits: int = 6) -> str:
    """The query over the shared views, named columns rounded like ``rounded`` does."""
    replace = f" REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in doubles)})" if doubles else ""
    return f"{WITH}{', ' + ctes if ctes else ''} SELECT *{replace} FROM ({body})"
