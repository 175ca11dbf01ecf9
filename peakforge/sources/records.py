"""Metadata tables, breakpoint tables and manifests."""

from __future__ import annotations

import datetime
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1


def id_column(columns: list[str]) -> str:
    """``code``, else ``ID``, else the first column."""
    return next((c for c in ("code", "ID") if c in columns), columns[0])


def species_column(columns: list[str]) -> str | None:
    return next((c for c in columns if c.lower() == "species"), None)


def year_of(value: Column) -> Column:
    """Four digits at the start, alone or before ``-`` or ``/``; null otherwise."""
    return F.regexp_extract(value.cast("string"), r"^(\d{4})(?:[-/]|$)", 1).try_cast("int")


def read_metadata(spark: SparkSession, path: str, year_folders: bool = False) -> DataFrame:
    """CSV files as text columns. With ``year_folders`` the table is read from folders named by year, with different columns united."""
    if not year_folders:
        return spark.read.option("header", True).csv(path)
    base = Path(path)
    parts = []
    for folder in sorted(p for p in base.iterdir() if p.is_dir() and p.name.isdigit() and len(p.name) == 4):
        for csv in sorted(folder.glob("*.csv")):
            parts.append(spark.read.option("header", True).csv(str(csv)).withColumn("year", F.lit(int(folder.name))))
    if not parts:
        raise FileNotFoundError(f"no metadata in year folders of {path}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def prefiltered(meta: DataFrame, one_species: str | None, drugs: list[str]) -> DataFrame:
    """Rows of the species with a value for any of the drugs; both reach the scan."""
    c = species_column(meta.columns)
    if one_species is not None and c is not None:
        meta = meta.where(F.col(c) == one_species)
    known = [d for d in drugs if d in meta.columns]
    return meta.where(F.coalesce(*known).isNotNull()) if known else meta


def _version(text: str) -> tuple:
    return tuple(int(p) if p.isdigit() else 0 for p in str(text).split("."))


def breakpoint_files(folder: str) -> list[dict]:
    """{path, version, year} of all YAML tables, in numeric order of versions."""
    import yaml

    found = []
    for p in Path(folder).glob("*.y*ml"):
        d = yaml.safe_load(p.read_text())
        found.append({"path": str(p), "version": str(d.get("version", p.stem)), "year": d.get("year")})
    return sorted(found, key=lambda f: _version(f["version"]))


def read_breakpoints(spark: SparkSession, path: str, version: str | None = None, year: int | None = None) -> DataFrame:
    """Breakpoint table of a YAML file, or of a folder the one of a version, of a year (its highest version) or the latest.

    Rows need species, drug, s_le and r_gt with s_le <= r_gt; anything else is an error.
    """
    import yaml

    if Path(path).is_dir():
        files = breakpoint_files(path)
        if version is not None:
            files = [f for f in files if f["version"] == str(version)]
        if year is not None:
            files = [f for f in files if f["year"] == year]
        if not files:
            raise ValueError("no such breakpoint table")
        path = files[-1]["path"]
    d = yaml.safe_load(Path(path).read_text())
    rows = []
    number = lambda v: None if v is None else float(v)
    for i, r in enumerate(d.get("breakpoints") or d.get("rows") or []):
        lacking = [k for k in ("species", "drug", "s_le", "r_gt") if r.get(k) is None]
        if lacking:
            raise ValueError(f"row {i} lacks {', '.join(lacking)}")
        if float(r["s_le"]) > float(r["r_gt"]):
            raise ValueError(f"row {i}: s_le is above r_gt")
        rows.append((i, str(d.get("guideline", "")), str(d.get("version", "")), d.get("year"), str(d.get("source", "")), str(r["species"]).strip(), str(r["drug"]).strip(), float(r["s_le"]), float(r["r_gt"]), number(r.get("atu_low")), number(r.get("atu_high"))))
    return spark.createDataFrame(rows, "row_no bigint, guideline string, version string, year int, source string, species string, drug string, s_le double, r_gt double, atu_low double, atu_high double")


def _manifest(folder: str):
    """(file system, path) of the manifest, on whatever file system the folder lies."""
    spark = SparkSession.builder.getOrCreate()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/site_info.json")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def write_manifest(folder: str, info: dict) -> None:
    """``site_info.json`` with the format version and the time of writing."""
    body = {"format_version": FORMAT, "written_at": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), **info}
    fs, path = _manifest(folder)
    out = fs.create(path, True)
    try:
        out.write(bytearray(json.dumps(body, indent=2).encode()))
    finally:
        out.close()


def read_manifest(folder: str, missing_ok: bool = True) -> dict | None:
    """The manifest, also of newer versions; lacking keys are an error, a lacking file only if not ``missing_ok``."""
    fs, path = _manifest(folder)
    if not fs.exists(path):
        if missing_ok:
            return None
        raise FileNotFoundError(path.toString())
    stream = fs.open(path)
    try:
        d = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    for key in ("format_version", "name", "stages"):
        if key not in d:
            raise ValueError(f"manifest lacks {key}")
    return d
