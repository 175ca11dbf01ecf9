"""Instrument directories: parameter file plus 32-bit binary intensities."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.functions.kernels import tof_to_mz

# The parameters that are needed, and where the intensities lie below the directory of the parameters.
NEEDED = ("TD", "DELAY", "DW", "ML1", "ML2", "ML3", "BYTORDA")
PLACES = {"1r": "pdata/1/1r", "fid": "fid"}


def parse_parameters(text: str) -> dict[str, float]:
    """Numbers of lines ``##$KEY= value``; a missing one of the needed is an error."""
    found = {}
    for key, value in re.findall(r"(?m)^##\$(\w+)=\s*(\S+)\s*$", text):
        if key in NEEDED:
            found[key] = float(value)
    missing = [k for k in NEEDED if k not in found]
    if missing:
        raise ValueError(f"parameters missing: {', '.join(missing)}")
    return found


def decode(content: bytes, parameters: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(mz, intensity): at most TD values, negatives as 0."""
    order = "<i4" if int(parameters["BYTORDA"]) == 0 else ">i4"
    x = np.frombuffer(content[: len(content) // 4 * 4], order)[: int(parameters["TD"])].astype(float)
    tof = parameters["DELAY"] + np.arange(len(x)) * parameters["DW"]
    return tof_to_mz(tof, parameters["ML1"], parameters["ML2"], parameters["ML3"]), np.maximum(x, 0.0)


def spectrum_name(directory: str, root: str) -> str:
    """Last two folder names below ``root`` that tell the target, joined: name and position."""
    parts = [p for p in directory[len(root) :].split("/") if p] if directory.startswith(root) else [p for p in directory.split("/") if p]
    return "_".join(parts[:2]) if len(parts) >= 2 else (parts[0] if parts else directory.rstrip("/").rpartition("/")[2])


def read_bruker(spark: SparkSession, root: str, source: str = "1r") -> DataFrame:
    """(spectrum_id, path, mz, intensity, content_hash, error) of every directory below ``root`` that holds acqus and intensities.

    A directory that can't be decoded has null arrays and the reason; an all-zero one is kept and can be told by its intensities.
    Equal content has equal hashes.
    """
    if source not in PLACES:
        raise ValueError("source is 1r or fid")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    acqus = files.where(F.substring_index("path", "/", -1) == "acqus").select(F.regexp_replace("path", "/acqus$", "").alias("dir"), F.col("content").cast("string").alias("acqus"))
    tail = "/" + PLACES[source]
    data = files.where(F.endswith("path", F.lit(tail))).select(F.expr(f"left(path, length(path) - {len(tail)})").alias("dir"), "content", F.sha2("content", 256).alias("content_hash"))
    base = root.split(":", 1)[-1].rstrip("/")

    def run(frames):
        for f in frames:
            rows = []
            for d, a, c, h in zip(f["dir"], f["acqus"], f["content"], f["content_hash"]):
                plain = d.split(":", 1)[-1]
                plain = "/" + plain.lstrip("/")
                try:
                    mz, x = decode(c, parse_parameters(a))
                    rows.append((spectrum_name(plain, base), d, mz, x, h, None))
                except ValueError as e:
                    rows.append((spectrum_name(plain, base), d, None, None, h, str(e)))
            yield pd.DataFrame(rows, columns=["spectrum_id", "path", "mz", "intensity", "content_hash", "error"])

    return acqus.join(data, "dir").mapInPandas(run, "spectrum_id string, path string, mz array<double>, intensity array<double>, content_hash string, error string")
