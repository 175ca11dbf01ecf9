"""Command line: preprocess, quality, build. Run with spark-submit or python -m peakforge.cli."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from peakforge.operators import binning, quality
from peakforge.operators.pipeline import Pipeline
from peakforge.sources import dataset, text

MOST_CONFIG_BYTES = 1_000_000


def _pipeline(path: str | None) -> Pipeline:
    return Pipeline.load(path) if path else Pipeline.default()


def _outputs(path: str | None) -> list[dataset.Output]:
    """Further outputs from a JSON or YAML list of {name, pipeline, bin_width}; pipeline paths are relative to the list."""
    if not path:
        return []
    p = Path(path)
    if p.stat().st_size > MOST_CONFIG_BYTES:
        raise ValueError("configuration is too large")
    if p.suffix in (".yaml", ".yml"):
        import yaml

        items = yaml.safe_load(p.read_text())
    else:
        items = json.loads(p.read_text())
    return [dataset.Output(i["name"], _pipeline(str(p.parent / i["pipeline"]) if i.get("pipeline") else None), i.get("bin_width")) for i in items]


def preprocess(spark: SparkSession, a: argparse.Namespace) -> int:
    s = text.read_spectra(spark, a.input)
    bad = text.failed(s).count()
    good = s.where(F.size("mz") > 0)
    n = good.count()
    if n == 0:
        print("no readable spectrum", file=sys.stderr)
        return 1
    pipe = _pipeline(a.pipeline)
    done = pipe.run(good, "spectrum_id")
    low, high = pipe.mz_range
    edges = binning.edges_of(a.method, low, high, a.bin_width)
    p = done.select("spectrum_id", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("spectrum_id", "p.mz", "p.intensity")
    m = binning.bin_points(p, binning.edge_bin(F.col("mz"), edges) if a.method != "uniform" else binning.uniform_bin(F.col("mz"), low, a.bin_width, len(edges) - 1), len(edges) - 1, "spectrum_id")
    if a.format == "csv":
        rows = m.groupBy("spectrum_id").agg(F.array_sort(F.collect_list(F.struct("bin_index", "intensity"))).alias("b"))
        rows.select("spectrum_id", *[F.get("b", F.lit(i))["intensity"].alias(str(e)) for i, e in enumerate(edges[:-1])]).write.mode("overwrite").option("header", True).csv(a.output)
    else:
        m.write.mode("overwrite").parquet(a.output)
    if a.save_spectra_dir:
        dataset.SpectrumSet(done, done.select("spectrum_id")).save_spectra(a.save_spectra_dir)
    print(f"{n} spectra, {bad} failed")
    return 0


def report(spark: SparkSession, a: argparse.Namespace) -> int:
    s = text.read_spectra(spark, a.input).where(F.size("mz") > 0)
    quality.full_report(s, "spectrum_id").write.mode("overwrite").option("header", True).csv(a.output)
    return 0


def build(spark: SparkSession, a: argparse.Namespace) -> int:
    kind = {"flat": dataset.FlatLayout, "instrument": dataset.InstrumentLayout}[a.layout]
    layout = kind(a.spectra, a.metadata, a.id_column, a.year_column)
    done = dataset.build(spark, layout, a.output, a.name, _pipeline(a.pipeline), a.bin_width, _outputs(a.extra_outputs), a.on_error)
    print(json.dumps({k: done[k] for k in ("n_spectra", "n_failed", "stages")}))
    return 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="peakforge")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("preprocess", help="text spectra to a binned matrix")
    c.add_argument("-i", "--input", required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-b", "--bin-width", type=float, default=3.0)
    c.add_argument("--method", default="uniform")
    c.add_argument("--format", choices=("parquet", "csv"), default="parquet", help="long table, or one column per bin")
    c.add_argument("--save-spectra-dir", help="folder for the preprocessed spectra")
    c.add_argument("-p", "--pipeline")
    c.set_defaults(run=preprocess)
    c = sub.add_parser("quality", help="quality report of raw text spectra")
    c.add_argument("-i", "--input", required=True)
    c.add_argument("-o", "--output", required=True)
    c.set_defaults(run=report)
    c = sub.add_parser("build", help="dataset by stage and year")
    c.add_argument("-s", "--spectra", required=True)
    c.add_argument("-m", "--metadata", required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-l", "--layout", choices=("flat", "instrument"), default="flat")
    c.add_argument("-n", "--name", default="dataset")
    c.add_argument("--id-column")
    c.add_argument("--year-column")
    c.add_argument("-b", "--bin-width", type=float, default=3.0)
    c.add_argument("-p", "--pipeline")
    c.add_argument("--extra-outputs")
    c.add_argument("--on-error", choices=("warn", "raise"), default="warn")
    c.set_defaults(run=build)
    a = p.parse_args(args)
    return a.run(SparkSession.builder.appName("peakforge").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
