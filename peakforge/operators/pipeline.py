"""Preprocessing pipelines: named steps, stored as dict, JSON or YAML, run as few Spark stages as possible.

Steps that built-in expressions can state become projections; neighbouring kernel steps are fused into one Arrow stage.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.functions import kernels
from peakforge.operators import transforms


@dataclass(frozen=True)
class Step:
    """A step is a projection (``columns``) or a kernel on (mz, intensity) arrays (``kernel``)."""

    def columns(self, df: DataFrame) -> DataFrame | None:
        return None

    def kernel(self, mz: np.ndarray, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def to_dict(self) -> dict:
        return {"step": type(self).__name__, **asdict(self)}


@dataclass(frozen=True)
class ClipNegatives(Step):
    def columns(self, df):
        return df.withColumn("intensity", transforms.clip_negatives(F.col("intensity")))


@dataclass(frozen=True)
class SqrtTransform(Step):
    def columns(self, df):
        return df.withColumn("intensity", transforms.sqrt(F.col("intensity")))


@dataclass(frozen=True)
class LogTransform(Step):
    def columns(self, df):
        return df.withColumn("intensity", transforms.log1p(F.col("intensity")))


@dataclass(frozen=True)
class TicNormalizer(Step):
    def columns(self, df):
        return df.withColumn("intensity", transforms.tic(F.col("intensity")))


@dataclass(frozen=True)
class MedianNormalizer(Step):
    def columns(self, df):
        return df.withColumn("intensity", transforms.median_normalised(F.col("intensity")))


@dataclass(frozen=True)
class PqnNormalizer(Step):
    reference: list[float] | None = None

    def columns(self, df):
        if self.reference is None:
            return df.withColumn("intensity", transforms.tic(F.col("intensity")))
        return df.withColumn("intensity", transforms.pqn(F.col("intensity"), F.array(*[F.lit(float(v)) for v in self.reference])))


@dataclass(frozen=True)
class MovingAverage(Step):
    window: int = 5

    def kernel(self, mz, x):
        return kernels.moving_average(x, self.window)


@dataclass(frozen=True)
class TopHatBaseline(Step):
    half: int = 100

    def kernel(self, mz, x):
        return kernels.top_hat(x, self.half)


def _kept(df: DataFrame, points) -> DataFrame:
    cut = df.withColumn("_p", points(F.arrays_zip("mz", "intensity")))
    return cut.withColumn("mz", F.transform("_p", lambda p: p["mz"])).withColumn("intensity", F.transform("_p", lambda p: p["intensity"])).drop("_p")


@dataclass(frozen=True)
class MzTrimmer(Step):
    low: float = 2000.0
    high: float = 20000.0

    def columns(self, df):
        return _kept(df, lambda p: transforms.trim(p, self.low, self.high))


@dataclass(frozen=True)
class MzMultiTrimmer(Step):
    ranges: list = field(default_factory=list)

    def columns(self, df):
        return _kept(df, lambda p: transforms.trim_ranges(p, [tuple(r) for r in self.ranges]))


@dataclass(frozen=True)
class SavitzkyGolaySmooth(Step):
    window: int = 21
    order: int = 2

    def kernel(self, mz, x):
        return kernels.savitzky_golay(x, self.window, self.order)


@dataclass(frozen=True)
class SnipBaseline(Step):
    half: int = 40

    def kernel(self, mz, x):
        return np.maximum(x - kernels.snip_baseline(x, self.half), 0.0)


@dataclass(frozen=True)
class ConvexHullBaseline(Step):
    def kernel(self, mz, x):
        return np.maximum(x - kernels.hull_baseline(mz, x), 0.0)


@dataclass(frozen=True)
class MedianBaseline(Step):
    half: int = 100
    iterations: int = 1

    def kernel(self, mz, x):
        return np.maximum(x - kernels.median_baseline(x, self.half, self.iterations), 0.0)


STEPS: dict[str, Callable[..., Step]] = {
    c.__name__: c
    for c in (ClipNegatives, SqrtTransform, LogTransform, TicNormalizer, MedianNormalizer, PqnNormalizer, MovingAverage, TopHatBaseline, MzTrimmer, MzMultiTrimmer, SavitzkyGolaySmooth, SnipBaseline, ConvexHullBaseline, MedianBaseline)
}


class Pipeline:
    """An ordered list of (name, step)."""

    def __init__(self, steps: list[tuple[str, Step]]) -> None:
        self.steps = list(steps)

    @classmethod
    def default(cls) -> Pipeline:
        return cls([
            ("clip", ClipNegatives()), ("sqrt", SqrtTransform()), ("smooth", SavitzkyGolaySmooth(21, 2)), ("baseline", SnipBaseline(40)),
            ("trim", MzTrimmer(2000.0, 20000.0)), ("tic", TicNormalizer()),
        ])

    @property
    def step_names(self) -> list[str]:
        return [n for n, _ in self.steps]

    def get_step(self, name: str) -> Step:
        for n, s in self.steps:
            if n == name:
                return s
        raise KeyError(f"no step {name}; steps: {', '.join(self.step_names)}")

    @property
    def mz_range(self) -> tuple[float, float]:
        trim = next((s for _, s in self.steps if isinstance(s, MzTrimmer)), MzTrimmer())
        return trim.low, trim.high

    def run(self, spectra: DataFrame, key: str = "spectrum_no") -> DataFrame:
        """(key, mz, intensity) after all steps. Rows whose arrays are null or empty pass through kernels unchanged."""
        df = spectra.select(key, "mz", "intensity")
        pending: list[Step] = []

        def flush(df: DataFrame) -> DataFrame:
            if not pending:
                return df
            todo, kind = list(pending), dict(df.dtypes)[key]
            pending.clear()

            def apply(frames):
                for f in frames:
                    out = []
                    for m, x in zip(f["mz"], f["intensity"]):
                        if x is not None and len(x):
                            m, x = np.asarray(m, float), np.asarray(x, float)
                            for s in todo:
                                x = s.kernel(m, x)
                        out.append(x)
                    yield pd.DataFrame({key: f[key], "mz": f["mz"], "intensity": out})

            return df.mapInPandas(apply, f"{key} {kind}, mz array<double>, intensity array<double>")

        for _, s in self.steps:
            if type(s).columns is Step.columns:
                pending.append(s)
            else:
                df = s.columns(flush(df))
        return flush(df)

    def to_dict(self) -> dict:
        return {"steps": [{"name": n, **s.to_dict()} for n, s in self.steps]}

    @classmethod
    def from_dict(cls, d: dict) -> Pipeline:
        steps = []
        for item in d["steps"]:
            item = dict(item)
            name, kind = item.pop("name"), item.pop("step")
            if kind not in STEPS:
                raise ValueError(f"unknown step {kind}")
            steps.append((name, STEPS[kind](**item)))
        return cls(steps)

    def save(self, path: str) -> None:
        """As JSON or, by its ending, YAML."""
        p = Path(path)
        if p.suffix in (".yaml", ".yml"):
            import yaml

            p.write_text(yaml.safe_dump(self.to_dict(), sort_keys=False))
        else:
            p.write_text(json.dumps(self.to_dict(), indent=2))

    @classmethod
    def load(cls, path: str) -> Pipeline:
        p = Path(path)
        if p.suffix in (".yaml", ".yml"):
            import yaml

            return cls.from_dict(yaml.safe_load(p.read_text()))
        return cls.from_dict(json.loads(p.read_text()))
