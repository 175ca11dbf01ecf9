"""Error rates as evaluators for model selection."""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame

from peakforge.operators.evaluation import report

RATES = ("vme", "me", "sensitivity", "specificity", "agreement")


class RateEvaluator(Evaluator):
    """A rate of :func:`evaluation.report` over labels and predictions of 0 and 1; smaller is better for the error rates vme and me."""

    def __init__(self, rate: str = "vme", labelCol: str = "label", predictionCol: str = "prediction") -> None:
        super().__init__()
        if rate not in RATES:
            raise ValueError(f"unknown rate {rate}; known: {', '.join(RATES)}")
        self.rate, self.label, self.prediction = rate, labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(report(dataset, self.label, self.prediction).first()[self.rate] or 0.0)

    def isLargerBetter(self) -> bool:
        return self.rate not in ("vme", "me")


def very_major() -> RateEvaluator:
    return RateEvaluator("vme")


def major() -> RateEvaluator:
    return RateEvaluator("me")
