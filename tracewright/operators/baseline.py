"""A length predictor that stands where a trained regressor would: least squares over one feature, fitted in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LengthLine:
    slope: float
    intercept: float

    def predict(self, x: Column) -> Column:
        return x * F.lit(self.slope) + F.lit(self.intercept)


def fit_line(train: DataFrame, y: str, x: str) -> LengthLine:
    """One row reaches the driver. No rows, or a flat feature: the mean, else 0."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    slope, intercept, mean = train.agg(F.regr_slope(a, b), F.regr_intercept(a, b), F.avg(a)).first()
    return LengthLine(0.0, mean or 0.0) if slope is None or intercept is None else LengthLine(slope, intercept)
