"""Mechanisms whose loss depends on the record, on columns of tables.

Each adds noise to a transformed value of every row.  Noise is drawn in batches
(``functions.batches``); the functions are marked nondeterministic, so that a
release evaluates them once.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quietframe.functions import batches


def _of_values(f: Callable[[np.ndarray], np.ndarray], column: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def apply(values: pd.Series) -> pd.Series:
        return pd.Series(f(values.to_numpy(np.float64)))

    return apply.asNondeterministic()(column.cast("double"))


def _gaussian(n: int, sigma: float) -> np.ndarray:
    return batches.gaussian(np.zeros(n), Fraction(sigma) ** 2) if sigma else np.zeros(n)


def _shifted(x: np.ndarray, offset: float, positive: bool = False) -> np.ndarray:
    out = x + offset
    if (out < 0).any() or (positive and (out == 0).any()):
        raise ValueError(f"The value plus the offset has to be {'positive' if positive else 'at least zero'}.")
    return out


def fourth_root_transformation(column: Column, offset: float, sigma: float) -> Column:
    """(fourth root of (value + offset) plus Gaussian noise) to the fourth, less the offset."""
    return _of_values(lambda x: (_shifted(x, offset) ** 0.25 + _gaussian(len(x), sigma)) ** 4 - offset, column)


def square_root_transformation(column: Column, offset: float, sigma: float) -> Column:
    """(square root of (value + offset) plus Gaussian noise) squared, less the offset."""
    return _of_values(lambda x: (np.sqrt(_shifted(x, offset)) + _gaussian(len(x), sigma)) ** 2 - offset, column)


def log_transformation(column: Column, offset: float, sigma: float) -> Column:
    """exp(ln(value + offset) plus Gaussian noise), less the offset."""
    return _of_values(lambda x: np.exp(np.log(_shifted(x, offset, True)) + _gaussian(len(x), sigma)) - offset, column)


def square_root_gaussian(column: Column, sigma: float) -> Column:
    """The value plus noise of the density proportional to exp(-sqrt(|x| / sigma))."""
    return _of_values(lambda x: x + batches.square_root_gaussian(len(x), sigma), column)


def exponential_polylogarithmic(column: Column, d: float, a: float, sigma: float) -> Column:
    """The value plus noise of the density proportional to exp(-d ln(|x| / sigma + a)**2)."""
    return _of_values(lambda x: x + batches.exponential_polylogarithmic(len(x), d, a, sigma), column)
