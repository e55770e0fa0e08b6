"""Noise mechanisms on numbers, series and columns."""

from __future__ import annotations

import math
import secrets
from enum import Enum
from fractions import Fraction
from statistics import NormalDist
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from quietframe.functions import batches, samplers
from quietframe.functions.distributions import discrete_gaussian_inverse_cmf, double_sided_geometric_inverse_cmf
from quietframe.functions.exact import INFINITY, ExactNumber, ExactNumberInput, validate_exact_number
from quietframe.operators.grouped import named
from quietframe.plans.core import Measurement
from quietframe.plans.domains import NumpyFloatDomain, NumpyIntegerDomain, PandasSeriesDomain, SparkDataFrameDomain
from quietframe.plans.errors import UnsupportedDomainError, UnsupportedMeasureError
from quietframe.plans.measures import Measure, PureDP, RhoZCDP
from quietframe.plans.metrics import AbsoluteDifference, OnColumn, RootSumOfSquared, SumOf
from quietframe.sources.shared import sanitized


class NoiseMechanism(Enum):
    """Kinds of noise."""

    LAPLACE = 1
    GEOMETRIC = 2
    DISCRETE_GAUSSIAN = 3
    GAUSSIAN = 4

    @property
    def integral(self) -> bool:
        return self in (NoiseMechanism.GEOMETRIC, NoiseMechanism.DISCRETE_GAUSSIAN)

    @property
    def gaussian(self) -> bool:
        return self in (NoiseMechanism.GAUSSIAN, NoiseMechanism.DISCRETE_GAUSSIAN)

    def supported_output_measure(self) -> list[Measure]:
        """Measures that releases with this noise may have; Gaussian kinds have no pure guarantee."""
        return [RhoZCDP()] if self.gaussian else [PureDP(), RhoZCDP()]

    def check_output_measure(self, output_measure: Measure) -> None:
        """Raise UnsupportedMeasureError for any other measure."""
        if output_measure not in self.supported_output_measure():
            raise UnsupportedMeasureError(output_measure, f"{self.name} noise has a guarantee in {self.supported_output_measure()} only.")


def calculate_noise_scale(d_in: ExactNumberInput, d_out: ExactNumberInput, output_measure: Measure) -> ExactNumber:
    """Scale at which noise for inputs d_in apart loses d_out: d/epsilon, or d/sqrt(2 rho) (the standard deviation of Gaussian noise)."""
    d, loss = ExactNumber(d_in), ExactNumber(d_out)
    if not d.is_finite:
        raise ValueError("No noise hides inputs that are infinitely far apart.")
    if not isinstance(output_measure, (PureDP, RhoZCDP)):
        raise UnsupportedMeasureError(output_measure, "Noise scales are known for PureDP and RhoZCDP.")
    if loss == 0:
        return INFINITY
    if loss == INFINITY:
        return ExactNumber(0)
    return d / loss if isinstance(output_measure, PureDP) else d / (2 * loss) ** Fraction(1, 2)


def _rational(x: ExactNumber) -> Fraction:
    """The number itself, or a rational above it: noise is never too small."""
    return x.to_fraction() if x.is_rational else x.bounds(60)[1]


def draw(mechanism: NoiseMechanism, value: Any, scale: ExactNumber) -> Any:
    """One noisy value; ``scale`` is the standard deviation for Gaussian kinds."""
    if scale == 0:
        return int(value) if mechanism.integral else float(value)
    if scale == INFINITY:
        sign = 1 if secrets.randbits(1) else -1
        return sign * (2**63 - 1) if mechanism.integral else sign * math.inf
    if mechanism is NoiseMechanism.GEOMETRIC:
        return int(value) + samplers.discrete_laplace(_rational(scale))
    if mechanism is NoiseMechanism.DISCRETE_GAUSSIAN:
        return int(value) + samplers.discrete_gaussian(_rational(scale * scale))
    if mechanism is NoiseMechanism.LAPLACE:
        return samplers.laplace(float(value), scale.to_float(True)) if math.isfinite(value) else float(value)
    return samplers.gaussian(_rational(scale * scale), Fraction(float(value)))


def draw_many(mechanism: NoiseMechanism, values: np.ndarray, scale: ExactNumber) -> np.ndarray:
    """Each value with noise of its own; whole numbers stay in the range of longs, values that are not finite stay as they are."""
    if scale == 0:
        return values.astype(np.int64 if mechanism.integral else np.float64)
    if scale == INFINITY:
        out = np.array([draw(mechanism, v, scale) for v in values.tolist()], dtype=object if mechanism.integral else np.float64)
    elif mechanism.integral:
        noise = batches.discrete_laplace(_rational(scale), len(values)) if mechanism is NoiseMechanism.GEOMETRIC else batches.discrete_gaussian(_rational(scale * scale), len(values))
        if values.dtype == np.int64 == noise.dtype and all(len(x) == 0 or (x.min() >= -(2**62) and x.max() < 2**62) for x in (values, noise)):
            return values + noise
        out = values.astype(object) + noise.astype(object)
    else:
        out = values.astype(np.float64)
        finite = np.isfinite(out)
        out[finite] = batches.laplace(out[finite], scale.to_float(True)) if mechanism is NoiseMechanism.LAPLACE else batches.gaussian(out[finite], _rational(scale * scale))
    if mechanism.integral:
        return np.clip(out, -(2**63), 2**63 - 1).astype(np.int64)
    return out


class _Mechanism(Measurement):
    """A number plus noise."""

    kind = NoiseMechanism.LAPLACE
    measure: type = PureDP

    def __init__(self, input_domain, noise: ExactNumberInput):
        validate_exact_number(noise, minimum=0)
        super().__init__(input_domain, AbsoluteDifference(), self.measure())
        self._noise = ExactNumber(noise)

    @property
    def output_type(self):
        return LongType() if self.kind.integral else DoubleType()

    @property
    def adds_no_noise(self) -> bool:
        return self._noise == 0

    @classmethod
    def inverse_cdf(cls, noise: float, probability: float) -> float:
        """The value that noise of this scale (or variance) does not exceed with the given probability, for Laplace noise and by kind."""
        if not 0 < probability < 1:
            raise ValueError("The probability has to lie between 0 and 1.")
        kinds = {
            NoiseMechanism.LAPLACE: lambda: math.copysign(-noise * math.log1p(-2 * abs(probability - 0.5)), probability - 0.5), NoiseMechanism.GAUSSIAN: lambda: NormalDist(0, math.sqrt(noise)).inv_cdf(probability),
            NoiseMechanism.GEOMETRIC: lambda: double_sided_geometric_inverse_cmf(probability, noise), NoiseMechanism.DISCRETE_GAUSSIAN: lambda: discrete_gaussian_inverse_cmf(probability, noise),
        }
        return float(kinds[cls.kind]()) if noise else 0.0

    @property
    def standard(self) -> ExactNumber:
        """The scale, or the standard deviation."""
        return ExactNumber.sqrt(self._noise) if self.kind.gaussian else self._noise

    def privacy_function(self, d_in):
        self.input_metric.validate(d_in)
        d = ExactNumber(d_in)
        if self._noise == 0:
            return INFINITY if d != 0 else ExactNumber(0)
        if self._noise == INFINITY:
            return ExactNumber(0)
        return d * d / (2 * self._noise) if self.kind.gaussian else d / self._noise

    def __call__(self, value):
        out = draw(self.kind, value, self.standard)
        return max(-(2**63), min(2**63 - 1, out)) if self.kind.integral else out


def _number_domain(domain) -> None:
    if not isinstance(domain, (NumpyIntegerDomain, NumpyFloatDomain)):
        raise UnsupportedDomainError(domain, "The domain has to be of numbers.")


class AddLaplaceNoise(_Mechanism):
    """Laplace noise on an integer or a float."""

    def __init__(self, input_domain, scale: ExactNumberInput):
        _number_domain(input_domain)
        super().__init__(input_domain, scale)

    scale = property(lambda self: self._noise)


class AddGeometricNoise(_Mechanism):
    """Two-sided geometric noise on an integer."""

    kind = NoiseMechanism.GEOMETRIC

    def __init__(self, alpha: ExactNumberInput):
        super().__init__(NumpyIntegerDomain(), alpha)

    alpha = property(lambda self: self._noise)


class AddDiscreteGaussianNoise(_Mechanism):
    """Discrete Gaussian noise on an integer."""

    kind, measure = NoiseMechanism.DISCRETE_GAUSSIAN, RhoZCDP

    def __init__(self, sigma_squared: ExactNumberInput):
        super().__init__(NumpyIntegerDomain(), sigma_squared)

    sigma_squared = property(lambda self: self._noise)


class AddGaussianNoise(_Mechanism):
    """Gaussian noise on an integer or a float."""

    kind, measure = NoiseMechanism.GAUSSIAN, RhoZCDP

    def __init__(self, input_domain, sigma_squared: ExactNumberInput):
        _number_domain(input_domain)
        super().__init__(input_domain, sigma_squared)

    sigma_squared = property(lambda self: self._noise)


class AddNoiseToSeries(Measurement):
    """A mechanism on every number of a series."""

    def __init__(self, noise_measurement: _Mechanism):
        aggregate = RootSumOfSquared if isinstance(noise_measurement.output_measure, RhoZCDP) else SumOf
        super().__init__(PandasSeriesDomain(noise_measurement.input_domain), aggregate(AbsoluteDifference()), noise_measurement.output_measure)
        self._noise_measurement = noise_measurement

    noise_measurement = property(lambda self: self._noise_measurement)
    output_type = property(lambda self: self._noise_measurement.output_type)

    def privacy_function(self, d_in):
        return self._noise_measurement.privacy_function(d_in)

    def __call__(self, values: pd.Series) -> pd.Series:
        m = self._noise_measurement
        return pd.Series(draw_many(m.kind, values.to_numpy(), m.standard))


def noisy(column: Column, mechanism: NoiseMechanism, scale: ExactNumber) -> Column:
    """The column with fresh noise in each row; none is drawn at scale 0.

    The function is marked nondeterministic, so that the optimiser neither repeats
    nor moves it; ``sanitized`` then evaluates it once.
    """
    kind = LongType() if mechanism.integral else DoubleType()
    if scale == 0:
        return column.cast(kind)

    @F.pandas_udf(kind)
    def add(values: pd.Series) -> pd.Series:
        return pd.Series(draw_many(mechanism, values.to_numpy(), scale))

    return add.asNondeterministic()(column.cast(kind))


class SparkMeasurement(Measurement):
    """A measurement whose answer is a table: what ``call`` gives is evaluated once, in random order, before anyone can read it."""

    def call(self, val: Any) -> DataFrame:
        """The answer as a plan."""
        raise NotImplementedError

    def __call__(self, val: Any) -> DataFrame:
        return sanitized(self.call(val))


class AddNoiseToColumn(SparkMeasurement):
    """Noise on one column of a table; the result is a release."""

    def __init__(self, input_domain: SparkDataFrameDomain, measurement: AddNoiseToSeries, measure_column: str):
        descriptor = input_domain[measure_column]
        if descriptor.to_numpy_domain() != measurement.input_domain.element_domain:
            raise UnsupportedDomainError(input_domain, f"The noise does not take column '{measure_column}'.")
        super().__init__(input_domain, OnColumn(measure_column, measurement.input_metric), measurement.output_measure)
        self._measurement, self._measure_column = measurement, measure_column

    measurement = property(lambda self: self._measurement)
    measure_column = property(lambda self: self._measure_column)

    def privacy_function(self, d_in):
        self.input_metric.validate(d_in)
        return self._measurement.privacy_function(d_in)

    def call(self, val: DataFrame) -> DataFrame:
        m = self._measurement.noise_measurement
        return val.select(*[noisy(named(c), m.kind, m.standard).alias(c) if c == self._measure_column else named(c) for c in val.columns])


def noisy_number(value: Any, mechanism: NoiseMechanism, scale: ExactNumber) -> np.generic:
    out = draw(mechanism, value, scale)
    return np.int64(max(-(2**63), min(2**63 - 1, out))) if mechanism.integral else np.float64(out)
