"""Errors of plans; each keeps the objects that do not fit."""

from __future__ import annotations


class _Kept:
    """Keeps the constructor's named values as attributes."""

    _names: tuple[str, ...] = ()

    def __init__(self, *values, **named):
        values = dict(zip((*self._names, "msg"), values)) | named
        for name in self._names:
            setattr(self, name, values.get(name))
        super().__init__(values.get("msg", ""))


class OutOfDomainError(_Kept, Exception):
    """A value is not in a domain."""

    _names = ("domain", "value")


class DomainMismatchError(_Kept, ValueError):
    """Domains that have to agree differ."""

    _names = ("domains",)


class UnsupportedDomainError(_Kept, TypeError):
    """An operator does not take this domain."""

    _names = ("domain",)


class DomainKeyError(_Kept, Exception):
    """A dictionary domain has no such key."""

    _names = ("domain", "key")


class DomainColumnError(_Kept, Exception):
    """A table domain has no such column, or none of the kind asked for."""

    _names = ("domain", "column")


class UnsupportedMetricError(_Kept, ValueError):
    """An operator does not take this metric."""

    _names = ("metric",)


class MetricMismatchError(_Kept, ValueError):
    """Metrics that have to agree differ."""

    _names = ("metrics",)


class UnsupportedCombinationError(_Kept, ValueError):
    """Values that are legal alone are not legal together."""

    _names = ("combination",)


class UnsupportedMeasureError(_Kept, ValueError):
    """An operator does not take this measure."""

    _names = ("measure",)


class MeasureMismatchError(_Kept, ValueError):
    """Measures that have to agree differ."""

    _names = ("measures",)


class UnsupportedNoiseMechanismError(_Kept, ValueError):
    """The noise mechanism cannot give this guarantee."""

    _names = ("noise_mechanism",)


class UnsupportedExpressionError(_Kept, ValueError):
    """A text is not an exact number."""

    _names = ("expr",)


UnsupportedSympyExprError = UnsupportedExpressionError


class InsufficientBudgetError(_Kept, ValueError):
    """A query asks for more than is left."""

    _names = ("remaining_budget", "requested_budget")


class InactiveAccountantError(RuntimeError):
    """An accountant was used while another one is active, or after it retired."""
