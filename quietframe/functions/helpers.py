"""Small helpers of plans."""

from __future__ import annotations

import copy
import datetime
from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction
from typing import Any, NoReturn

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType

#: Types whose values are shared, not copied: nobody can change them, or Spark holds them.
FROZEN = (bool, int, float, complex, str, bytes, type(None), tuple, frozenset, Fraction, Decimal, datetime.date, datetime.timedelta, DataFrame, DataType, type)


def get_immutable_types() -> tuple[type, ...]:
    from quietframe.functions.exact import ExactNumber

    return (*FROZEN, ExactNumber)


def copy_if_mutable(value: Any) -> Any:
    """The value, or a copy that changes of the original do not reach."""
    if isinstance(value, get_immutable_types()) or callable(value):
        return value
    if isinstance(value, dict):
        return {k: copy_if_mutable(v) for k, v in value.items()}
    if isinstance(value, list):
        return [copy_if_mutable(v) for v in value]
    return copy.copy(value)


def get_fullname(obj: Any) -> str:
    """Module and name of a class, or of an object's class."""
    kind = obj if isinstance(obj, type) else type(obj)
    return kind.__qualname__ if kind.__module__ == "builtins" else f"{kind.__module__}.{kind.__qualname__}"


def assert_never(x: NoReturn) -> NoReturn:
    """For branches that no value reaches."""
    raise AssertionError(f"Unexpected value: {x!r}")


def get_element_type(values: Sequence[Any], allow_none: bool = True) -> type:
    """The one type of the elements; None counts as any if it is allowed."""
    kinds = {type(v) for v in values if not (allow_none and v is None)}
    if len(kinds) > 1:
        raise ValueError(f"Elements have several types: {sorted(k.__name__ for k in kinds)}")
    return next(iter(kinds), type(None))
