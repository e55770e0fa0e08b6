"""Questions asked one after the other: queryables, and an accountant that guards a budget."""

from __future__ import annotations

import enum
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from quietframe.functions.exact import INFINITY, ExactNumber
from quietframe.plans.core import Measurement, Transformation
from quietframe.plans.domains import Domain, ListDomain
from quietframe.plans.errors import DomainMismatchError, InactiveAccountantError, MeasureMismatchError, MetricMismatchError, UnsupportedCombinationError, UnsupportedMetricError
from quietframe.plans.measures import Measure, PrivacyBudget, RhoZCDP
from quietframe.plans.metrics import Metric, RootSumOfSquared, SumOf


class Queryable:
    """Something that answers queries."""

    def __call__(self, query: Any) -> Any:
        raise NotImplementedError

    def released(self) -> None:
        """What was written to answer from goes; there will be no more queries."""


@dataclass(frozen=True)
class MeasurementQuery:
    """Ask for a measurement; ``d_out`` is the loss to charge if the measurement cannot tell it."""

    measurement: Measurement
    d_out: Any = None


@dataclass(frozen=True)
class TransformationQuery:
    """Go on with transformed data; ``d_out`` is its distance if the transformation cannot tell it."""

    transformation: Transformation
    d_out: Any = None


@dataclass(frozen=True)
class IndexQuery:
    """Ask for a part."""

    index: int


@dataclass(frozen=True)
class RetireQuery:
    """No more queries."""


class RetirableQueryable(Queryable):
    """Answers until it is retired; what it handed out retires with it."""

    def __init__(self, queryable: Queryable):
        self._queryable, self._children, self._retired = queryable, [], False

    is_retired = property(lambda self: self._retired)

    def __call__(self, query):
        if isinstance(query, RetireQuery):
            if not self._retired:
                for child in self._children:
                    child(query)
                self._retired = True
                self._queryable.released()
            return None
        if self._retired:
            raise ValueError("The queryable is retired.")
        answer = self._queryable(query)
        if isinstance(answer, Queryable):
            answer = RetirableQueryable(answer)
            self._children.append(answer)
        return answer

    def released(self) -> None:
        self(RetireQuery())


def _charge(part: Any, d_in: Any, given: Any, function: str, relation: str, what: str) -> Any:
    """The distance or loss of a part: its own function's value, or a given one that its relation confirms."""
    if given is None:
        try:
            return getattr(part, function)(d_in)
        except NotImplementedError:
            raise ValueError(f"{what} has no {function}; d_out is needed.") from None
    if not getattr(part, relation)(d_in, given):
        raise ValueError(f"Invalid d_out: {given!r} is too small.")
    return given


class SequentialQueryable(Queryable):
    """A privacy filter: each measurement is paid from the budget, one answer is open at a time."""

    def __init__(self, input_domain: Domain, input_metric: Metric, d_in: Any, output_measure: Measure, privacy_budget: Any, data: Any):
        self._domain, self._metric, self._d_in, self._measure = input_domain, input_metric, d_in, output_measure
        self._budget, self._data = PrivacyBudget.cast(output_measure, privacy_budget), data
        self._open: RetirableQueryable | None = None

    remaining_budget = property(lambda self: self._budget)

    def __call__(self, query):
        if isinstance(query, TransformationQuery):
            t = query.transformation
            self._fits(t)
            self._d_in = _charge(t, self._d_in, query.d_out, "stability_function", "stability_relation", "The transformation")
            self._retire()
            self._data, self._domain, self._metric = t(self._data), t.output_domain, t.output_metric
            return None
        if not isinstance(query, MeasurementQuery):
            raise ValueError(f"Not a query of this queryable: {type(query).__name__}")
        m = query.measurement
        self._fits(m)
        if m.output_measure != self._measure:
            raise MeasureMismatchError((m.output_measure, self._measure), "The measurement has another measure.")
        if not m.is_interactive:
            raise ValueError("Only interactive measurements are answered; see MakeInteractive.")
        self._budget = self._budget.subtract(_charge(m, self._d_in, query.d_out, "privacy_function", "privacy_relation", "The measurement"))
        self._retire()
        self._open = RetirableQueryable(m(self._data))
        return self._open

    def _fits(self, part: Any) -> None:
        if part.input_domain != self._domain:
            raise DomainMismatchError((part.input_domain, self._domain), "The domain is another one.")
        if part.input_metric != self._metric:
            raise MetricMismatchError((part.input_metric, self._metric), "The metric is another one.")

    def _retire(self) -> None:
        if self._open is not None:
            self._open(RetireQuery())
            self._open = None


class ParallelQueryable(Queryable):
    """Gives the parts one after the other; an earlier part retires when a later one is taken."""

    def __init__(self, data: list, measurements: list[Measurement]):
        if len(data) != len(measurements):
            raise ValueError("There are as many parts as measurements.")
        self._data, self._measurements, self._next, self._open = data, list(measurements), 0, None

    def __call__(self, query):
        if not isinstance(query, IndexQuery):
            raise ValueError(f"Not a query of this queryable: {type(query).__name__}")
        if query.index != self._next:
            raise ValueError(f"The next part is {self._next}, not {query.index}.")
        if self._open is not None:
            self._open(RetireQuery())
        value, measurement = self._data[self._next], self._measurements[self._next]
        self._next += 1
        self._open = RetirableQueryable(measurement(value))
        return self._open

    def released(self) -> None:
        """What was written for the parts goes."""
        release = getattr(self._data, "release", None)
        if release is not None:
            release()


class GetAnswerQueryable(Queryable):
    """The answer of a measurement, taken once; any query gets it."""

    def __init__(self, measurement: Measurement, data: Any):
        self._answer = measurement(data)

    def __call__(self, query):
        if query is not None:
            raise ValueError("The answer is had by a query of None.")
        return self._answer


class DecoratedQueryable(Queryable):
    """Changes queries on the way in and answers on the way out."""

    def __init__(self, queryable: Queryable, preprocess_query: Callable[[Any], Any], postprocess_answer: Callable[[Any], Any]):
        self._queryable, self._before, self._after = queryable, preprocess_query, postprocess_answer

    def __call__(self, query):
        return self._after(self._queryable(self._before(query)))

    def released(self) -> None:
        self._queryable.released()


class DecorateQueryable(Measurement):
    """An interactive measurement whose queryable is decorated."""

    def __init__(self, measurement: Measurement, preprocess_query: Callable[[Any], Any], postprocess_answer: Callable[[Any], Any]):
        if not measurement.is_interactive:
            raise ValueError("The measurement has to be interactive.")
        super().__init__(measurement.input_domain, measurement.input_metric, measurement.output_measure, True)
        self._measurement, self._before, self._after = measurement, preprocess_query, postprocess_answer

    measurement = property(lambda self: self._measurement)

    def privacy_function(self, d_in):
        return self._measurement.privacy_function(d_in)

    def privacy_relation(self, d_in, d_out):
        return self._measurement.privacy_relation(d_in, d_out)

    def __call__(self, data):
        return DecoratedQueryable(self._measurement(data), self._before, self._after)


class SequentialComposition(Measurement):
    """A budget for queries one after the other."""

    def __init__(self, input_domain: Domain, input_metric: Metric, output_measure: Measure, d_in: Any, privacy_budget: Any):
        input_metric.validate(d_in)
        super().__init__(input_domain, input_metric, output_measure, True)
        self._d_in, self._budget = d_in, PrivacyBudget.cast(output_measure, privacy_budget)

    d_in = property(lambda self: self._d_in)
    privacy_budget = property(lambda self: self._budget)

    def privacy_function(self, d_in):
        self.input_metric.validate(d_in)
        if not self.input_metric.compare(d_in, self._d_in):
            raise ValueError(f"d_in ({d_in}) is larger than the distance of the composition ({self._d_in}).")
        return self._budget.value

    def __call__(self, data):
        return SequentialQueryable(self.input_domain, self.input_metric, self._d_in, self.output_measure, self._budget, data)


def _linear(measurement: Measurement) -> bool:
    """Whether the loss of one part is at least that of all its share: the stored distance is the whole one."""
    return isinstance(measurement, (SequentialComposition, DecorateQueryable, MakeInteractive)) or hasattr(measurement, "privacy_budget")


class ParallelComposition(Measurement):
    """An interactive measurement of each part; the loss is the largest one.

    Only measurements whose guarantee holds for the whole distance in one part
    are taken, since a part may hold all of it.
    """

    def __init__(self, input_domain: ListDomain, input_metric: Metric, output_measure: Measure, measurements: list[Measurement]):
        if not isinstance(input_metric, (SumOf, RootSumOfSquared)):
            raise UnsupportedMetricError(input_metric, "The metric has to be SumOf or RootSumOfSquared.")
        if isinstance(input_metric, RootSumOfSquared) != isinstance(output_measure, RhoZCDP):
            raise UnsupportedCombinationError((input_metric, output_measure), "SumOf goes with PureDP and ApproxDP, RootSumOfSquared with RhoZCDP.")
        if input_domain.length is None or input_domain.length != len(measurements):
            raise ValueError("There have to be as many measurements as parts.")
        for m in measurements:
            if not m.is_interactive:
                raise ValueError("All measurements have to be interactive.")
            if m.input_domain != input_domain.element_domain:
                raise DomainMismatchError((m.input_domain, input_domain.element_domain), "A measurement takes another domain.")
            if m.input_metric != input_metric.inner_metric:
                raise MetricMismatchError((m.input_metric, input_metric.inner_metric), "A measurement takes another metric.")
            if m.output_measure != output_measure:
                raise MeasureMismatchError((m.output_measure, output_measure), "A measurement has another measure.")
            if not _linear(m):
                raise ValueError(f"The guarantee of {type(m).__name__} is not known to hold for a whole part.")
        super().__init__(input_domain, input_metric, output_measure, True)
        self._measurements = list(measurements)

    measurements = property(lambda self: list(self._measurements))

    def privacy_function(self, d_in):
        self.input_metric.validate(d_in)
        return self.output_measure.largest([m.privacy_function(d_in) for m in self._measurements])

    def __call__(self, data):
        return ParallelQueryable(data, self._measurements)


class MakeInteractive(Measurement):
    """A measurement whose answer is had from a queryable."""

    def __init__(self, measurement: Measurement):
        if measurement.is_interactive:
            raise ValueError("The measurement is interactive already.")
        super().__init__(measurement.input_domain, measurement.input_metric, measurement.output_measure, True)
        self._measurement = measurement

    measurement = property(lambda self: self._measurement)

    def privacy_function(self, d_in):
        return self._measurement.privacy_function(d_in)

    def privacy_relation(self, d_in, d_out):
        return self._measurement.privacy_relation(d_in, d_out)

    def __call__(self, data):
        return GetAnswerQueryable(self._measurement, data)


def create_adaptive_composition(input_domain: Domain, input_metric: Metric, d_in: Any, privacy_budget: Any, output_measure: Measure) -> DecorateQueryable:
    """A budget from which plain measurements are answered at once."""

    def before(query: Any) -> Any:
        if not isinstance(query, MeasurementQuery):
            raise ValueError(f"Not a query of this queryable: {type(query).__name__}")
        return MeasurementQuery(MakeInteractive(query.measurement), query.d_out)

    return DecorateQueryable(SequentialComposition(input_domain, input_metric, output_measure, d_in, privacy_budget), before, lambda answer: answer(None))


class PrivacyAccountantState(enum.Enum):
    """What an accountant may do."""

    ACTIVE = 1
    WAITING_FOR_SIBLING = 2
    WAITING_FOR_CHILDREN = 3
    RETIRED = 4


class PrivacyAccountant:
    """A tree of accountants over one budget, of which one is active at a time.

    ``split`` pays once and hands out children for the parts; they become active
    in order, and their parent again once all are retired.
    """

    def __init__(self, queryable: Queryable | None, input_domain: Domain, input_metric: Metric, output_measure: Measure, d_in: Any, privacy_budget: Any, parent: PrivacyAccountant | None = None):
        self._queryable, self._domain, self._metric = queryable, input_domain, input_metric
        self._measure, self._d_in, self._budget = output_measure, d_in, PrivacyBudget.cast(output_measure, privacy_budget)
        self._parent, self._children = parent, []
        self._pending: list[tuple[Transformation, Any]] = []
        self._state = PrivacyAccountantState.ACTIVE if parent is None else PrivacyAccountantState.WAITING_FOR_SIBLING

    input_domain = property(lambda self: self._domain)
    input_metric = property(lambda self: self._metric)
    output_measure = property(lambda self: self._measure)
    d_in = property(lambda self: self._d_in)
    privacy_budget = property(lambda self: self._budget)
    state = property(lambda self: self._state)
    parent = property(lambda self: self._parent)
    children = property(lambda self: list(self._children))

    @staticmethod
    def launch(measurement: SequentialComposition, data: Any) -> PrivacyAccountant:
        """An accountant over data, with the budget of a composition."""
        if not isinstance(measurement, SequentialComposition):
            raise ValueError("Only a SequentialComposition can be launched.")
        return PrivacyAccountant(RetirableQueryable(measurement(data)), measurement.input_domain, measurement.input_metric, measurement.output_measure, measurement.d_in, measurement.privacy_budget)

    def _active(self) -> None:
        if self._state is not PrivacyAccountantState.ACTIVE:
            hint = "" if self._state is PrivacyAccountantState.RETIRED else " Use force_activate() to retire what it waits for."
            raise InactiveAccountantError(f"The accountant is {self._state.name}.{hint}")

    def _fits(self, part: Any) -> None:
        if part.input_domain != self._domain:
            raise DomainMismatchError((part.input_domain, self._domain), "The domain is another one.")
        if part.input_metric != self._metric:
            raise MetricMismatchError((part.input_metric, self._metric), "The metric is another one.")

    def _moved(self, transformation: Transformation, d_out: Any) -> Any:
        self._fits(transformation)
        return _charge(transformation, self._d_in, d_out, "stability_function", "stability_relation", "The transformation")

    def transform_in_place(self, transformation: Transformation, d_out: Any = None) -> None:
        """Go on with transformed data; costs nothing."""
        self._active()
        moved = self._moved(transformation, d_out)
        self._queryable(TransformationQuery(transformation, moved if d_out is not None else None))
        self._domain, self._metric, self._d_in = transformation.output_domain, transformation.output_metric, moved

    def queue_transformation(self, transformation: Transformation, d_out: Any = None) -> None:
        """Transform the data as soon as the accountant is active."""
        if self._state is PrivacyAccountantState.RETIRED:
            raise InactiveAccountantError("The accountant is RETIRED.")
        if self._state is PrivacyAccountantState.ACTIVE:
            self.transform_in_place(transformation, d_out)
            return
        moved = self._moved(transformation, d_out)
        self._pending.append((transformation, moved if d_out is not None else None))
        self._domain, self._metric, self._d_in = transformation.output_domain, transformation.output_metric, moved

    def measure(self, measurement: Measurement, d_out: Any = None) -> Any:
        """The answer of a measurement, paid from the budget."""
        self._active()
        self._fits(measurement)
        if measurement.output_measure != self._measure:
            raise MeasureMismatchError((measurement.output_measure, self._measure), "The measurement has another measure.")
        loss = _charge(measurement, self._d_in, d_out, "privacy_function", "privacy_relation", "The measurement")
        left = self._budget.subtract(loss)
        made = measurement if measurement.is_interactive else MakeInteractive(measurement)
        answer = self._queryable(MeasurementQuery(made, d_out))
        self._budget = left
        return answer if measurement.is_interactive else answer(None)

    def split(self, splitting_transformation: Transformation, privacy_budget: Any, d_out: Any = None) -> list[PrivacyAccountant]:
        """Accountants over the parts, each with the budget that is paid here once."""
        self._active()
        domain, metric = splitting_transformation.output_domain, splitting_transformation.output_metric
        if not isinstance(domain, ListDomain) or domain.length is None:
            raise ValueError("The transformation has to split into a known number of parts.")
        moved = self._moved(splitting_transformation, d_out)
        budget = PrivacyBudget.cast(self._measure, privacy_budget)
        left = self._budget.subtract(budget)
        compositions = [SequentialComposition(domain.element_domain, metric.inner_metric, self._measure, moved, budget) for _ in range(domain.length)]
        parallel = ParallelComposition(domain, metric, self._measure, compositions)
        chained = _Split(splitting_transformation, parallel, moved, d_out)
        queryable = self._queryable(MeasurementQuery(chained, budget.value))
        self._budget = left
        self._children = [PrivacyAccountant(None, domain.element_domain, metric.inner_metric, self._measure, moved, budget, self) for _ in range(domain.length)]
        self._parts, self._given = queryable, 0
        if self._children:
            self._state = PrivacyAccountantState.WAITING_FOR_CHILDREN
            self._next_child()
        return list(self._children)

    def _next_child(self) -> None:
        while self._given < len(self._children):
            child = self._children[self._given]
            queryable = self._parts(IndexQuery(self._given))
            self._given += 1
            child._queryable = queryable
            if child._state is PrivacyAccountantState.RETIRED:
                continue
            child._state = PrivacyAccountantState.ACTIVE
            for transformation, d_out in child._pending:
                queryable(TransformationQuery(transformation, d_out))
            child._pending = []
            return
        self._state = PrivacyAccountantState.ACTIVE

    def retire(self, force: bool = False) -> None:
        """No more questions; the next sibling, or the parent, becomes active."""
        if self._state is PrivacyAccountantState.RETIRED:
            return
        if self._state is PrivacyAccountantState.WAITING_FOR_CHILDREN and not force:
            raise RuntimeError("Children are not retired yet; use force=True.")
        was_active = self._state is not PrivacyAccountantState.WAITING_FOR_SIBLING
        for child in self._children:
            child._close()
        self._close()
        if self._parent is not None and was_active and self._parent._state is PrivacyAccountantState.WAITING_FOR_CHILDREN:
            self._parent._next_child()

    def _close(self) -> None:
        for child in self._children:
            child._close()
        if self._state is not PrivacyAccountantState.RETIRED:
            self._state = PrivacyAccountantState.RETIRED
            if self._queryable is not None:
                self._queryable(RetireQuery())

    def force_activate(self) -> None:
        """Retire what stands in the way."""
        if self._state is PrivacyAccountantState.RETIRED:
            raise RuntimeError("A retired accountant can not become active.")
        if self._state is PrivacyAccountantState.ACTIVE:
            return
        if self._state is PrivacyAccountantState.WAITING_FOR_CHILDREN:
            for child in self._children:
                child._close()
            self._given = len(self._children)
            self._state = PrivacyAccountantState.ACTIVE
            return
        parent = self._parent
        if parent._state is PrivacyAccountantState.WAITING_FOR_SIBLING:
            parent.force_activate()
        for sibling in parent._children:
            if sibling is self:
                break
            sibling.retire(force=True)


class _Split(Measurement):
    """The parallel composition of a splitting transformation's parts, with the distance settled beforehand."""

    def __init__(self, transformation: Transformation, parallel: ParallelComposition, moved: Any, given: Any):
        super().__init__(transformation.input_domain, transformation.input_metric, parallel.output_measure, True)
        self._transformation, self._parallel, self._moved, self._given = transformation, parallel, moved, given

    def privacy_function(self, d_in):
        return self._parallel.privacy_function(self._moved)

    def privacy_relation(self, d_in, d_out):
        confirmed = self._given is None or self._transformation.stability_relation(d_in, self._moved)
        return confirmed and self.output_measure.compare(self.privacy_function(d_in), d_out)

    def __call__(self, data):
        return self._parallel(self._transformation(data))


__all__ = ["ExactNumber", "GetAnswerQueryable", "INFINITY", "IndexQuery", "MakeInteractive", "Mapping", "MeasurementQuery", "ParallelComposition", "PrivacyAccountant", "PrivacyAccountantState", "RetirableQueryable", "RetireQuery", "SequentialComposition", "TransformationQuery", "create_adaptive_composition"]
