"""All public names in one place: ``from quietframe import api``."""

from quietframe.functions.distributions import *  # noqa: F403
from quietframe.functions.exact import ExactNumber, ExactNumberInput, validate_exact_number
from quietframe.functions.helpers import assert_never, copy_if_mutable, get_element_type, get_fullname, get_immutable_types
from quietframe.functions.prdp import (
    exponential_polylogarithmic_mechanism, fourth_root_transformation_mechanism, log_transformation_mechanism,
    square_root_gaussian_mechanism, square_root_transformation_mechanism,
)
from quietframe.functions.samplers import RNGWrapper, construct_inverse_sampler, gaussian, laplace, prng, sample_dgauss, uniform
from quietframe.operators.grouped import (
    Count, CountDistinct, CountDistinctGrouped, CountGrouped, GroupBy, GroupedDataFrame, Sum, SumGrouped, compute_full_domain_df, create_count_aggregation,
    create_count_distinct_aggregation, create_groupby_from_column_domains, create_groupby_from_list_of_keys, create_sum_aggregation, validate_groupby_domains,
)
from quietframe.operators.joins import PrivateJoin, PrivateJoinOnKey, PublicJoin, TruncationStrategy, columns_after_join, domain_after_join, join, natural_join_columns
from quietframe.operators.maps import FlatMap, FlatMapByKey, GroupingFlatMap, Map, RowsToRowsTransformation, RowToRowsTransformation, RowToRowTransformation
from quietframe.operators.noise import AddDiscreteGaussianNoise, AddGaussianNoise, AddGeometricNoise, AddLaplaceNoise, AddNoiseToColumn, AddNoiseToSeries, NoiseMechanism, calculate_noise_scale
from quietframe.operators.releases import (
    Aggregate, AggregateByColumn, ApplyInPandas, FusedAggregate, GeometricPartitionSelection, MergeableAggregate, NoisyQuantile, SparseVectorPrefixSums, create_average_measurement, create_bounds_measurement,
    create_count_distinct_measurement, create_count_measurement, create_partition_selection_measurement, create_quantile_measurement, create_standard_deviation_measurement,
    create_sum_measurement, create_variance_measurement, get_midpoint,
)
from quietframe.operators.rows import (
    AddUniqueColumn, DropInfs, DropNaNs, DropNulls, Filter, Partition, PartitionByKeys, Persist, Rename, ReplaceInfs, ReplaceNaNs, ReplaceNulls, Select, SparkAction, Unpersist,
)
from quietframe.operators.tables import *  # noqa: F403
from quietframe.operators.truncation import LimitKeysPerGroup, LimitRowsPerGroup, LimitRowsPerKeyPerGroup, drop_large_groups, limit_keys_per_group, truncate_large_groups
from quietframe.plans.core import (
    ChainTM, ChainTT, Composition, HammingDistanceToSymmetricDifference, Identity, Measurement, NonInteractivePostProcess, PostProcess, PureDPToApproxDP, PureDPToRhoZCDP,
    RhoZCDPToApproxDP, Transformation, UnwrapIfGroupedBy,
)
from quietframe.plans.domains import *  # noqa: F403
from quietframe.plans.errors import *  # noqa: F403
from quietframe.plans.interactive import *  # noqa: F403
from quietframe.plans.interactive import DecorateQueryable, DecoratedQueryable, ParallelQueryable, Queryable, SequentialQueryable
from quietframe.plans.measures import ApproxDP, ApproxDPBudget, Measure, PrivacyBudget, PureDP, PureDPBudget, RhoZCDP, RhoZCDPBudget, assert_can_spend_budget
from quietframe.plans.metrics import (
    AbsoluteDifference, AddRemoveKeys, AggregationMetric, DictMetric, ExactNumberMetric, HammingDistance, IfGroupedBy, Metric, NullMetric, OnColumn, OnColumns, RootSumOfSquared, SumOf, SymmetricDifference,
)
from quietframe.sources.shared import Config, cleanup, escape_column_name, get_materialized_df, get_nonconflicting_string, print_sdf, read_table, remove_all_temp_tables, sanitized
