"""Sketches kept a row a group: merged for any union of groups, without the rows."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_BINS = 12  # of the distinct counts: 4096 bins
KLL = 400  # of the quantiles


def distinct_error(log_bins: int = LOG_BINS) -> float:
    """Three standard deviations of a distinct count, as a share of it."""
    return 3 * 1.04 / math.sqrt(1 << log_bins)


def rank_error(k: int = KLL) -> float:
    """How far a quantile's rank may be off, as a share of the rows, at 99 % confidence: the fitted bound of this sketch's authors (Karnin, Lang, Liberty), 2.296 / k^0.9021."""
    return 2.296 / k**0.9021


def daily(rows: DataFrame, groups: list[str], key: str, value: str) -> DataFrame:
    """A row a group: `n`, a sketch of the distinct `key`s and one of the `value`s. Nulls count in neither."""
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.hll_sketch_agg(key, F.lit(LOG_BINS)).alias("keys"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL)).alias("values"))


def merged(sketches: DataFrame, groups: list[str], at: float = 0.5) -> DataFrame:
    """What the sketches of the given rows say together, by `groups`: n, distinct and its relative error, the quantile `at` and its error in rank."""
    m = sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("values").alias("values"))
    return m.select(*groups, "n", F.hll_sketch_estimate("keys").alias("distinct"), F.lit(distinct_error()).alias("error"), F.kll_sketch_get_quantile_double("values", F.lit(at)).alias("quantile"), F.lit(rank_error()).alias("rank_error"))
