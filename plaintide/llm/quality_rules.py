"""Quality rules (6): robust multivariate outliers by language and source.

Each text gives four transformed statistics. For every language and source the
minimum-covariance-determinant estimate of their centre and covariance is found
by concentration steps: from the medians, keep the share ``support`` of rows
with the smallest distances, take mean and covariance of those, and again.
Documents whose squared Mahalanobis distance is beyond a chi-squared quantile
are outliers. Hard base rules come first.

Columns and aggregates only. A concentration step is two aggregates over the
small table of statistics (partial before the shuffle, so a source with a third
of all rows costs a row a task); texts are read once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .statistics import text_statistics

FEATURES = ("mean_length", "symbols", "dup_lines", "repeats")
#: Least spread of each feature: in many sources a statistic is the same for nearly all rows.
FLOORS = (0.08, 0.5, 0.7, 0.8)


def chi2_below(x: float, dof: int) -> float:
    """Chi-squared distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, dof) < p else (low, mid)
    return high


def _features() -> list[Column]:
    words = F.col("n_words")
    rate = lambda c: F.log1p(100.0 * F.col(c) / F.greatest(words, F.lit(1)))
    # The few extra words keep very short texts from standing out by chance.
    length = F.log((F.col("word_chars") + 100.0) / (words + 20.0))
    return [x.alias(n) for x, n in zip((length, rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")), FEATURES)]


def _distance(centre: list[Column], inverse: dict[tuple[int, int], Column]) -> Column:
    """Squared length of the deviation after multiplying by a lower triangle."""
    parts = [sum(inverse[i, j] * (F.col(FEATURES[j]) - centre[j]) for j in range(i + 1)) for i in range(len(FEATURES))]
    return sum(p * p for p in parts)


def _with_inverse(estimates: DataFrame) -> DataFrame:
    """Adds ``l_i_j``: the inverse of the covariance's Cholesky factor."""
    size = range(len(FEATURES))
    for i in size:
        for j in range(i + 1):
            rest = F.col(f"cov_{i}_{j}") - sum((F.col(f"c_{i}_{k}") * F.col(f"c_{j}_{k}") for k in range(j)), F.lit(0.0))
            # On the diagonal never less than the floor, so that the factor always exists.
            value = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / F.col(f"c_{j}_{j}")
            estimates = estimates.withColumn(f"c_{i}_{j}", value)
    for i in size:
        for j in range(i + 1):
            value = F.lit(1.0) if i == j else -sum((F.col(f"c_{i}_{k}") * F.col(f"l_{k}_{j}") for k in range(j, i)), F.lit(0.0))
            estimates = estimates.withColumn(f"l_{i}_{j}", value / F.col(f"c_{i}_{i}"))
    return estimates


def _matched(rows: DataFrame, others: DataFrame, groups: list[str], how: str) -> DataFrame:
    """``rows`` with the columns of their group's row in ``others``; nulls are equal."""
    renamed = others.withColumnsRenamed({g: f"of_{g}" for g in groups})
    on = [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in groups]
    return rows.join(renamed, on, how).drop(*[f"of_{g}" for g in groups])


def _near(rows: DataFrame, estimates: DataFrame, groups: list[str]) -> DataFrame:
    """Each row with its squared distance from its group's estimate."""
    size = range(len(FEATURES))
    triangle = {(i, j): F.col(f"l_{i}_{j}") for i in size for j in range(i + 1)}
    needed = estimates.select(*groups, F.col("n").alias("group_rows"), *[f"m_{j}" for j in size], *[f"l_{i}_{j}" for i, j in triangle])
    return _matched(rows, needed, groups, "left").select(
        *rows.columns, "group_rows", _distance([F.col(f"m_{j}") for j in size], triangle).alias("distance"))


def estimate(rows: DataFrame, groups: list[str], *, support: float = 0.75, steps: int = 3) -> DataFrame:
    """One row a group: ``n``, centre ``m_j`` and inverse factor ``l_i_j``. ``rows`` should be a saved table."""
    size = range(len(FEATURES))
    middle = rows.groupBy(*groups).agg(
        F.count("*").alias("n"), *[F.percentile_approx(f, [0.25, 0.5, 0.75]).alias(f"q_{j}") for j, f in enumerate(FEATURES)])
    first = middle.select(*groups, "n", *[F.col(f"q_{j}")[1].alias(f"m_{j}") for j in size], *[
        (F.pow(F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(FLOORS[i])), 2) if i == j else F.lit(0.0)).alias(f"cov_{i}_{j}")
        for i in size for j in range(i + 1)])
    now = saved(_with_inverse(first), "mcd")
    # Of a normal distribution, the nearest part has a smaller covariance by this factor.
    dof = len(FEATURES)
    factor = support / chi2_below(chi2_quantile(support, dof), dof + 2)
    for _ in range(steps):
        far = _near(rows, now, groups)
        limit = far.groupBy(*groups).agg(F.percentile_approx("distance", support).alias("limit"))
        inner = _matched(far, limit, groups, "inner").where("distance <= limit")
        sums = inner.groupBy(*groups).agg(
            F.max("group_rows").alias("n"), *[F.avg(f).alias(f"m_{j}") for j, f in enumerate(FEATURES)],
            *[(factor * F.covar_pop(FEATURES[i], FEATURES[j])).alias(f"cov_{i}_{j}") for i in size for j in range(i + 1)])
        now = saved(_with_inverse(sums), "mcd")
    return now


def quality_rules(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"),
                  least_words: int = 10, most_repeats: int = 20, quantile: float = 0.9999, least_rows: int = 40) -> DataFrame:
    """Id, statistics, ``base_failed``, ``distance`` and ``kept`` of every row.

    ``base_failed``: fewer than ``least_words`` words, or more than
    ``most_repeats`` percent of the words in repeated windows. ``kept`` is false
    if the base rules fail or the squared distance is beyond the chi-squared
    ``quantile``. Rows that fail the base rules do not enter the estimates.

    Null texts count as empty and fail. Null languages and sources are groups of
    their own. Groups with fewer than ``least_rows`` rows to learn from have no
    estimate that could be trusted: their rows have a null distance and are
    judged by the base rules alone. Ids may be null or repeat.
    """
    names = [f"g{i}" for i in range(len(groups))]
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(g).alias(n) for g, n in zip(groups, names)])
    counted = text_statistics(source, keep=("id", *names))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    rows = saved(counted.select("id", *names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                failed.alias("base_failed"), *_features()), "quality")
    found = _near(rows, estimate(rows.where(~F.col("base_failed")), names).where(F.col("n") >= least_rows), names)
    cutoff = chi2_quantile(quantile, len(FEATURES))
    return found.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"))
