"""Quality classifier (10): a sparse rule ensemble.

A forest of shallow trees is grown on statistics of the labelled texts. Every
path from a root to a node is a rule, a conjunction of comparisons. A logistic
model with an absolute-value penalty weighs the rules and drops most; what is
left is compiled into one column expression, so scoring is a projection.

Trees and weights are fitted by Spark on all labelled rows; only trees and
weights, whose sizes are parameters, come to the driver.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .statistics import text_statistics

FEATURES = ("n_words", "mean_length", "distinct", "symbols", "dup_lines", "repeats", "upper", "digits", "bangs", "bars")
Rule = tuple[tuple[int, str, float], ...]


def features() -> list[Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    out = (F.col("n_words") * 1.0, F.col("word_chars") / words, F.col("n_distinct") / words, F.col("n_symbols") / words,
           F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words, F.col("n_upper") / F.greatest("n_letters", F.lit(1)),
           F.col("n_digits") / F.greatest("word_chars", F.lit(1)), F.col("n_bangs") / words, F.col("n_bars") / words)
    return [x.cast("double").alias(n) for x, n in zip(out, FEATURES)]


def paths(description: str) -> set[Rule]:
    """The rules of all trees in a printed forest: every path that ends at a node below a root."""
    rules: set[Rule] = set()
    path: list[tuple[int, str, float]] = []
    for line in description.splitlines():
        if line.strip().startswith("Tree"):
            path = []
        found = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found:
            # Roots are printed after four blanks, each level below with one more.
            path = path[:len(found[1]) - 4] + [(int(found[3]), found[4], float(found[5]))]
            rules.add(tuple(sorted(set(path))))
    return rules


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for feature, sign, value in rule:
        column = F.col(FEATURES[feature])
        out = out & (column <= value if sign == "<=" else column > value)
    return out


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules, their weights and the intercept; ``score`` needs the columns in ``FEATURES``."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(condition(rule), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def fit(rows: DataFrame, *, label: str = "label", trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """Fits to ``rows`` with the columns in ``FEATURES`` and a 0/1 ``label``; rows without a label are left out.

    Without rows of both labels there is nothing to tell apart: the ensemble has
    no rules, and scores the share of label 1 (0.5 without rows).
    """
    rows = rows.where(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("label"), *FEATURES)
    sizes = {int(r.label): r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return RuleEnsemble((), (), 0.0 if not sizes else 20.0 if 1 in sizes else -20.0)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(rows).select("label", "v")
    forest = RandomForestClassifier(labelCol="label", featuresCol="v", numTrees=trees, maxDepth=depth, maxBins=64, seed=seed,
                                    featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(vectors)
    rules = sorted(paths(forest.toDebugString))
    if not rules:
        total = sum(sizes.values())
        return RuleEnsemble((), (), 0.0 if not total else float(_logit(sizes[1] / total)))
    names = [f"r{i}" for i in range(len(rules))]
    truth = rows.select("label", *[condition(r).cast("double").alias(n) for r, n in zip(rules, names)])
    design = VectorAssembler(inputCols=names, outputCol="v").transform(truth).select("label", "v")
    model = LogisticRegression(labelCol="label", featuresCol="v", elasticNetParam=1.0, regParam=penalty, maxIter=60,
                               standardization=False).fit(design)
    kept = [(r, float(w)) for r, w in zip(rules, model.coefficients) if w]
    return RuleEnsemble(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(model.intercept))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def quality_classifier(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                       learn: Column | None = None, threshold: float = 0.7) -> tuple[DataFrame, RuleEnsemble]:
    """Id, ``score`` (0 to 1) and ``predicted`` of every row, and the fitted ensemble.

    ``learn`` says, in terms of the column ``id``, which rows' labels may be
    used (all by default). The score follows from the text alone: null and
    empty texts all get the score of a text without words. Labels of unknown or
    null ids are not used; an id with several labels or texts counts each pair.
    """
    counted = text_statistics(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), keep=("id",))
    rows = saved(counted.select("id", *features()), "statistics")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null")
    fitted = fit(saved((rows if learn is None else rows.where(learn)).join(known, "id"), "labelled"))
    scored = rows.select(F.col("id").alias(id_col), fitted.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")), fitted
