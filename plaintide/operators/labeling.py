"""Category by word rules, without a model."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let
from ..functions.scoring import contains_any
from ..functions.vocabulary import RULE_WORDS


def word_pattern(words: Sequence[str]) -> str:
    return "|".join(re.escape(word) for word in words)


def label_by_rules(
    df: DataFrame,
    rules: Mapping[str, Sequence[str]] = RULE_WORDS,
    text: str = "review_text",
    default: str = "other",
) -> DataFrame:
    """Adds ``category`` and ``rule_hits``.

    The category mentioned most often wins, on a tie the one mentioned first,
    then the one first in ``rules``. Without any mention it is ``default``.
    The words are part of the expression, so no join and no shuffle is needed.
    """

    def best(lower: Column) -> Column:
        scores = []
        for place, (category, words) in enumerate(rules.items()):
            pattern = F.lit(word_pattern(words))
            # Most categories are not mentioned at all; a plain search tells at once.
            mentioned = contains_any(lower, words)
            scores.append(F.struct(
                F.when(mentioned, F.regexp_count(lower, pattern)).otherwise(0).alias("hits"),
                F.when(mentioned, -F.regexp_instr(lower, pattern)).otherwise(0).alias("earlier"),
                F.lit(-place).alias("place"),
                F.lit(category).alias("category"),
            ))
        return F.array_max(F.array(*scores))

    def result(found: Column) -> Column:
        category = F.when(found["hits"] > 0, found["category"]).otherwise(default)
        return F.struct(category.alias("category"), found["hits"].alias("rule_hits"))

    rule = let(let(F.lower(F.coalesce(F.col(text), F.lit(""))), best), result)
    return (
        df.withColumn("_rule", rule)
        .withColumns({"category": F.col("_rule.category"), "rule_hits": F.col("_rule.rule_hits")})
        .drop("_rule")
    )
