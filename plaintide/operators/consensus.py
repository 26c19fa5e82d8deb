"""Several labelers' votes on the same review.

Votes are ``review_id, agent_id, category`` and, for the weighted form,
``confidence``. Votes are counted per review and category first; partial counts
are made before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _per_category(votes: DataFrame) -> DataFrame:
    return votes.groupBy("review_id", "category").agg(
        F.count(F.lit(1)).alias("_votes"),
        F.sum(F.coalesce(F.col("confidence"), F.lit(1.0))).alias("_weight")
        if "confidence" in votes.columns
        else F.count(F.lit(1)).cast("double").alias("_weight"),
        F.min("agent_id").alias("_first_agent"),
    )


def _winner(counts: DataFrame, by: str, *extra) -> DataFrame:
    best = F.max(F.struct(by, (-F.col("_first_agent")).alias("_earliest"), "category"))
    return counts.groupBy("review_id").agg(best.alias("_best"), *extra)


def vote_majority(votes: DataFrame) -> DataFrame:
    """Most voted category, its votes, all votes and their ratio; earliest agent on a tie."""
    total = F.sum("_votes").alias("total_votes")
    return _winner(_per_category(votes), "_votes", total).select(
        "review_id",
        F.col("_best.category").alias("final_category"),
        F.col("_best._votes").alias("vote_count"),
        "total_votes",
        (F.col("_best._votes") / F.col("total_votes")).alias("agreement_rate"),
    )


def vote_weighted(votes: DataFrame) -> DataFrame:
    """Category with the largest sum of confidence; a missing confidence is 1."""
    total = F.sum("_weight").alias("total_weight")
    return _winner(_per_category(votes), "_weight", total).select(
        "review_id",
        F.col("_best.category").alias("final_category"),
        F.col("_best._weight").alias("weighted_score"),
        "total_weight",
    )


def consensus_batch(reviews: DataFrame, votes: DataFrame, method: str = "vote") -> DataFrame:
    """Final category per review; reviews without any vote drop out."""
    if method not in ("vote", "weighted"):
        raise ValueError("method must be 'vote' or 'weighted'")
    final = vote_majority(votes) if method == "vote" else vote_weighted(votes)
    return reviews.join(final, "review_id")
