"""URL filters: rules by host and path, and a character language model for the URLs that no rule judges.

Two variable-order Markov models, of the URLs that rules allow and of those
they block, give every character a probability after the longest context that
was seen before it, smoothed with all shorter ones (Witten and Bell). A URL is
judged by the difference of the two log-likelihoods over its length, against a
threshold that is calibrated on rule-judged URLs the models have not seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import let
from .common import held_out, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host, path and verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Characters before the one that is predicted.
ORDER = 5
START, END = "\x02", "\x03"
#: Log-likelihoods are added as whole numbers of 1 / UNIT, so that sums do not depend on the order of rows.
UNIT = 1_000_000_000
#: Scores are compared in steps of 1 / STEPS.
STEPS = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty if there is no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``rule`` and ``verdict`` of the longest rule whose host is the host or above it and whose path begins the path."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(text: Column, order: int = ORDER) -> Column:
    """Each character of a text, and its end, with the ``order`` characters before it."""
    padded = F.concat(F.lit(START * order), text, F.lit(END))
    # Split once: to cut a long text at each place would cost its length every time.
    return let(F.regexp_extract_all(padded, F.lit("(?s)."), F.lit(0)), lambda chars: F.transform(
        F.sequence(F.lit(1), F.size(chars) - order), lambda i: F.concat_ws("", F.slice(chars, i, order + 1))))


def gram_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """``gram, allow, block``: how often each gram of any row is in rows to learn from; most are counted in the tasks."""
    seen = lambda verdict: F.count_if(F.col("learn") & (F.col("verdict") == verdict)).alias(verdict)
    every = rows.select("learn", "verdict", F.explode_outer(grams(F.col(text))).alias("gram"))
    return every.groupBy("gram").agg(seen("allow"), seen("block"))


def _joined(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """An inner join by a shuffle, whatever the sizes look like.

    Spark takes a saved table for as large as its compressed file, and the
    characters of its texts for no larger than the texts: it would collect and
    broadcast what looks small, which takes a hundred times as much in the driver.
    """
    return left.join(right.hint("merge"), on)


def log_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, ratio``: logarithm of the allow over the block probability of the last character, in whole units.

    One round for each length of context, from none up. The tables are of
    different grams: they grow with the URLs, and are joined by a shuffle.
    """
    counts = saved(counts, "grams")
    symbols = counts.select(F.substring("gram", -1, 1).alias("s")).distinct().count()
    lower = None
    for k in range(order + 1):
        gram = F.substring("gram", -(k + 1), k + 1)
        own = counts.groupBy(gram.alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        own = own.withColumn("context", F.substring("gram", 1, k))
        sums = own.groupBy("context").agg(*[a for c in ("allow", "block") for a in (
            F.sum(c).alias(f"{c}_n"), F.count_if(F.col(c) > 0).alias(f"{c}_kinds"))])
        table = _joined(own, sums, "context")
        if lower is None:
            table = table.withColumns({"allow_p": F.lit(1.0 / (symbols + 1)), "block_p": F.lit(1.0 / (symbols + 1))})
        else:
            table = _joined(table.withColumn("shorter", F.substring("gram", 2, k)),
                            lower.select(F.col("gram").alias("shorter"), "allow_p", "block_p"), "shorter")

        def smoothed(c: str) -> Column:
            # With a context that was never seen, both counts are 0 and the shorter one decides.
            weight = F.col(f"{c}_n") + F.col(f"{c}_kinds")
            return F.when(weight > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_p")) / weight).otherwise(F.col(f"{c}_p"))

        lower = saved(table.select("gram", smoothed("allow").alias("allow_p"), smoothed("block").alias("block_p")), "model")
    ratio = F.log(F.col("allow_p")) - F.log(F.col("block_p"))
    return lower.select("gram", F.round(ratio * UNIT).cast("bigint").alias("ratio"))


def scores(rows: DataFrame, ratios: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """``id_col, steps``: mean log ratio of each row's characters, in whole steps, rounded down.

    One joined row for each character; a gram that begins a third of all URLs
    is split by the join, and its rows are added up before the next shuffle.
    """
    every = _joined(rows.select(id_col, F.explode_outer(grams(F.col(text))).alias("gram")), ratios, "gram")
    total = every.groupBy(id_col).agg(F.sum("ratio").alias("sum"), F.count(F.lit(1)).alias("n"))
    whole = total.withColumn("size", F.col("n") * (UNIT // STEPS))
    return whole.select(id_col, F.expr("(sum - pmod(sum, size)) div size").alias("steps"))


def threshold(judged: DataFrame) -> int:
    """The score from which to allow, so that the shares of right verdicts on both kinds add up to the most.

    ``judged`` has ``steps`` and ``verdict``. The counts by score are a few
    thousand rows at most, whatever the input: scores are means of log ratios in
    steps of 1 / 1000. It lies half way between the scores that it parts; of
    equally good ones the smallest is taken, and 0 if a kind is missing.
    """
    by_score = judged.groupBy("steps").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    below = Window.orderBy("steps").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    right = by_score.select(
        "steps", (F.sum("a").over(every) - F.coalesce(F.sum("a").over(below), F.lit(0))).alias("ra"),
        F.coalesce(F.sum("b").over(below), F.lit(0)).alias("rb"), F.lag("steps").over(Window.orderBy("steps")).alias("before"), F.sum("a").over(every).alias("na"), F.sum("b").over(every).alias("nb"))
    best = right.where("na > 0 and nb > 0").orderBy(F.desc(F.expr("ra / na + rb / nb")), "steps").first()
    if best is None:
        return 0
    return best.steps if best.before is None else (best.before + best.steps) // 2 + 1


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``id_col, host, path, rule, verdict, score`` of every row of ``pages``.

    The verdict is the longest fitting rule's. Where none fits, it is the
    models': they learn from the URLs with a rule, but for a quarter (by a hash
    of the id) on which the threshold is calibrated. ``score`` is the mean log
    ratio, rounded down to 1 / 1000.

    A null or empty URL is judged by how likely an empty text is. Repeated rows
    are judged and counted each. Where the rules allow or block nothing, the
    models know nothing of that kind, and URLs with a score of 0 or more are
    allowed. An empty table gives no rows; other columns are not read.
    """
    url = F.col(f"p.{url_col}")
    host, path = host_and_path(url)
    own = pages.select(id_col, url_col).alias("p").select(
        F.col(f"p.{id_col}").alias("id"), F.coalesce(url, F.lit("")).alias("text"), host.alias("host"), path.alias("path"))
    rows = saved(own.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select(
        "id", "text", "host", "path", "found.rule", "found.verdict", (~held_out("id")).alias("learn"),
        F.monotonically_increasing_id().alias("row")), "urls")
    ratios = log_ratios(gram_counts(rows))
    judged = rows.select("row", "id", "host", "path", "rule", "verdict", "learn")
    scored = saved(_joined(judged, scores(rows, ratios, "row"), "row"), "scores")
    least = threshold(scored.where("not learn and verdict is not null"))
    by_score = F.when(F.col("steps") >= least, "allow").otherwise("block")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", by_score).alias("verdict"),
                         (F.col("steps") / STEPS).alias("score"))
