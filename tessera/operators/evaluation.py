"""Measures of rankings, and statistics of paired differences.

A ranking has (query_id, chunk_id, rank); labels have (query_id, chunk_id, rel) with rel 2 for expected and 1 for judged chunks. A query
without labels has null measures; one whose labels the ranking misses has 0.
"""

from __future__ import annotations

from math import ceil, comb, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.quality import count_if
from tessera.operators.ranks import percentiles
from tessera.sources.scratch import Scratch


def rank_measures(hits: DataFrame, labels: DataFrame, queries: DataFrame, k: int = 10, recall_k: int = 50) -> DataFrame:
    """(query_id, ndcg, mrr, recall, judged): nDCG with gain 2^rel-1, reciprocal rank of the first expected chunk, share of expected
    chunks within ``recall_k``, and judged chunks of the first k over k. One pass joins hits with labels for all queries."""
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    ideal = labels.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "chunk_id")))
    best = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1))).alias("ideal"), count_if(F.col("rel") == 2).alias("expected"))
    found = hits.join(labels, ["query_id", "chunk_id"]).groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.min(F.when((F.col("rel") == 2) & (F.col("rank") <= k), F.col("rank"))).alias("first"),
        count_if((F.col("rel") == 2) & (F.col("rank") <= recall_k)).alias("found"),
        count_if(F.col("rank") <= k).alias("judged"),
    )
    j = queries.select("query_id").join(best, "query_id", "left").join(found, "query_id", "left")
    labelled = F.col("ideal").isNotNull()
    return j.select(
        "query_id",
        F.when(F.col("ideal") > 0, F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 6)).alias("ndcg"),
        F.when(F.col("expected") > 0, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(F.col("expected") > 0, F.coalesce("found", F.lit(0)) / F.col("expected")).alias("recall"),
        F.when(labelled, F.coalesce("judged", F.lit(0)) / k).alias("judged"),
    )


def jaccard(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, jaccard) of the first k chunks of two rankings; a query in neither isn't listed."""
    both = a.where(F.col("rank") <= k).select("query_id", "chunk_id", F.lit(1).alias("a")).join(b.where(F.col("rank") <= k).select("query_id", "chunk_id", F.lit(1).alias("b")), ["query_id", "chunk_id"], "full")
    return both.groupBy("query_id").agg((count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count("*")).alias("jaccard"))


def numeric_stats(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, min, max, mean, p50, p95, p99 interpolated, p95_nearest by nearest rank); no task holds all values of a group."""
    scratch = Scratch(values.sparkSession, "stats")
    plain = values.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"))
    at = {"p50": ("linear", 0.5), "p95": ("linear", 0.95), "p99": ("linear", 0.99), "p95_nearest": ("nearest", 0.95)}
    cuts = percentiles(values, group, value, at, scratch).withColumnRenamed(group, "_group")
    joined = plain.join(cuts, F.col(group).eqNullSafe(F.col("_group")), "left")
    return joined.select(group, "n", "min", "max", "mean", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")], "p95_nearest")


def sign_test(wins: int, losses: int) -> float | None:
    """Two-sided exact binomial p of that many wins and losses; ties don't count; none without either."""
    n = wins + losses
    if not n:
        return None
    return min(1.0, 2 * sum(comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n)


def bootstrap_interval(deltas: list[float], rounds: int = 2000, seed: int = 0xA5A51337) -> tuple[float, float] | None:
    """95 % interval of the mean of the differences by resampling with a xorshift generator, the same in every run. The differences are
    one per query of a stated evaluation set."""
    if not deltas or rounds <= 0:
        return None
    state, mask, n, means = seed, (1 << 64) - 1, len(deltas), []
    for _ in range(rounds):
        total = 0.0
        for _ in range(n):
            state ^= state << 13 & mask
            state ^= state >> 7
            state ^= state << 17 & mask
            total += deltas[state % n]
        means.append(total / n)
    means.sort()
    return means[min(floor(rounds * 0.025), rounds - 1)], means[min(max(ceil(rounds * 0.975) - 1, 0), rounds - 1)]
