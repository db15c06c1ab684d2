"""Comparison of two runs: overlap of rankings, rules on changes of measures, and the verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.quality import count_if, unpivot
from tessera.operators.ranks import percentiles
from tessera.sources.scratch import Scratch

@dataclass(frozen=True)
class Rule:
    """A rule on one measure of two runs. Kinds: ``none`` (nothing new may fail), ``floor`` (the value after), ``no_drop`` (not below the
    value before), ``valid`` (must be 1, also if missing), ``no_more`` (missing counts as 0), ``crossed`` (was at the limit, is below it),
    ``rise`` and ``drop`` (by more than the limit), ``relative`` (rise by a part of the value before), ``latency``."""

    rule: str
    measure: str
    kind: str
    limit: float = 0.0
    hard: bool = True
    full_only: bool = False


# The rules with their limits.
RULES = (
    Rule("H-NEW-FAILED-CHECKS-QUICK", "new_failed_quick", "none"),
    Rule("H-NEW-FAILED-CHECKS-FULL", "new_failed_full", "none", full_only=True),
    Rule("H-DETERMINISM-RETRIEVAL", "retrieval_determinism", "floor", 1.0),
    Rule("H-DETERMINISM-PINPOINT", "pinpoint_determinism", "floor", 1.0),
    Rule("H-CITATION-TOP1", "citation_top1", "no_drop"),
    Rule("H-BENCHMARK-INVALID", "benchmark_valid", "valid"),
    Rule("H-BENCHMARK-FAILURES-INCREASED", "benchmark_failures", "no_more"),
    Rule("H-LEXICAL-TOP1-HIT-FLOOR", "lexical_top1", "crossed", 0.95),
    Rule("H-SEMANTIC-TOP1-HIT-FLOOR", "semantic_top1", "crossed", 0.95),
    Rule("H-LEXICAL-NO-RESULT-RATE", "lexical_no_result_rate", "rise", 0.05),
    Rule("H-SEMANTIC-NO-RESULT-RATE", "semantic_no_result_rate", "rise", 0.05),
    Rule("H-LEXICAL-TIMEOUT-RATE", "lexical_timeout_rate", "rise", 0.02),
    Rule("H-SEMANTIC-TIMEOUT-RATE", "semantic_timeout_rate", "rise", 0.02),
    Rule("S-LEXICAL-NDCG", "lexical_ndcg", "drop", 0.005, False),
    Rule("S-LEXICAL-RECALL", "lexical_recall", "drop", 0.005, False),
    Rule("S-SEMANTIC-NDCG", "semantic_ndcg", "drop", 0.005, False),
    Rule("S-HYBRID-NDCG", "hybrid_ndcg", "drop", 0.005, False),
    Rule("S-HYBRID-RECALL", "hybrid_recall", "drop", 0.005, False),
    Rule("S-HYBRID-MRR", "hybrid_mrr", "drop", 0.005, False),
    Rule("S-FALLBACK-RATE", "semantic_fallback_rate", "rise", 0.02, False),
    Rule("S-LEXICAL-JACCARD", "lexical_jaccard", "floor", 0.90, False),
    Rule("S-SEMANTIC-JACCARD", "semantic_jaccard", "floor", 0.90, False),
    Rule("S-CANDIDATE-COUNT-DRIFT", "semantic_candidates", "relative", 0.20, False),
    Rule("S-BENCH-P95-LEXICAL", "lexical_p95_ms", "latency", 5.0, False),
    Rule("S-BENCH-P95-SEMANTIC", "semantic_p95_ms", "latency", 5.0, False),
    Rule("S-BENCH-P95-HYBRID", "hybrid_p95_ms", "latency", 5.0, False),
)
#: The part of the latency before by which it may grow, where that is more than the fixed amount.
LATENCY_PART = 0.10
#: A benchmark is valid up to this rate of failed timed queries.
FAILURE_RATE = 0.01


def top_lists(rows: DataFrame, k: int = 10) -> DataFrame:
    """(mode, query_id, top): the first k chunks of each scorer and query by score and chunk; a chunk scored twice has its best score."""
    best = rows.groupBy(F.col("scorer").alias("mode"), "query_id", "chunk_id").agg(F.max("score").alias("s"))
    place = F.row_number().over(Window.partitionBy("mode", "query_id").orderBy(F.desc("s"), "chunk_id"))
    return best.withColumn("place", place).where(F.col("place") <= k).groupBy("mode", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("top"))


def snapshot_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(mode, queries, jaccard, same_first) over the queries of both snapshots."""
    j = before.withColumnRenamed("top", "b").join(after.withColumnRenamed("top", "a"), ["mode", "query_id"])
    overlap = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return j.groupBy("mode").agg(F.count("*").alias("queries"), F.round(F.avg(overlap), 6).alias("jaccard"), count_if(F.element_at("a", 1) == F.element_at("b", 1)).alias("same_first"))


def relative_rise(before: Column, after: Column) -> Column:
    """The part by which a value rose: 0 from 0 to 0, null from 0 to anything else."""
    return F.when(before != 0, (after - before) / before).when(after == 0, 0.0)


def latency_limit(before: Column, absolute: float = 5.0, relative: float = 0.10) -> Column:
    """How much a latency may grow: the larger of an amount and a part of what it was."""
    return F.greatest(F.lit(absolute), before * relative)


def query_snapshot(hits: DataFrame, queries: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, status, returned, timed_out, fallback_used, must_hit_top1, expected, top, top1) of a ranking (query_id, chunk_id, rank) of all
    stated queries; ``expected`` has (query_id, chunk_id). A query without hits has an empty list."""
    place = F.struct("rank", "chunk_id")
    lists = hits.groupBy("query_id").agg(F.count("*").alias("returned"), F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("rank") <= k, place))), 1, k), lambda x: x["chunk_id"]).alias("top"))
    wanted = expected.groupBy("query_id").agg(F.collect_set("chunk_id").alias("expected"))
    out = queries.select("query_id", F.coalesce("must_hit_top1", F.lit(False)).alias("must_hit_top1")).join(lists, "query_id", "left").join(wanted, "query_id", "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({"returned": F.coalesce("returned", F.lit(0)), "top": F.coalesce("top", empty), "expected": F.coalesce("expected", empty)})
    return out.select("query_id", F.lit("ok").alias("status"), "returned", F.lit(False).alias("timed_out"), F.lit(False).alias("fallback_used"), "must_hit_top1", "expected", "top", F.try_element_at("top", F.lit(1)).alias("top1"))


def snapshot_summary(rows: DataFrame, mode: str) -> DataFrame:
    """(measure, value) of a snapshot, the names beginning with the mode: rates of no results, timeouts and fallbacks over all queries, of
    right first hits over the answered ones that must have one, and the mean number of candidates of those answered."""
    ok = F.col("status") == "ok"
    held = ok & F.col("must_hit_top1")
    n = rows.agg(
        (count_if(F.col("returned") == 0) / F.count("*")).alias(f"{mode}_no_result_rate"),
        (count_if(F.col("timed_out")) / F.count("*")).alias(f"{mode}_timeout_rate"),
        (count_if(F.col("fallback_used")) / F.count("*")).alias(f"{mode}_fallback_rate"),
        F.avg(F.when(held, F.coalesce(F.array_contains("expected", F.col("top1")), F.lit(False)).cast("double"))).alias(f"{mode}_top1"),
        F.avg(F.when(ok, F.col("returned"))).alias(f"{mode}_candidates"),
    )
    return unpivot(n)


def overlap(before: DataFrame, after: DataFrame, mode: str) -> DataFrame:
    """(measure, value): mean Jaccard overlap of the lists of the queries answered in both snapshots, 1 for two empty ones, and how often
    the first is the same."""
    b = before.where("status = 'ok'").select("query_id", F.col("top").alias("b"), F.col("top1").alias("b1"))
    j = b.join(after.where("status = 'ok'").select("query_id", F.col("top").alias("a"), F.col("top1").alias("a1")), "query_id")
    union = F.size(F.array_union("a", "b"))
    shared = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / union)
    return unpivot(j.agg(F.avg(shared).alias(f"{mode}_jaccard"), F.avg(F.col("a1").eqNullSafe(F.col("b1")).cast("double")).alias(f"{mode}_top1_identity")))


def newly_failing(before: DataFrame, after: DataFrame) -> DataFrame:
    """(check) of checks (check, result) that don't pass now, failed or pending, and did before."""
    return after.where("result != 'pass'").select("check").join(before.where("result != 'pass'").select("check"), "check", "left_anti")


def bench_summary(records: DataFrame) -> DataFrame:
    """(mode, queries, failures, failure_rate, valid, p50, p95, p99) of timed records (mode, phase, status, latency_ms, fallback_used); those of
    the warm-up aren't counted, latencies are those of queries that didn't fail."""
    timed = records.where("phase = 'timed'")
    failed = F.col("status") != "ok"
    n = timed.groupBy("mode").agg(F.count("*").alias("queries"), count_if(failed).alias("failures"), (count_if(F.col("fallback_used")) / F.count("*")).alias("fallback_rate"))
    n = n.withColumn("failure_rate", F.col("failures") / F.col("queries")).withColumn("valid", F.col("failure_rate") <= FAILURE_RATE)
    cuts = percentiles(timed.where(~failed), "mode", "latency_ms", {"p50": ("linear", 0.5), "p95": ("linear", 0.95), "p99": ("linear", 0.99)}, Scratch(records.sparkSession, "bench"))
    return n.join(cuts, "mode", "left")


def median_run(runs: DataFrame) -> DataFrame:
    """The run (run_id, p95) in the middle of its order by p95 and id; of an even number the earlier of the two."""
    n = runs.withColumn("place", F.row_number().over(Window.orderBy("p95", "run_id"))).withColumn("n", F.count("*").over(Window.partitionBy()))  # a row per run
    return n.where(F.col("place") == F.floor((F.col("n") + 1) / 2)).drop("place", "n")


def drift_rules(before: DataFrame, after: DataFrame, full: bool = False) -> DataFrame:
    """(rule, measure, hard, before, after, broken): all rules on the measures (measure, value) of two runs. Where a value that a rule needs
    is missing it isn't broken, but for ``valid``; rules for full runs are broken in these only."""
    spark = before.sparkSession
    table = [(r.rule, r.measure, r.kind, r.limit, r.hard, r.full_only) for r in RULES]
    rules = spark.createDataFrame(table, "rule string, measure string, kind string, limit double, hard boolean, full_only boolean")
    j = F.broadcast(rules).join(before.withColumnRenamed("value", "b"), "measure", "left").join(after.withColumnRenamed("value", "a"), "measure", "left")  # rules are fixed
    a, b, limit, kind = F.col("a"), F.col("b"), F.col("limit"), F.col("kind")
    broken = (
        F.when(kind == "none", a > 0)
        .when(kind == "floor", a < limit)
        .when(kind == "no_drop", a < b)
        .when(kind == "valid", F.coalesce(a != 1, F.lit(True)))
        .when(kind == "no_more", F.coalesce(a, F.lit(0.0)) > F.coalesce(b, F.lit(0.0)))
        .when(kind == "crossed", (b >= limit) & (a < limit))
        .when(kind == "rise", a - b > limit)
        .when(kind == "drop", b - a > limit)
        .when(kind == "relative", relative_rise(b, a) > limit)
        .when(kind == "latency", a - b > latency_limit(b, 5.0, LATENCY_PART))
    )
    broken = F.coalesce(broken, F.lit(False)) & (~F.col("full_only") | F.lit(full))
    return j.select("rule", "measure", "hard", b.alias("before"), a.alias("after"), broken.alias("broken"))


def report(rules: DataFrame, outcome: DataFrame) -> str:
    """The comparison as Markdown: the verdict and the broken rules, hard ones first. There are as many rows as rules."""
    status = outcome.first()
    out = [f"# Drift: {status['status']} (exit {status['exit_code']})", "", "| rule | level | before | after |", "|-|-|-|-|"]
    for r in sorted(rules.where("broken").collect(), key=lambda r: (not r["hard"], r["rule"])):
        out.append(f"| {r['rule']} | {'hard' if r['hard'] else 'soft'} | {r['before']} | {r['after']} |")
    return "\n".join(out) + "\n"


def verdict(rules: DataFrame) -> DataFrame:
    """(status, exit_code): FAIL 20 if a hard rule is broken, else WARN 10 if a soft one is, else PASS 0."""
    n = rules.agg(count_if(F.col("broken") & F.col("hard")).alias("hard"), count_if(F.col("broken") & ~F.col("hard")).alias("soft"))
    return n.select(F.when(F.col("hard") > 0, "FAIL").when(F.col("soft") > 0, "WARN").otherwise("PASS").alias("status"), F.when(F.col("hard") > 0, 20).when(F.col("soft") > 0, 10).otherwise(0).alias("exit_code"))


def pass_order(queries: DataFrame) -> DataFrame:
    """(query_id, pass, place): an order per pass that looks random and is the same in every run."""
    mixed = F.sha2(F.concat_ws("|", F.col("pass").cast("string"), F.col("query_id").cast("string")), 256)
    return queries.select("query_id", "pass", F.row_number().over(Window.partitionBy("pass").orderBy(mixed, "query_id")).cast("long").alias("place"))
