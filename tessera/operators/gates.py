"""Quality gates: measures held against limits, in two stages.

A check has one or more clauses. In stage A only hard clauses can fail it, in stage B all of them. A clause without a value is pending; a
check fails if a clause fails, else it is pending if one is pending, else it passes.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.quality import count_if
from tessera.sources.tables import small


@dataclass(frozen=True)
class Clause:
    """One condition of a check: the measure must be at most, or at least, the limit."""

    check: str
    measure: str
    limit: float
    at_most: bool = True
    hard: bool = True


def at_most(check: str, measure: str, limit: float = 0, hard: bool = True) -> Clause:
    return Clause(check, measure, float(limit), True, hard)


def at_least(check: str, measure: str, limit: float, hard: bool = True) -> Clause:
    return Clause(check, measure, float(limit), False, hard)


# The checks with their measures and limits.
CLAUSES = (
    at_most("Q-001", "gold_missing"),
    at_most("Q-002", "gold_page_mismatch"),
    at_most("Q-003", "gold_table_miss"),
    at_most("Q-004", "duplicate_chunks"),
    at_most("Q-005", "gold_exact_miss"),
    at_most("Q-006", "gold_term_miss"),
    at_most("Q-007", "gold_without_provenance"),
    at_most("Q-008", "schema_differences"),
    at_most("Q-009", "gold_lineage_incomplete"),
    at_most("Q-010", "gold_hierarchy_unmet"),
    at_most("Q-011", "sparse_row_ratio", 0.20),
    at_most("Q-012", "overloaded_row_ratio", 0.10),
    at_least("Q-013", "marker_sequence_coverage", 0.90),
    at_least("Q-014", "description_coverage", 0.90),
    at_least("Q-015", "marker_extraction_coverage", 0.95),
    at_least("Q-016", "marker_citation_accuracy", 0.90),
    at_least("Q-017", "paragraph_citation_accuracy", 0.90),
    at_most("Q-018", "structural_violations"),
    at_least("Q-019", "rated_ratio", 0.60),
    at_most("Q-019", "malformed_ratio", 0.10),
    at_most("Q-019", "outlier_ratio", 0.15),
    at_most("Q-020", "target_problems"),
    at_most("Q-021", "target_gold_missing"),
    at_most("Q-022", "stale_parts"),
    at_least("Q-023", "provenance_coverage", 1.0),
    at_most("Q-023", "unknown_backends"),
    at_least("Q-023", "text_replay", 0.999, hard=False),
    at_least("Q-023", "ocr_replay", 0.98, hard=False),
    at_most("Q-024", "invalid_labels"),
    at_most("Q-024", "invalid_ranges"),
    at_least("Q-024", "label_status_coverage", 1.0, hard=False),
    at_least("Q-024", "mapped_mappable_ratio", 0.98, hard=False),
    at_most("Q-025", "oversize_not_exempt", 0, hard=False),
    at_least("Q-025", "overlap_compliance", 0.95, hard=False),
    at_most("Q-025", "sequence_violations", 0, hard=False),
    at_least("Q-026", "list_completeness", 1.0, hard=False),
    at_most("Q-026", "depth_violations", 0, hard=False),
    at_most("Q-027", "invalid_spans"),
    at_least("Q-027", "cell_completeness", 1.0, hard=False),
    at_least("Q-027", "header_flag_ratio", 0.98, hard=False),
    at_least("Q-028", "rated_ratio", 0.85, hard=False),
    at_most("Q-028", "malformed_ratio", 0.05, hard=False),
    at_most("Q-028", "outlier_ratio", 0.08, hard=False),
    at_most("Q-028", "one_cell_ratio", 0.25, hard=False),
    at_most("Q-029", "noise_ratio", 0.50),
    at_most("Q-029", "noise_ratio", 0.001, hard=False),
    at_least("Q-030", "parity_top1", 0.99, hard=False),
    at_least("Q-030", "parity_top3", 1.0, hard=False),
    at_least("Q-030", "parity_pages", 0.99, hard=False),
    at_least("Q-031", "embedding_coverage", 0.98),
    at_least("Q-031", "embedding_coverage", 0.995, hard=False),
    at_most("Q-032", "stale_embedding_ratio", 0.02),
    at_most("Q-032", "stale_embedding_ratio", 0, hard=False),
    at_least("Q-033", "hybrid_ndcg", 0.72, hard=False),
    at_least("Q-034", "ndcg_uplift", 0.06, hard=False),
    at_least("Q-035", "exact_top1_rate", 1.0, hard=False),
    at_least("Q-036", "first_citation_parity", 1.0, hard=False),
    at_most("Q-037", "latency_ratio", 2.5, hard=False),
    at_most("Q-037", "hybrid_p95_ms", 500, hard=False),
    at_least("Q-038", "top10_determinism", 0.98, hard=False),
    at_least("Q-039", "pinpoint_at_1", 0.82, hard=False),
    at_least("Q-040", "table_row_at_1", 0.85, hard=False),
    at_most("Q-041", "anchor_mismatches", 0, hard=False),
    at_most("Q-042", "pinpoint_fallback_ratio", 0.20, hard=False),
    at_least("Q-043", "pinpoint_determinism", 0.98, hard=False),
    at_most("Q-044", "pinpoint_overhead_ms", 40, hard=False),
    at_least("Q-045", "hybrid_mrr", 0.90, hard=False),
    at_least("Q-046", "recall_delta", 0, hard=False),
    at_least("Q-047", "judged_at_10", 0.85, hard=False),
    at_most("Q-048", "uplift_p_value", 0.05, hard=False),
)


def clause_results(measures: DataFrame, stage: str, clauses: tuple[Clause, ...] = CLAUSES) -> DataFrame:
    """(check, measure, value, limit, hard, result) of every clause; a clause that isn't hard passes in stage A where it has a value."""
    if stage not in ("A", "B"):
        raise ValueError(f"no such stage: {stage}")
    spark = measures.sparkSession
    rows = [(c.check, c.measure, c.limit, c.at_most, c.hard) for c in clauses]
    table = small(spark, rows, check=pa.string(), measure=pa.string(), limit=pa.float64(), at_most=pa.bool_(), hard=pa.bool_())  # it is fixed
    joined = table.join(measures, "measure", "left")
    good = F.when(F.col("at_most"), F.col("value") <= F.col("limit")).otherwise(F.col("value") >= F.col("limit"))
    result = F.when(F.col("value").isNull(), "pending").when(good | (~F.col("hard") & F.lit(stage == "A")), "pass").otherwise("failed")
    return joined.select("check", "measure", "value", "limit", "hard", result.alias("result"))


def check_results(clauses: DataFrame, *by: str) -> DataFrame:
    """(by..., check, result, failing): the checks, with the measures that fail them."""
    failing = F.array_join(F.array_sort(F.collect_set(F.when(F.col("result") == "failed", F.col("measure")))), ",")
    worst = F.when(count_if(F.col("result") == "failed") > 0, "failed").when(count_if(F.col("result") == "pending") > 0, "pending").otherwise("pass")
    return clauses.groupBy(*by, "check").agg(worst.alias("result"), failing.alias("failing"))


def summary(results: DataFrame) -> DataFrame:
    """(total, passed, failed, pending, status): failed if any check failed, else partial if any is pending, else passed."""
    out = results.agg(F.count("*").alias("total"), count_if(F.col("result") == "pass").alias("passed"), count_if(F.col("result") == "failed").alias("failed"), count_if(F.col("result") == "pending").alias("pending"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "failed").when(F.col("pending") > 0, "partial").otherwise("passed"))
