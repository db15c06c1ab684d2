"""Rules on two runs, snapshots, benchmark records and gates."""

from tessera.operators import drift as D
from tessera.operators import gates as G

MEASURES = "measure string, value double"


def broken(spark, before, after, full=False):
    rules = D.drift_rules(spark.createDataFrame(list(before.items()), MEASURES), spark.createDataFrame(list(({"benchmark_valid": 1.0} | after).items()), MEASURES), full)
    return {r["rule"] for r in rules.where("broken").collect()}


def test_every_rule(spark):
    quiet = {"citation_top1": 1.0, "lexical_top1": 0.96, "lexical_ndcg": 0.9, "semantic_candidates": 50.0, "lexical_p95_ms": 100.0, "hybrid_p95_ms": 10.0, "benchmark_failures": 1.0}
    assert broken(spark, quiet, quiet) == set() and broken(spark, {}, {}) == set()
    loud = {"new_failed_quick": 1.0, "new_failed_full": 2.0, "retrieval_determinism": 0.99, "pinpoint_determinism": 0.5, "benchmark_failures": 2.0, "benchmark_valid": 0.0}
    loud |= {"citation_top1": 0.99, "lexical_top1": 0.94, "semantic_top1": 0.1, "lexical_jaccard": 0.89, "semantic_jaccard": 0.5, "semantic_candidates": 61.0}
    loud |= {f"{m}_{r}": 0.06 for m in ("lexical", "semantic") for r in ("no_result_rate", "timeout_rate", "fallback_rate")}
    loud |= {"lexical_ndcg": 0.894, "lexical_recall": 0.1, "semantic_ndcg": 0.1, "hybrid_ndcg": 0.1, "hybrid_recall": 0.1, "hybrid_mrr": 0.1, "lexical_p95_ms": 111.0, "semantic_p95_ms": 9.0, "hybrid_p95_ms": 15.5}
    before = quiet | {"semantic_top1": 1.0, "lexical_recall": 0.5, "semantic_ndcg": 0.5, "hybrid_ndcg": 0.5, "hybrid_recall": 0.5, "hybrid_mrr": 0.5, "semantic_p95_ms": 2.0}
    before |= {f"{m}_{r}": 0.0 for m in ("lexical", "semantic") for r in ("no_result_rate", "timeout_rate", "fallback_rate")}
    assert broken(spark, before, loud, full=True) == {r.rule for r in D.RULES}
    assert {r.rule for r in D.RULES} - broken(spark, before, loud) == {"H-NEW-FAILED-CHECKS-FULL"}
    assert "S-BENCH-P95-LEXICAL" not in broken(spark, before, loud | {"lexical_p95_ms": 109.0})
    assert "H-LEXICAL-TOP1-HIT-FLOOR" not in broken(spark, before | {"lexical_top1": 0.9}, loud)


def test_verdict_and_report(spark):
    def rules(*levels):
        return spark.createDataFrame([(f"R{i}", "m", hard, 1.0, 0.5, hit) for i, (hard, hit) in enumerate(levels)], "rule string, measure string, hard boolean, before double, after double, broken boolean")

    for levels, want in ((((True, False), (False, False)), ("PASS", 0)), (((True, False), (False, True)), ("WARN", 10)), (((True, True), (False, True)), ("FAIL", 20))):
        table = rules(*levels)
        assert tuple(D.verdict(table).first())[:2] == want
    assert "| R0 | hard | 1.0 | 0.5 |" in D.report(table, D.verdict(table)) and D.report(table, D.verdict(table)).startswith("# Drift: FAIL (exit 20)")


def test_snapshots(spark):
    queries = spark.createDataFrame([(1, True), (2, False), (3, None)], "query_id int, must_hit_top1 boolean")
    hits = spark.createDataFrame([(1, f"c{i}", i) for i in range(1, 13)] + [(2, "c9", 1)], "query_id int, chunk_id string, rank int")
    expected = spark.createDataFrame([(1, "c1")], "query_id int, chunk_id string")
    snap = D.query_snapshot(hits, queries, expected)
    rows = {r["query_id"]: r for r in snap.collect()}
    assert rows[1]["returned"] == 12 and rows[1]["top"] == [f"c{i}" for i in range(1, 11)] and rows[3]["top"] == [] and rows[3]["top1"] is None
    got = {r["measure"]: r["value"] for r in D.snapshot_summary(snap, "x").collect()}
    assert abs(got["x_no_result_rate"] - 1 / 3) < 1e-12 and got["x_top1"] == 1.0 and abs(got["x_candidates"] - 13 / 3) < 1e-12
    other = D.query_snapshot(hits.where("query_id = 1 and rank > 5"), queries, expected)
    shared = {r["measure"]: r["value"] for r in D.overlap(snap, other, "x").collect()}
    assert abs(shared["x_jaccard"] - (5 / 10 + 0 + 1) / 3) < 1e-12 and abs(shared["x_top1_identity"] - 1 / 3) < 1e-12


def test_benchmark_records(spark):
    rows = [("m", "warmup", "error", 9.0, False)] + [("m", "timed", "ok", float(i), i == 1) for i in range(1, 101)] + [("n", "timed", "error", None, False), ("n", "timed", "ok", 3.0, False)]
    got = {r["mode"]: r for r in D.bench_summary(spark.createDataFrame(rows, "mode string, phase string, status string, latency_ms double, fallback_used boolean")).collect()}
    assert (got["m"]["queries"], got["m"]["failures"], got["m"]["valid"], got["m"]["p50"]) == (100, 0, True, 50.5) and abs(got["m"]["p95"] - 95.05) < 1e-9
    assert (got["n"]["failure_rate"], got["n"]["valid"], got["n"]["p99"]) == (0.5, False, 3.0)
    runs = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", 3.0), ("d", 9.0)], "run_id string, p95 double")
    assert D.median_run(runs).first()["run_id"] == "c"
    checks = lambda *x: spark.createDataFrame(list(x), "check string, result string")
    assert [r["check"] for r in D.newly_failing(checks(("Q1", "pass"), ("Q2", "failed")), checks(("Q1", "pending"), ("Q2", "failed"), ("Q3", "pass"))).collect()] == ["Q1"]


def test_clauses_and_stages(spark):
    clauses = (G.at_most("Q1", "a", 1), G.at_least("Q1", "b", 0.5, hard=False), G.at_most("Q2", "c"), G.at_least("Q3", "gone", 1))
    measures = spark.createDataFrame([("a", 1.0), ("b", 0.1), ("c", 2.0)], MEASURES)
    got = {s: {r["check"]: (r["result"], r["failing"]) for r in G.check_results(G.clause_results(measures, s, clauses)).collect()} for s in "AB"}
    assert got["A"] == {"Q1": ("pass", ""), "Q2": ("failed", "c"), "Q3": ("pending", "")} and got["B"]["Q1"] == ("failed", "b")
    assert len({c.check for c in G.CLAUSES}) == 48
    passed = G.check_results(G.clause_results(measures, "A", clauses[:2]))
    assert G.summary(passed).first()["status"] == "passed" and G.summary(passed.limit(0)).first()["total"] == 0
