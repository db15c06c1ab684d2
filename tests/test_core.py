import random
from datetime import datetime, timedelta

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators.hierarchy import descendants, hierarchy
from tessera.operators import orphans as orphans_module
from tessera.operators.orphans import Table, orphan_counts, orphans
from tessera.sources.scratch import Scratch
from tessera.sources.tables import current_rows, key_of

T0 = datetime(2024, 1, 1)


def test_key_of_trims_any_white_space(spark):
    rows = spark.createDataFrame([(" a\t",), (" ",), (None,), ("b",)], "k string")
    assert [r[0] for r in rows.select(key_of("k")).collect()] == ["a", None, None, "b"]


def test_current_rows_takes_latest_and_ignores_other_columns(spark):
    rows = [("a ", 1, T0, "x"), ("a", 2, T0 + timedelta(1), None), ("a", 2, T0 + timedelta(1), None), (None, 3, T0, "y"), (" ", 4, T0, "y"), ("b", None, None, "z")]
    df = spark.createDataFrame(rows, "id string, v int, ingested_at timestamp, __row string")
    got = {r["id"]: (r["v"], r["first"]) for r in current_rows(df, "id", ["v"], arrival="first").collect()}
    assert got == {"a": (2, T0), "b": (None, None)}
    assert current_rows(df.limit(0), "id", ["v"]).count() == 0


def brute(nodes):
    parent = dict(nodes)
    out = {}
    for k in parent:
        way, at = [k], parent[k]
        while at is not None and at in parent and at not in way:
            way.append(at)
            at = parent[at]
        if at in way:
            loop = way[way.index(at) :]
            out[k] = ("cycle", min(loop), None)
        else:
            out[k] = ("dangling" if at is not None else "rooted", way[-1], " > ".join(reversed(way)))
    return out


def tree(spark, nodes, **more):
    df = spark.createDataFrame(nodes, "node_id string, parent_node_id string").withColumn("path", F.lit("clash")).withColumn("id", F.lit(0))
    return hierarchy(df, "node_id", "parent_node_id", F.col("node_id"), **more)


def test_hierarchy_against_brute_force(spark):
    rng = random.Random(1)
    nodes = [("r", None), ("lone", " "), ("orphan", "gone"), ("under", "orphan"), ("c1", "c3"), ("c2", "c1"), ("c3", "c2"), ("tail", "c2"), ("self", "self"), ("t2", "tail")]
    names = ["r"]
    for i in range(150):
        nodes.append((f"n{i}", rng.choice(names[-8:] + names[:1] * 4)))
        names.append(f"n{i}")
    nodes += [(f"deep{i}", f"deep{i - 1}" if i else "r") for i in range(140)]
    want = brute([(k, None if p is None or not p.strip() else p) for k, p in nodes])
    got = tree(spark, nodes).collect()
    assert {r["node_id"]: (r["status"], r["top_node"], r["path"]) for r in got} == want
    first = {r["node_id"]: r for r in got}
    for r in got:
        below = {k for k, (_, top, path) in want.items() if path and r["path"] and top == r["top_node"] and path.startswith(r["path"] + " > ")}
        inside = {k for k, o in first.items() if o["pos_first"] is not None and r["pos_first"] is not None and o["top_node"] == r["top_node"] and r["pos_first"] < o["pos_first"] <= r["pos_last"]}
        assert below == inside, r
    pairs = {(r["node_id"], r["descendant"]): r["distance"] for r in descendants(tree(spark, nodes), "node_id").collect()}
    assert len(pairs) == sum(r["depth"] or 0 for r in got)
    assert pairs["r", "deep139"] == 140


def test_hierarchy_of_nothing_and_of_nulls(spark):
    assert tree(spark, []).count() == 0
    got = tree(spark, [(None, "a"), ("", None), ("a", None)]).collect()
    assert [(r["node_id"], r["depth"], r["pos_first"], r["pos_last"]) for r in got] == [("a", 0, 0, 0)]


def test_hierarchy_of_one_hot_parent(spark):
    got = tree(spark, [("hub", None)] + [(f"x{i}", "hub ") for i in range(3000)]).agg(F.count("*"), F.countDistinct("pos_first"), F.max("pos_last")).first()
    assert tuple(got) == (3001, 3001, 3000)


def test_orphans_by_reason(spark):
    day = lambda n: T0 + timedelta(n)
    nodes = spark.createDataFrame(
        [("a", None, "d1", day(1)), ("b", "a ", "d1", day(1)), ("c", "zz", "d2", day(1)), ("d", "late", "d1", day(1)), ("late", None, " ", day(5)), ("e", "gone", "d1", day(1)), ("gone", None, "d1", day(1)), ("back", None, "d1", day(9)), ("f", "back", "d1", day(9)), ("a", None, "d1", day(1)), (None, "zz", "d9", day(1))],
        "node_id string, parent_node_id string, doc_id string, ingested_at timestamp",
    )
    docs = spark.createDataFrame([("d1", day(0))], "doc_id string, ingested_at timestamp")
    removals = spark.createDataFrame([("nodes", "gone", day(2)), ("nodes", "back", day(3)), ("nodes", "never", day(3)), ("docs", "a", day(3))], "table_name string, record_key string, removed_at timestamp")
    tables = [(Table("nodes", "node_id", [("parent_node_id", "nodes"), ("doc_id", "docs")]), nodes), (Table("docs", "doc_id"), docs)]
    got = {(r["field_name"], r["record_key"], r["reason"]) for r in orphans(tables, removals).collect()}
    assert got == {("parent_node_id", "c", "missing"), ("doc_id", "c", "missing"), ("parent_node_id", "d", "late"), ("parent_node_id", "e", "removed")}
    assert orphans([(t, rows.limit(0)) for t, rows in tables], removals.limit(0)).count() == 0
    assert orphan_counts([(t, rows.limit(0)) for t, rows in tables], removals.limit(0)).count() == 0


def test_orphan_counts_are_those_of_the_single_orphans(spark, monkeypatch):
    rng = random.Random(8)
    day = lambda n: T0 + timedelta(n)
    rows = [(f"n{i}", rng.choice(["hub", "hub", f"n{rng.randint(0, 80)}", "gone", "nowhere", None, " "]), rng.choice(["d1", "d2", "late"]), day(rng.randint(0, 90))) for i in range(300)] + [("hub", None, "d1", day(45)), ("gone", None, "d1", day(1))]
    nodes = spark.createDataFrame(rows, "node_id string, parent_node_id string, doc_id string, ingested_at timestamp")
    docs = spark.createDataFrame([("d1", day(0)), ("late", day(50))], "doc_id string, ingested_at timestamp")
    removals = spark.createDataFrame([("nodes", "gone", day(60)), ("nodes", "n7", day(99))], "table_name string, record_key string, removed_at timestamp")
    tables = [(Table("nodes", "node_id", [("parent_node_id", "nodes"), ("doc_id", "docs")]), nodes), (Table("docs", "doc_id"), docs)]
    month = F.date_format("referred_at", "yyyy-MM").alias("month")
    want = sorted(map(str, orphans(tables, removals).groupBy("table_name", "field_name", "reason", month).agg(F.count("*").alias("orphans")).collect()))
    for share in (1000, 4, 1):  # nearly all keys heavy, a few, none
        monkeypatch.setattr(orphans_module, "HEAVY_SHARE", share)
        assert sorted(map(str, orphan_counts(tables, removals).collect())) == want and len(want) > 10


def test_scratch_keeps_partitions_and_drops(spark):
    s = Scratch(spark, "t")
    kept = s.keep(spark.range(10).withColumn("odd", F.col("id") % 2 == 1), by="odd")
    assert kept.where("odd").count() == 5 and kept.columns == ["id", "odd"]
    s.drop(kept)


@given(st.lists(st.integers(0, 9), max_size=12))
def test_brute_force_ends(parents):
    nodes = [(str(i), str(p) if p != i else None) for i, p in enumerate(parents)]
    assert len(brute(nodes)) == len(nodes)
