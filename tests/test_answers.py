"""Passages out of large tables, and answers of queries that are alike."""

import os
from collections import defaultdict

import pytest

from tessera.operators import pinpoint as P
from tessera.plans import evaluation_queries, search_queries

DATA = "/root/testdata/sf0.001"


def test_all_rows_of_a_large_table_are_looked_at(spark):
    chunks = spark.createDataFrame([("c", "t", None, "Some text of the table.", "a:b")], "chunk_id string, origin_node_id string, table_md string, text string, citation_anchor_id string")
    cells = [(f"n{i:04d}", "table_row" if i % 2 else "table_cell", f"entry {'wanted' if i == 1300 else 'other'}", i, None, "t", "a:b") for i in range(1400)]
    nodes = spark.createDataFrame(cells, "node_id string, node_type string, text string, row_idx long, col_idx long, table_node_id string, citation_anchor_id string")
    assert P.table_units(chunks, nodes).count() == 1400
    queries = spark.createDataFrame([(1, "wanted entry")], "query_id long, query_text string")
    best = P.pinpoint(spark.createDataFrame([(1, "c")], "query_id long, chunk_id string"), chunks, nodes, queries).where("place = 1").collect()
    assert [r["unit_id"] for r in best] == ["n1300"]


@pytest.fixture(scope="module")
def doubled(spark, tmp_path_factory):
    """The smallest tables, with every evaluation query twice."""
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    folder = tmp_path_factory.mktemp("doubled")
    for name in os.listdir(DATA):
        if name != "eval_queries.parquet":
            os.symlink(f"{DATA}/{name}", folder / name)
    q = spark.read.parquet(f"{DATA}/eval_queries.parquet")
    q.unionByName(q.withColumn("query_id", (q["query_id"] + 1_000_000).cast(q.schema["query_id"].dataType))).write.parquet(f"{folder}/eval_queries.parquet")
    return str(folder)


SEARCHES = {
    "search_lexical": (search_queries.search_lexical, "lexical"),
    "search_hybrid": (search_queries.search_hybrid, "semantic"),
    "search_router": (search_queries.search_router, "lexical"),
    "search_answers": (search_queries.search_answers, "lexical"),
    "rank_measures": (evaluation_queries.rank_measures, "lexical"),
    "rank_jaccard": (evaluation_queries.rank_jaccard, None),
    "pinpoint_scored": (evaluation_queries.pinpoint_scored, "lexical"),
}


@pytest.mark.parametrize("name", SEARCHES)
def test_alike_queries_are_searched_once_and_all_answered(spark, doubled, monkeypatch, name):
    run, side = SEARCHES[name]
    asked = []
    for module in (search_queries, evaluation_queries):
        for what in {side} - {None}:
            real = getattr(search_queries, what)
            monkeypatch.setattr(module, what, lambda s, folder, q, real=real: asked.append(q.count()) or real(s, folder, q))
    if side is None:
        real = evaluation_queries.R.bm25
        monkeypatch.setattr(evaluation_queries.R, "bm25", lambda index, q: asked.append(q.count()) or real(index, q))
    got = defaultdict(set)
    for r in run(spark, doubled).collect():
        got[r["query_id"]].add(str([r[c] for c in r.__fields__ if c != "query_id"]))
    assert got and all(got[k] == got[k + 1_000_000] for k in list(got) if k < 1_000_000) and len([k for k in got if k >= 1_000_000]) * 2 == len(got)
    queries = spark.read.parquet(f"{doubled}/eval_queries.parquet")
    assert asked and max(asked) <= queries.select("query_text", "part_filter", "chunk_type_filter").distinct().count() < queries.count()
