"""The gates over all measures: what they share is made once."""

import os
from collections import Counter

import numpy as np
import pytest

from tessera.operators import retrieval as R

DATA = "/root/testdata/sf0.001"


def test_embedding_of_many_texts_is_that_of_each():
    texts = ["", None, "!?", "a", "a a a b", "The Valve shall close within 30 s.", "valve the", "x " * 700] + [f"w{i % 7} of {i % 5} parts, w{i % 3}" for i in range(600)]
    got = R.embed_all(texts)
    assert got.shape == (len(texts), R.DIMENSIONS) and (got == np.array([R.embed(t) for t in texts])).all()
    assert R.embed_all([]).shape == (0, R.DIMENSIONS)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_gates_make_current_rows_and_vectors_once(spark, monkeypatch, tmp_path):
    from tessera.plans import gate_queries, text_queries
    from tessera.sources import embeddings
    from tessera.sources.scratch import scope

    os.symlink(DATA, tmp_path / "d")  # a folder of which nothing is shared yet
    made, current, vectors = Counter(), text_queries.current_rows, embeddings.vectors
    # What the rankings give is tested by itself; here they'd only take time.
    monkeypatch.setattr(gate_queries, "_rankings", lambda spark, folder: spark.createDataFrame([], "measure string, value double"))
    monkeypatch.setattr(text_queries, "current_rows", lambda df, key, *more: made.update([key]) or current(df, key, *more))
    monkeypatch.setattr(embeddings, "vectors", lambda rows: made.update(["vectors"]) or vectors(rows))
    with scope():
        got = {r["measure"]: r["value"] for r in gate_queries.gate_measures(spark, str(tmp_path / "d")).collect()}
    assert made["node_id"] == made["chunk_id"] == 1 and made["vectors"] == 0
    assert got["cells"] > 0 and got["table_rows"] > 0 and 0 < got["embedding_coverage"] <= 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_rankings_search_once_and_store_no_vectors(spark, monkeypatch, tmp_path):
    from tessera.plans import evaluation_queries, search_queries
    from tessera.sources import embeddings
    from tessera.sources.scratch import scope
    from tessera.sources.tables import read

    os.symlink(DATA, tmp_path / "d")
    made, exact, vectors = Counter(), R.exact_tiers, embeddings.vectors
    monkeypatch.setattr(R, "exact_tiers", lambda *args: made.update(["exact"]) or exact(*args))
    monkeypatch.setattr(embeddings, "vectors", lambda rows: made.update(["vectors"]) or vectors(rows))
    with scope():
        assert evaluation_queries.rank_measures(spark, str(tmp_path / "d")).count() > 0
        assert made == {"exact": 1}
        # Embedded as they are read, chunks have the same scores as from the store.
        q = read(spark, DATA, "eval_queries")
        now = search_queries.semantic(spark, str(tmp_path / "d"), q, store=False).collect()
        assert made["vectors"] == 0
        stored = search_queries.semantic(spark, str(tmp_path / "d"), q).collect()
    assert made["vectors"] == 1 and now and sorted(now) == sorted(stored)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_gate_results_are_made_of_measures_that_the_driver_has(spark, monkeypatch, tmp_path):
    from tessera.plans import gate_queries
    from tessera.sources.scratch import Scratch, scope

    os.symlink(DATA, tmp_path / "d")
    kept, keep = [], Scratch.keep
    monkeypatch.setattr(gate_queries, "_rankings", lambda spark, folder: spark.createDataFrame([("hybrid_mrr", 0.9)], "measure string, value double"))
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name="t", by=None: kept.append(name) or keep(self, df, name, by))
    with scope():
        got = {(r["stage"], r["check"]): r["result"] for r in gate_queries.gate_results(spark, str(tmp_path / "d")).collect()}
    assert len(got) == 96 and got["A", "Q-045"] == got["B", "Q-045"] == "pass" and got["B", "Q-033"] == "pending"
    assert not {"of_gold", "plain", "measures"} & set(kept)


def test_node_measures_are_those_of_the_single_operators(spark):
    from tessera.operators import quality as Q

    fields = "node_id string, parent_node_id string, node_type string, list_depth int, list_marker_style string, item_index int, table_node_id string, row_idx int, col_idx int, is_header boolean, row_span int, col_span int"
    blank = [None] * 9
    rows = [
        ("d", None, "document", *blank),
        ("l", " d ", "list", *blank),
        ("i1", "l", "list_item", 1, "dash", 1, *[None] * 6),
        ("i2", "i1", "list_item", 2, "dash", None, *[None] * 6),
        ("i3", "i2", "list_item", 2, None, 1, *[None] * 6),  # not deeper than its parent
        ("i4", "d", "list_item", 3, None, 1, *[None] * 6),  # below no item
        ("i5", "gone", "list_item", 3, None, 1, *[None] * 6),
        ("i6", " ", "list_item", None, None, 1, *[None] * 6),
        ("t", "d", "table", *blank),
        ("r1", "t", "table_row", *blank),
        ("r2", "d", "table_row", *blank),
        ("c1", "r1", "table_cell", None, None, None, "t", 1, 1, True, 1, 1),
        ("c2", "r2", "table_cell", None, None, None, "t", 1, 1, None, 0, 1),
        ("c3", "r2", "table_cell", None, None, None, None, None, 2, False, 1, 1),
        ("c4", "t", "table_cell", None, None, None, "t", 2, 1, False, 1, 1),
        ("x", None, None, *blank),
    ]
    for held in (rows, []):
        nodes = spark.createDataFrame(held, fields)
        got = [tuple(r) for r in Q.node_measures(nodes, Q.count_if(Q.F.col("node_type") == "list").alias("lists")).collect()]
        single = Q.structural_invariants(nodes).unionByName(Q.list_semantics(nodes)).unionByName(Q.table_semantics(nodes))
        assert sorted(got) == sorted([tuple(r) for r in single.collect()] + [("lists", 1.0 if held else 0.0)])
        if held:
            assert {"depth_violations": 2.0, "dangling_parent": 1.0, "missing_parent": 1.0, "one_cell_rows": 1.0, "invalid_spans": 1.0, "invalid_list_item_parent": 1.0, "invalid_table_row_parent": 1.0, "invalid_table_cell_parent": 1.0}.items() <= dict(got).items()


def test_current_rows_count_the_rows_of_a_key(spark):
    from tessera.sources.tables import current_rows

    rows = spark.createDataFrame([("a", 1, 1), (" a", 1, 1), ("b", 1, 1), (" ", 1, 1)], "k string, ingested_at int, v int")
    assert sorted(tuple(r) for r in current_rows(rows, "k", ["v"], copies="copies").collect()) == [("a", 1, 1, 2), ("b", 1, 1, 1)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_gates_make_documents_once(spark, monkeypatch, tmp_path):
    from tessera.plans import gate_queries, text_queries
    from tessera.sources.scratch import scope

    os.symlink(DATA, tmp_path / "d")
    made, current = Counter(), text_queries.current_rows
    monkeypatch.setattr(gate_queries, "_rankings", lambda spark, folder: spark.createDataFrame([], "measure string, value double"))
    monkeypatch.setattr(text_queries, "current_rows", lambda df, key, *more: made.update([key]) or current(df, key, *more))
    with scope():
        gate_queries.gate_measures(spark, str(tmp_path / "d"))
    assert made["doc_id"] == 1
