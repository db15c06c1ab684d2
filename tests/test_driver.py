"""Answers to single queries, the store of embeddings, and what is left behind."""

import json
import os
from datetime import datetime

import pytest

from tessera.operators import driver
from tessera.operators import retrieval as R
from tessera.sources import embeddings as E
from tessera.sources import scratch
from tessera.sources.scratch import Scratch

T0 = datetime(2024, 1, 1)
CHUNK = "chunk_id string, doc_id string, type string, ref string, heading string, text string, table_md string, page_pdf_start long, page_pdf_end long, citation_anchor_id string, origin_node_id string, leaf_node_type string, ancestor_path string, anchor_type string, anchor_label_norm string, part int, year int"
NODE = "node_id string, parent_node_id string, node_type string, ref string, heading string, order_index long, page_pdf_start long, page_pdf_end long, text string, row_idx long, col_idx long, table_node_id string, citation_anchor_id string, part int"


@pytest.fixture(scope="module")
def world(spark):
    chunks = spark.createDataFrame(
        [
            ("c1", "d", "clause", "9.1", "9.1 Unit review", "9.1 Unit review\n\nThe unit review shall find faults early. It is recorded.", None, 3, 4, "d:9_1", "n1", "clause", "document:D > clause:9.1", "clause", None, 6, 2018),
            ("c2", "d", "table", "Table 3", "Methods", None, "| Method | A |\n|---|---|\n| 1a Review | ++ |", 5, 5, "d:table_3", None, "table", None, "clause", None, 6, 2018),
            ("c3", "d", "clause", "9.1.1", "9.1.1 Scope", "short", None, None, None, None, None, None, None, "marker", "b", 6, None),
        ],
        CHUNK,
    )
    nodes = spark.createDataFrame([("n0", None, "clause", "9", "9", 1, 1, 9, "x", None, None, None, None, 6), ("n1", "n0", "clause", "9.1", "h", 2, 3, 4, "unit", None, None, None, None, 6), ("n2", "n1", "paragraph", None, None, 3, 3, 3, "The unit review", None, None, None, None, 6)], NODE)
    s = Scratch(spark, "world")
    index = R.build_index(chunks, s)
    model = E.model_of()
    store = s.keep(E.embed_run(chunks, E.empty_store(spark), model), "store")
    return chunks, nodes, index, store, E.register(spark, None, model)


def test_exact_intent_is_lexical_in_every_mode(world):
    chunks, nodes, index, store, models = world
    got = driver.answer(driver.Ask("9.1", mode="hybrid", model_id=E.DEFAULT_MODEL, with_ancestors=True, with_descendants=True, with_pinpoint=True, timeout_ms=0), chunks, nodes, index, store, models)
    assert got["retrieval"]["effective_mode"] == "lexical" and got["retrieval"]["exact_intent_forced_lexical"]
    first = got["results"][0]
    assert first["chunk_id"] == "c1" and first["citation"] == "RDS 6:2018, 9.1, PDF pages 3-4" and first["parent_ref"] == "9"
    assert first["ancestors"] == ["document:D", "clause:9.1"] and [d["node_id"] for d in first["descendants"]] == ["n2"] and first["kinds"] == {"paragraph": 1}
    assert first["pinpoints"] and got["results"][1]["citation"].endswith("9.1.1(b), PDF pages unknown")
    assert json.loads(driver.as_json(got))["returned"] == got["returned"]
    text = driver.as_text(got)
    assert "1.\tRDS 6:2018\tclause\t9.1\tpages 3-4" in text and "\tpinpoint[1]: type=" in text


def test_hybrid_fallback_and_errors(world):
    chunks, nodes, index, store, models = world
    ask = driver.Ask("unit review", mode="hybrid", model_id=E.DEFAULT_MODEL, timeout_ms=0)
    got = driver.answer(ask, chunks, nodes, index, store, models)
    assert got["retrieval"]["effective_mode"] == "hybrid" and got["results"][0]["chunk_id"] == "c1" and "ancestors" not in got["results"][0]
    with pytest.raises(LookupError, match="no_store"):
        driver.answer(ask, chunks, nodes, index)
    from dataclasses import replace

    lexical = driver.answer(replace(ask, allow_fallback=True), chunks, nodes, index, store.limit(0), models)
    assert lexical["retrieval"]["fallback_used"] and lexical["retrieval"]["fallback_reason"] == "no_embeddings" and lexical["retrieval"]["effective_mode"] == "lexical"
    with pytest.raises(ValueError, match="model"):
        driver.answer(replace(ask, model_id=None), chunks, nodes, index)
    with pytest.raises(TimeoutError):
        driver.answer(replace(ask, mode="lexical", timeout_ms=1), chunks, nodes, index)
    with pytest.raises(ValueError, match="empty"):
        driver.Ask("  ").checked()
    assert driver.Ask("x", lexical_k=9999, limit=0, node_type="  ", max_units=99).checked() == driver.Ask("x", lexical_k=256, limit=1, max_units=12)


def test_node_filter_brings_nodes(world):
    chunks, nodes, index, *_ = world
    got = driver.answer(driver.Ask("unit review", node_type="Paragraph", timeout_ms=0), chunks, nodes, index)
    assert "node::n2" in [r["chunk_id"] for r in got["results"]]


def test_store_runs_make_only_what_is_stale(spark, world, tmp_path):
    chunks, _, _, store, models = world
    model = E.model_of()
    assert store.count() == 3 and E.status(store, models, model) == (True, "available")
    assert E.status(store, models, E.model_of("other")) == (False, "model_not_registered")
    changed = chunks.withColumn("text", chunks["text"].substr(1, 20))
    report = {r["measure"]: r["value"] for r in E.run_report(changed, store, E.embed_run(changed, store, model), model).collect()}
    assert report["stale_before"] == 1 and report["stale_after"] == 0 and report["embedded"] == 3
    again = E.embed_run(chunks, store, E.model_of("second"), types=("table",))
    assert again.count() == 4 and E.register(spark, models, model).count() == 1
    assert E.decode(E.encode([0.5, -2.0]), 2) == [0.5, -2.0] and E.decode(b"abc", 2) is None
    assert E.config_lock(model, f"{tmp_path}/lock.json") == E.config_lock(model, f"{tmp_path}/again.json") and os.path.exists(f"{tmp_path}/lock.json")
    with pytest.raises(ValueError):
        E.chunk_types(["clause", "page"])
    assert E.chunk_types([" Clause ", ""]) == ("clause",)


def test_snippets_and_phrases(spark, world):
    chunks, _, index, *_ = world
    q = spark.createDataFrame([(1, "faults early", None, None)], "query_id int, query_text string, part_filter int, chunk_type_filter string")
    hits = R.bm25(index, q)
    assert [r["chunk_id"] for r in hits.collect()] == ["c1"]
    assert R.snippets(hits, chunks, q, 4).first()["snippet"] == " ... [faults] [early.] It is ... "
    laps = spark.createDataFrame([("x", "d", "clause", "1.1.1", None, "1.1.1.1", None, 1)], "chunk_id string, doc_id string, type string, ref string, heading string, text string, part int, page_pdf_start long")
    one = spark.createDataFrame([(1, "1.1", None, None)], "query_id int, query_text string, part_filter int, chunk_type_filter string")
    assert R.bm25(R.build_index(laps, Scratch(spark, "t")), one).count() == 1
    assert R.bm25(R.build_index(laps.limit(0), Scratch(spark, "t")), one).count() == 0


def test_a_scope_leaves_nothing(spark, world):
    chunks, nodes, index, *_ = world
    before = set(scratch._live)
    with scratch.scope():
        driver.answer(driver.Ask("unit review", timeout_ms=0), chunks, nodes, index)
        made = [p for p in scratch._live if p not in before]
        assert made
    assert set(scratch._live) == before and not any(os.path.exists(p.removeprefix("file://")) for p in made)
