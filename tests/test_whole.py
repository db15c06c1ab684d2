"""Results that must not be cut short."""

from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from tessera.plans import evaluation_queries, quality_queries

T0 = datetime(2024, 1, 1)


def test_nearest_ref_up_to_16_levels(spark, tmp_path):
    rows = [("top", None, "clause", "4.2", T0)]
    for levels in (4, 5, 16, 17):
        chain = ["top", *(f"{levels}-{i}" for i in range(1, levels)), f"cell{levels}"]
        rows += [(k, p, "table_cell" if k.startswith("cell") else "note", None, T0) for p, k in zip(chain, chain[1:])]
    rows += [("x", "y", "note", None, T0), ("y", "x", "note", None, T0), ("round", "x", "table_cell", None, T0), ("lost", "gone", "table_cell", None, T0)]
    spark.createDataFrame(rows, "node_id string, parent_node_id string, node_type string, ref string, ingested_at timestamp").write.parquet(f"{tmp_path}/nodes.parquet")
    got = {r["node_id"]: r["parent_ref"] for r in quality_queries.nearest_ref(spark, str(tmp_path)).collect()}
    assert got == {"cell4": "4.2", "cell5": "4.2", "cell16": "4.2", "cell17": None, "round": None, "lost": None}


def test_neighbourhood_of_256(spark, tmp_path):
    chunks = [(f"c{i:03d}", "d", "table" if i == 0 else "clause", f"{i}", None, None, None, i, None, None, T0) for i in range(300)]
    names = "chunk_id string, doc_id string, type string, ref string, heading string, text string, table_md string, page_pdf_start long, citation_anchor_id string, origin_node_id string, ingested_at timestamp"
    spark.createDataFrame(chunks, names).withColumn("page_pdf_end", F.col("page_pdf_start")).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([("d", 1, 2020, T0)], "doc_id string, part int, year int, ingested_at timestamp").write.parquet(f"{tmp_path}/docs.parquet")
    got = {r["chunk_id"]: r["place"] for r in quality_queries.judged_neighbourhood(spark, str(tmp_path)).collect()}
    assert got == {f"c{i:03d}": i + 1 for i in range(256)}

    queries = spark.createDataFrame([(1, "7", None, None)], "query_id long, query_text string, part_filter int, chunk_type_filter string")
    labels = evaluation_queries._labels(evaluation_queries.corpus(spark, str(tmp_path)), queries).collect()
    assert Counter(r["rel"] for r in labels) == {1: 255, 2: 1}
    assert {r["chunk_id"] for r in labels} == set(got)


def _pieces(spark, words, seqs):
    rows = [("d", "clause", "1.1", f"c{s}", s, "1.1 Title\n\n" + " ".join(w)) for s, w in zip(seqs, words)]
    return spark.createDataFrame(rows, "doc_id string, type string, ref string, chunk_id string, chunk_seq long, text string")


def test_overlap_and_gaps_of_clause_pieces(spark):
    from tessera.operators import quality

    first, second = [f"w{i}" for i in range(300)], [f"W{i}" for i in range(240, 520)]
    third, short = [f"w{i}" for i in range(600, 900)], ["x"] * 20
    pieces = _pieces(spark, [first, second, third, short], [1, 2, 4, 5])
    assert [(r["chunk_id"], r["overlap"]) for r in quality.overlap_words(pieces).collect()] == [("c2", 60)]
    assert [(r["chunk_id"], r["expected"]) for r in quality.sequence_gaps(pieces).collect()] == [("c4", 3)]
    got = {r["measure"]: r["value"] for r in quality.clause_split(pieces).collect()}
    assert got == {"longest_piece": 302, "oversize": 0, "oversize_not_exempt": 0, "overlap_pairs": 1, "overlap_compliant": 1, "sequence_violations": 1}
    late = _pieces(spark, [short], [3])
    assert [r["expected"] for r in quality.sequence_gaps(late).collect()] == [1]


def test_sentence_numbers_beyond_999(spark):
    from tessera.operators.pinpoint import sentence_units

    text = "".join(f"This is the sentence number {i:05d}. " for i in range(1, 1101))
    units = sentence_units(spark.createDataFrame([("c", text)], "chunk_id string, text string")).collect()
    ids = {r["unit_id"] for r in units}
    assert len(ids) == 1100 and {"c:sentence:001", "c:sentence:999", "c:sentence:1000", "c:sentence:1100"} <= ids


def test_positions_and_percentiles_of_a_hot_group(spark):
    import numpy as np

    from tessera.operators.ranks import percentiles, positions
    from tessera.sources.scratch import Scratch

    rng = np.random.default_rng(3)
    data = [("hot", float(v), i) for i, v in enumerate(rng.integers(0, 40, 500))] + [("one", 2.5, 0), ("none", None, 0), ("none", float("nan"), 1), (None, 1.0, 0)]
    df = spark.createDataFrame(data, "g string, v double, i long").repartition(7)
    scratch = Scratch(spark, "t")
    placed = positions(df, ["g"], [F.col("v"), F.col("i")], scratch).where("g = 'hot'").orderBy("place").collect()
    assert [r["place"] for r in placed] == list(range(1, 501)) and [(r["v"], r["i"]) for r in placed] == sorted((v, i) for g, v, i in data if g == "hot")
    got = {r["g"]: r for r in percentiles(df, "g", "v", {"p50": ("linear", 0.5), "p95": ("linear", 0.95), "p95n": ("nearest", 0.95)}, scratch).collect()}
    values = np.array([v for g, v, _ in data if g == "hot"])
    assert set(got) == {"hot", "one", None}
    assert np.isclose(got["hot"]["p50"], np.quantile(values, 0.5)) and np.isclose(got["hot"]["p95"], np.quantile(values, 0.95)) and got["hot"]["p95n"] == sorted(values)[int(np.ceil(500 * 0.95)) - 1]
    assert (got["one"]["p50"], got["one"]["p95n"]) == (2.5, 2.5)
    assert positions(df.limit(0), ["g"], [F.col("v")], scratch).count() == 0


def test_the_nearest_pages_of_a_crowded_document(spark):
    from tessera.operators.quality import nearest_pages

    pages = [3] * 300 + [4] * 5 + [9] * 700 + [None] * 4 + [2000]
    chunks = [("d", f"c{i:04d}", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(chunks, "doc_id string, chunk_id string, page_pdf_start long")
    for own, page in (("c0302", 4), ("c0800", 9), ("c1009", 2000), ("c1005", None)):
        seeds = spark.createDataFrame([("s", own, "d", page)], "seed string, chunk_id string, doc_id string, page long")
        got = [r["chunk_id"] for r in nearest_pages(df, seeds).orderBy("place").collect()]
        base = page or 0
        assert got == [c for _, c in sorted((-1 if c == own else 0 if p is None else abs(p - base), c) for _, c, p in chunks)][:256], own
