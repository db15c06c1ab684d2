"""Results of the text problems that must not be cut short."""

from datetime import datetime

from tessera.llm import fusion
from tessera.llm import queries as llm

T0 = datetime(2024, 1, 1)


def test_canonical_form_of_both_tables(spark, tmp_path):
    nodes = [("n1", "plain", T0), ("n2", "wide\u00a0space", T0), ("n3", None, T0), ("n1 ", "old", datetime(2023, 1, 1))]
    spark.createDataFrame(nodes, "node_id string, text string, ingested_at timestamp").write.parquet(f"{tmp_path}/nodes.parquet")
    chunks = [("c1", "| plain |", T0), ("c2", "| wide\u00a0\uff43ell |", T0), ("c3", None, T0), ("n2", "| same key |", T0)]
    spark.createDataFrame(chunks, "chunk_id string, table_md string, ingested_at timestamp").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {(r["table_name"], r["key"]): r["text"] for r in llm.p5_canonical(spark, str(tmp_path)).collect()}
    assert got == {
        ("nodes", "n1"): "plain",
        ("nodes", "n2"): "wide space",
        ("nodes", "n3"): None,
        ("chunks", "c1"): "| plain |",
        ("chunks", "c2"): "| wide cell |",
        ("chunks", "c3"): None,
        ("chunks", "n2"): "| same key |",
    }


def test_places_follow_shares_of_many_items(spark):
    n = 1_000_000
    shares = spark.createDataFrame([(1, f"i{i}", (1 + i / 10_000) / n, n) for i in range(9)], "query int, item string, share double, n long")
    assert {r["item"]: r["place"] for r in fusion.ranking(shares).collect()} == {f"i{i}": 9 - i for i in range(9)}
    assert [r["item"] for r in fusion.first_places(shares).collect()] == ["i8"]


def test_both_walks_give_the_number_of_items(spark, monkeypatch):
    rows = spark.createDataFrame([(q, f"i{i}", "s", float(i), 1) for q in (1, 2) for i in range(2 * q)], "query int, item string, scorer string, score double, at int")
    scorers = spark.createDataFrame([("s", True)], "scorer string, higher_is_better boolean")
    monkeypatch.setattr(fusion, "STEPS", 3)
    for hot_rows in (0, fusion.HOT_ROWS):
        shares = fusion.fuse(rows, scorers, hot_rows=hot_rows)
        assert {(r["query"], r["n"]) for r in shares.collect()} == {(1, 2), (2, 4)}
        assert [r["item"] for r in fusion.ranking(shares).where("query = 2").orderBy("place").collect()] == ["i3", "i2", "i1", "i0"]
