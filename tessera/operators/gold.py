"""Evaluation of stated references: where each is found now, and whether it still is what it is expected to be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.quality import count_if, unpivot
from tessera.sources.scratch import Scratch

#: Optional expectations; a null one is met.
EXPECTED = ("leaf_node_type", "anchor_type", "anchor_label_norm")


def evaluate(gold: DataFrame, chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gold_id, doc_id, ref, tier, found_id, page_start, page_end, pages_ok, table_ok, terms_ok, provenance, lineage, hierarchy_ok, status).

    ``gold`` has (gold_id, doc_id, ref, page_start, page_end, terms array, min_rows, and the optional expectations). A reference is looked
    for among the chunks of its document, then its nodes, exactly, then contained; the first such kind has it, of it the first by page (null
    first) and key. References of documents without chunks are skipped: their tier is null and their status ``skip``. A row passes if it is
    found, any of its terms is in the text (or none is asked for) and its expectations are met.
    """
    evaluable = chunks.select("doc_id").distinct()
    wanted = gold.select("doc_id", F.lower(F.btrim("ref")).alias("want")).where("want != ''").distinct().join(evaluable, "doc_id", "left_semi")
    fields = ["page_pdf_start", "page_pdf_end", "source_hash", "leaf_node_type", "ancestor_path", "anchor_type", "anchor_label_norm"]
    of_chunks = chunks.select(F.col("chunk_id").alias("found_id"), "origin_node_id", "type", "text", *fields)
    of_nodes = nodes.select(F.col("node_id").alias("found_id"), F.col("node_id").alias("origin_node_id"), F.col("node_type").alias("type"), "text", "page_pdf_start", "page_pdf_end", "source_hash", F.col("node_type").alias("leaf_node_type"), "ancestor_path", "anchor_type", "anchor_label_norm")
    # Each distinct reference of a document is looked for once, by keys and references only.
    places = [df.select("doc_id", F.col(key).alias("id"), F.lower("ref").alias("r"), F.lit(kind).alias("kind"), "page_pdf_start") for df, key, kind in ((chunks, "chunk_id", 0), (nodes, "node_id", 1))]
    held = wanted.join(places[0].unionByName(places[1]), "doc_id").where(F.contains(F.col("r"), F.col("want")))
    tier = F.col("kind") + F.when(F.col("r") == F.col("want"), 0).otherwise(2)
    best = held.groupBy("doc_id", "want").agg(F.min(F.struct(tier.alias("tier"), F.coalesce("page_pdf_start", F.lit(-1)).alias("page"), "kind", "id")).alias("b")).select("doc_id", "want", F.col("b.tier").cast("long").alias("tier"), F.col("b.kind").alias("kind"), F.col("b.id").alias("found_id"))
    best = best.withColumnsRenamed({"doc_id": "f_doc", "want": "f_want"})
    rows = gold.select("gold_id", F.col("doc_id"), "ref", F.col("page_start").alias("want_start"), F.col("page_end").alias("want_end"), "terms", *[F.col(e).alias(f"want_{e}") for e in EXPECTED])
    rows = rows.join(evaluable.withColumn("evaluable", F.lit(True)), "doc_id", "left").join(best, (F.col("doc_id") == F.col("f_doc")) & (F.lower(F.btrim("ref")) == F.col("f_want")), "left").drop("f_doc", "f_want")
    # What was found is joined by itself for chunks and nodes, with its long fields once; the kinds are written, so their sizes are known.
    scratch = Scratch(gold.sparkSession, "gold")
    rows = scratch.keep(rows, "rows")
    kinds = [scratch.keep(rows.where(F.col("kind") == kind), name) for kind, name in ((0, "of_chunks"), (1, "of_nodes"))]
    rows = kinds[0].join(of_chunks, "found_id").unionByName(kinds[1].join(of_nodes, "found_id")).unionByName(rows.where("kind is null"), allowMissingColumns=True)
    found = F.col("tier").isNotNull()
    low = F.lower(F.coalesce("text", F.lit("")))
    terms = (F.size("terms") == 0) | F.exists("terms", lambda t: F.contains(low, F.lower(t)))
    met = F.lit(True)
    for e in EXPECTED:
        met = met & F.coalesce(F.lower(e) == F.lower(f"want_{e}"), F.col(f"want_{e}").isNull())
    filled = F.lit(True)
    for c in ("origin_node_id", "leaf_node_type", "ancestor_path"):
        filled = filled & (F.coalesce(F.btrim(c), F.lit("")) != "")
    pages = F.col("want_start").isNull() | (F.col("page_pdf_start").eqNullSafe(F.col("want_start")) & F.col("page_pdf_end").eqNullSafe(F.col("want_end")))
    out = rows.select(
        "gold_id",
        "doc_id",
        "ref",
        F.coalesce("evaluable", F.lit(False)).alias("evaluable"),
        "tier",
        "found_id",
        (found & pages).alias("pages_ok"),
        (found & (~F.startswith(F.lower("ref"), F.lit("table ")) | (F.col("type") == "table"))).alias("table_ok"),
        (found & terms).alias("terms_ok"),
        (found & F.col("page_pdf_start").isNotNull() & F.col("page_pdf_end").isNotNull() & F.col("source_hash").isNotNull()).alias("provenance"),
        (found & filled).alias("lineage"),
        (found & met).alias("hierarchy_ok"),
    )
    return out.withColumn("status", F.when(~F.col("evaluable"), "skip").when(F.col("terms_ok") & F.col("hierarchy_ok"), "pass").otherwise("fail"))


def measures(evaluated: DataFrame) -> DataFrame:
    """(measure, value): evaluable references and what is amiss with them."""
    rows = evaluated.where("evaluable")
    found = F.col("tier").isNotNull()
    return unpivot(
        rows.agg(
            F.count("*").alias("gold_total"),
            count_if(~found).alias("gold_missing"),
            count_if(found & ~F.col("pages_ok")).alias("gold_page_mismatch"),
            count_if(~F.col("table_ok")).alias("gold_table_miss"),
            count_if(~F.coalesce(F.col("tier") <= 1, F.lit(False))).alias("gold_exact_miss"),
            count_if(~F.col("terms_ok")).alias("gold_term_miss"),
            count_if(found & ~F.col("provenance")).alias("gold_without_provenance"),
            count_if(~F.col("lineage")).alias("gold_lineage_incomplete"),
            count_if(~F.col("hierarchy_ok")).alias("gold_hierarchy_unmet"),
        )
    )
