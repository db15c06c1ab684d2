"""Queries of the gold evaluation and of the gates over all measures that the tables give."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import evaluation as V
from tessera.operators import gates as G
from tessera.operators import gold
from tessera.operators import quality as Q
from tessera.plans import evaluation_queries as EV
from tessera.plans import quality_queries as QQ
from tessera.plans import report_queries as RP
from tessera.plans import search_queries as SE
from tessera.plans import source_queries as SO
from tessera.plans.structure import current_sql, key_sql
from tessera.plans.text_queries import cur
from tessera.sources.scratch import Scratch
from tessera.sources.tables import current_rows, key_of, read, small

_GOLD_FIELDS = ["doc_id", "type", "ref", "heading", "text", "page_pdf_start", "page_pdf_end", "source_hash", "origin_node_id", "leaf_node_type", "ancestor_path", "anchor_type", "anchor_label_norm"]


#: What the queries of the gates read of the current rows, and of the first rows of the chunks.
_NODES = [*QQ.NODE_FIELDS, "ref", "text", "page_pdf_start", "page_pdf_end", "source_hash", "ancestor_path", "anchor_type", "anchor_label_norm", "anchor_order", "citation_anchor_id"]
_CHUNKS = [*SE.CHUNK_FIELDS, "chunk_seq", "page_printed_start", "page_printed_end", "source_hash"]
_FIRST = [*_GOLD_FIELDS, "table_md"]


def _held(spark: SparkSession, folder: str, scratch: Scratch) -> dict[str, DataFrame]:
    """The current chunks and documents, each made once for all measures; the chunks have the words of clauses and how many rows there are of
    each."""
    words = F.when(F.col("type") == "clause", X.word_count(F.col("text")))
    return {
        "chunks": scratch.keep(cur(spark, folder, "chunks", _CHUNKS, copies="copies").withColumn("words", words), "chunks"),
        "docs": scratch.keep(cur(spark, folder, "docs", ["part", "year"]), "docs"),
    }


def _first(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    return current_rows(read(spark, folder, "chunks").withColumn("minus", -F.unix_micros("ingested_at")), "chunk_id", columns, order="minus").drop("minus")


def gold_evaluation(spark: SparkSession, folder: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """The references that the evaluation set names, as the chunks that had them first state them, against the current rows."""
    wanted = read(spark, folder, "eval_queries").where("intent = 'exact_ref'").select(F.lower(F.btrim("query_text")).alias("want")).distinct()
    first = held["first_chunks"] if held else _first(spark, folder, _GOLD_FIELDS)
    rows = first.join(wanted, F.lower(F.btrim("ref")) == F.col("want"), "left_semi").where(key_of("doc_id").isNotNull())
    terms = F.slice(F.filter(F.split(F.lower(F.coalesce("heading", F.lit(""))), "[^a-z]+"), lambda t: F.length(t) > 3), 1, 3)
    expected = rows.select(F.col("chunk_id").alias("gold_id"), key_of("doc_id").alias("doc_id"), "ref", F.col("page_pdf_start").alias("page_start"), F.col("page_pdf_end").alias("page_end"), terms.alias("terms"), "leaf_node_type", "anchor_type", "anchor_label_norm")
    chunks = cur(spark, folder, "chunks", _GOLD_FIELDS, held).withColumn("doc_id", key_of("doc_id"))
    nodes = cur(spark, folder, "nodes", ["doc_id", "node_type", "ref", "text", "page_pdf_start", "page_pdf_end", "source_hash", "ancestor_path", "anchor_type", "anchor_label_norm"], held).withColumn("doc_id", key_of("doc_id"))
    return gold.evaluate(expected, chunks, nodes)


_DOC = key_sql("doc_id")
GOLD_EVAL_SQL = rf"""WITH w AS (SELECT DISTINCT lower(trim(query_text)) AS want FROM eval_queries WHERE intent = 'exact_ref'),
f AS (SELECT {key_sql('chunk_id')} AS gold_id, {_DOC} AS doc_id, ref, page_pdf_start AS ws, page_pdf_end AS we, list_filter(regexp_split_to_array(lower(coalesce(heading, '')), '[^a-z]+'), lambda t: length(t) > 3)[1:3] AS terms, leaf_node_type AS wl, anchor_type AS wa, anchor_label_norm AS wn
  FROM (SELECT *, row_number() OVER (PARTITION BY {key_sql('chunk_id')} ORDER BY ingested_at) AS rn FROM chunks WHERE {key_sql('chunk_id')} IS NOT NULL) WHERE rn = 1 AND lower(trim(ref)) IN (SELECT want FROM w) AND {_DOC} IS NOT NULL),
c AS MATERIALIZED (SELECT k AS id, {_DOC} AS doc, lower(ref) AS r, 0 AS kind, origin_node_id, type, text, page_pdf_start, page_pdf_end, source_hash, leaf_node_type, ancestor_path, anchor_type, anchor_label_norm FROM {current_sql('chunks', 'chunk_id')}),
b AS MATERIALIZED (SELECT * FROM c UNION ALL SELECT k, {_DOC}, lower(ref), 1, k, node_type, text, page_pdf_start, page_pdf_end, source_hash, node_type, ancestor_path, anchor_type, anchor_label_norm FROM {current_sql('nodes', 'node_id')} WHERE {_DOC} IN (SELECT doc FROM c)),
p AS (SELECT DISTINCT doc_id, lower(trim(ref)) AS want FROM f),
h AS (SELECT p.doc_id, p.want, b.*, kind + CASE WHEN r = want THEN 0 ELSE 2 END AS tier FROM p JOIN b ON b.doc = p.doc_id AND contains(b.r, p.want)),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, want ORDER BY tier, coalesce(page_pdf_start, -1), kind, id) AS rn FROM h QUALIFY rn = 1),
j AS (SELECT f.gold_id, f.doc_id, f.ref, f.doc_id IN (SELECT doc FROM c) AS evaluable, tier::BIGINT AS tier, id AS found_id, tier IS NOT NULL AS found, ws, we, terms, wl, wa, wn, type, text, page_pdf_start, page_pdf_end, source_hash, origin_node_id, leaf_node_type, ancestor_path, anchor_type, anchor_label_norm FROM f LEFT JOIN t ON t.doc_id = f.doc_id AND t.want = lower(trim(f.ref)))
SELECT gold_id, doc_id, ref, evaluable, tier, found_id,
  found AND (ws IS NULL OR (page_pdf_start IS NOT DISTINCT FROM ws AND page_pdf_end IS NOT DISTINCT FROM we)) AS pages_ok,
  found AND (NOT starts_with(lower(ref), 'table ') OR coalesce(type = 'table', false)) AS table_ok,
  found AND (len(terms) = 0 OR len(list_filter(terms, lambda x: contains(lower(coalesce(text, '')), x))) > 0) AS terms_ok,
  found AND page_pdf_start IS NOT NULL AND page_pdf_end IS NOT NULL AND source_hash IS NOT NULL AS provenance,
  found AND trim(coalesce(origin_node_id, '')) <> '' AND trim(coalesce(leaf_node_type, '')) <> '' AND trim(coalesce(ancestor_path, '')) <> '' AS lineage,
  found AND coalesce(lower(leaf_node_type) = lower(wl), wl IS NULL) AND coalesce(lower(anchor_type) = lower(wa), wa IS NULL) AND coalesce(lower(anchor_label_norm) = lower(wn), wn IS NULL) AS hierarchy_ok,
  CASE WHEN NOT evaluable THEN 'skip' WHEN terms_ok AND hierarchy_ok THEN 'pass' ELSE 'fail' END AS status FROM j"""
_GOLD_SUMS = "SELECT count(*) AS gold_total, count(*) FILTER (tier IS NULL) AS gold_missing, count(*) FILTER (tier IS NOT NULL AND NOT pages_ok) AS gold_page_mismatch, count(*) FILTER (NOT table_ok) AS gold_table_miss, count(*) FILTER (NOT coalesce(tier <= 1, false)) AS gold_exact_miss, count(*) FILTER (NOT terms_ok) AS gold_term_miss, count(*) FILTER (tier IS NOT NULL AND NOT provenance) AS gold_without_provenance, count(*) FILTER (NOT lineage) AS gold_lineage_incomplete, count(*) FILTER (NOT hierarchy_ok) AS gold_hierarchy_unmet"
_GOLD_MEASURES = ("gold_missing", "gold_page_mismatch", "gold_table_miss", "gold_exact_miss", "gold_term_miss", "gold_without_provenance", "gold_lineage_incomplete", "gold_hierarchy_unmet")


def _cited() -> Column:
    """Whether an item or a paragraph has the citation anchor that follows from its fields; anchors of other nodes aren't made."""
    right = F.col("citation_anchor_id") == X.citation_anchor(F.btrim("doc_id"), F.col("ref"), F.col("anchor_type"), F.col("anchor_label_norm"), F.col("anchor_order"))
    return F.when(F.col("node_type").isin("list_item", "note_item", "paragraph"), F.coalesce(right, F.lit(False)))


def _marker_counts() -> list[Column]:
    item, paragraph, right = F.col("node_type").isin("list_item", "note_item"), F.col("node_type") == "paragraph", F.col("cited")
    return [Q.count_if(item).alias("marker_items"), Q.count_if(item & (F.coalesce("anchor_label_norm", F.lit("")) != "")).alias("marked_items"), Q.count_if(item & right).alias("cited_items"), Q.count_if(paragraph).alias("paragraphs"), Q.count_if(paragraph & right).alias("cited_paragraphs")]


def marker_citations(spark: SparkSession, folder: str) -> DataFrame:
    """How many list items and notes have their marker, and how many of these and of paragraphs have the citation anchor that follows from
    their fields."""
    n = cur(spark, folder, "nodes", ["doc_id", "node_type", "ref", "anchor_type", "anchor_label_norm", "anchor_order", "citation_anchor_id"])
    return Q.unpivot(n.where("node_type in ('list_item', 'note_item', 'paragraph')").withColumn("cited", _cited()).agg(*_marker_counts()))


_SAN = "trim(lower(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g')), '_')"
MARKER_SQL = f"""WITH n AS (SELECT node_type, anchor_label_norm AS l, coalesce(citation_anchor_id = concat_ws(':', trim(doc_id), {_SAN.format('ref')}, {_SAN.format('anchor_type')}, coalesce(CASE WHEN trim(anchor_label_norm) <> '' THEN {_SAN.format('anchor_label_norm')} END, CAST(anchor_order AS VARCHAR), 'root')), false) AS ok FROM {current_sql('nodes', 'node_id')} WHERE node_type IN ('list_item', 'note_item', 'paragraph'))
SELECT 'marker_items' AS measure, count(*)::DOUBLE AS value FROM n WHERE node_type <> 'paragraph' UNION ALL SELECT 'marked_items', count(*)::DOUBLE FROM n WHERE node_type <> 'paragraph' AND coalesce(l, '') <> '' UNION ALL SELECT 'cited_items', count(*)::DOUBLE FROM n WHERE node_type <> 'paragraph' AND ok
UNION ALL SELECT 'paragraphs', count(*)::DOUBLE FROM n WHERE node_type = 'paragraph' UNION ALL SELECT 'cited_paragraphs', count(*)::DOUBLE FROM n WHERE node_type = 'paragraph' AND ok"""

#: Measures that are a quotient of two others: name -> (above, below).
RATIOS = {
    "sparse_row_ratio": ("sparse_rows", "table_rows"),
    "overloaded_row_ratio": ("overloaded_rows", "table_rows"),
    "marker_sequence_coverage": ("markers_seen", "markers_expected"),
    "description_coverage": ("described_rows", "marker_rows"),
    "marker_extraction_coverage": ("marked_items", "marker_items"),
    "marker_citation_accuracy": ("cited_items", "marker_items"),
    "paragraph_citation_accuracy": ("cited_paragraphs", "paragraphs"),
    "rated_ratio": ("rated", "aligned_rows"),
    "malformed_ratio": ("malformed", "aligned_rows"),
    "outlier_ratio": ("outliers", "aligned_rows"),
    "provenance_coverage": ("with_status", "pages"),
    "label_status_coverage": ("with_status", "pages"),
    "mapped_mappable_ratio": ("mapped_mappable", "mappable_chunks"),
    "overlap_compliance": ("overlap_compliant", "overlap_pairs"),
    "list_completeness": ("complete", "list_items"),
    "cell_completeness": ("complete_cells", "cells"),
    "header_flag_ratio": ("flagged_header_cells", "header_cells"),
    "one_cell_ratio": ("one_cell_rows", "rows"),
    "parity_top1": ("same_first", "parity_refs"),
    "parity_top3": ("contained", "parity_refs"),
    "parity_pages": ("same_pages", "parity_refs"),
    "embedding_coverage": ("embedded", "eligible"),
    "stale_embedding_ratio": ("stale", "embedded"),
}


def _rankings(spark: SparkSession, folder: str) -> DataFrame:
    """(measure, value) of the judged rankings: means over queries that name no reference, exact first hits, and the test of the gain."""
    rows = EV.rank_measures(spark, folder)
    exact = read(spark, folder, "eval_queries").select("query_id", X.exact_intent(F.col("query_text")).alias("exact"), "intent")
    # A row per query, with the measures of both modes side by side.
    j = rows.groupBy("query_id").agg(*[F.max(F.when(F.col("mode") == mode, F.col(name))).alias(f"{mode}_{name}") for mode in ("lexical", "hybrid") for name in ("ndcg", "mrr", "recall", "judged")])
    j = j.join(exact, "query_id")

    def mean(name: str, mode: str, which):
        return F.avg(F.when(which, F.col(f"{mode}_{name}")))

    other, gain = ~F.col("exact"), F.col("hybrid_ndcg") - F.col("lexical_ndcg")
    first_hit = F.col("intent").isin("exact_ref", "keyword", "table_intent")
    row = j.agg(
        mean("ndcg", "hybrid", other).alias("hybrid_ndcg"),
        (mean("ndcg", "hybrid", other) - mean("ndcg", "lexical", other)).alias("ndcg_uplift"),
        F.avg(F.when(F.col("exact"), (F.col("lexical_mrr") == 1).cast("double"))).alias("exact_top1_rate"),
        mean("mrr", "hybrid", first_hit).alias("hybrid_mrr"),
        (mean("recall", "hybrid", F.lit(True)) - mean("recall", "lexical", F.lit(True))).alias("recall_delta"),
        mean("judged", "hybrid", F.lit(True)).alias("judged_at_10"),
        Q.count_if(other & (gain > 0)).alias("wins"),
        Q.count_if(other & (gain < 0)).alias("losses"),
    ).first()
    values = row.asDict()
    values["uplift_p_value"] = V.sign_test(values.pop("wins"), values.pop("losses"))
    return _measured(spark, list(values.items()))


def _measured(spark: SparkSession, rows: list[tuple[str, float | None]]) -> DataFrame:
    return small(spark, rows, measure=pa.string(), value=pa.float64())


def gate_measures(spark: SparkSession, folder: str) -> DataFrame:
    """(measure, value): all measures of the gates that the tables give, to six digits; quotients with nothing below are null. Each
    group of measures gives a few rows, which the driver has."""
    scratch = Scratch(spark, "measures")
    held = _held(spark, folder, scratch)
    SE.corpus(spark, folder, held=held)  # the rankings use it too
    plain = _plain_measures(spark, folder, held, scratch) + _made(_rankings(spark, folder))
    values = dict(plain)
    above = [(r, values[a], values[b]) for r, (a, b) in RATIOS.items()]
    plain += [(r, a / b if a is not None and b is not None and b > 0 else None) for r, a, b in above]
    return _measured(spark, plain).select("measure", F.round("value", 6).alias("value"))


def _made(*parts: DataFrame) -> list[tuple[str, float | None]]:
    """The rows (measure, value) of the parts, in one job."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return [(r["measure"], r["value"]) for r in out.select("measure", F.col("value").cast("double").alias("value")).collect()]


def _plain_measures(spark: SparkSession, folder: str, held: dict[str, DataFrame], scratch: Scratch) -> list[tuple[str, float | None]]:
    """All measures but those of the rankings and the quotients; what is held goes on the way."""
    held = {**held, "nodes": scratch.keep(cur(spark, folder, "nodes", _NODES), "nodes"), "first_chunks": scratch.keep(_first(spark, folder, _FIRST), "first_chunks")}
    parity = RP.citation_parity(spark, folder, held).agg(F.sum("refs").alias("parity_refs"), *[F.sum(c).alias(c) for c in ("same_first", "same_pages", "contained")])
    replay = QQ.replay_stability(spark, folder).agg(F.max(F.when(F.col("backend") == "text_layer", F.col("stable"))).alias("text_replay"), F.max(F.when(F.col("backend") == "ocr", F.col("stable"))).alias("ocr_replay"))

    def one(df: DataFrame, measure: str, value) -> DataFrame:
        return df.agg(value.cast("double").alias("value")).select(F.lit(measure).alias("measure"), "value")

    # Group by group, so that what a group reads can go before the next and few plans are held at once. Each gives a few rows.
    rows = Q.table_rows(QQ.table_cells(spark, folder, held), *Q.alignment_fields())
    each = {"aligned_rows": F.lit(1), "rated": F.col("rated"), "malformed": F.when(F.col("bad"), 1).otherwise(0), "outliers": F.when(F.col("cells") > 10, 1).otherwise(0)}
    plain = _made(
        Q.scored(rows),
        Q.unpivot(Q.aligned(rows).agg(*[F.sum(v).alias(name) for name, v in each.items()])),
        Q.node_measures(held["nodes"].withColumn("cited", _cited()), *_marker_counts()),
        one(SO.target_coverage(spark, folder, held), "target_problems", F.count("*")),
    )
    amiss = [m for m, _ in plain if m in ("missing_parent", "dangling_parent") or m.startswith("invalid_") and m.endswith("_parent")]
    plain = [(m, v) for m, v in plain if m not in amiss] + [("structural_violations", sum(v for m, v in plain if m in amiss))]
    plain += _made(gold.measures(gold_evaluation(spark, folder, held)).where(F.col("measure").isin(*_GOLD_MEASURES)))
    scratch.drop(held["nodes"])
    chunks = QQ._chunks(spark, folder, held)
    noise = F.avg(F.when(F.col("text").isNotNull(), X.is_licence_noise(F.col("text")).cast("double"))).alias("noise_ratio")
    plain += _made(
        Q.unpivot(chunks.agg(Q.count_if(F.col("copies") > 1).alias("duplicate_chunks"), noise, *Q.clause_sizes(chunks), *QQ.range_counts())),
        Q.clause_neighbours(chunks),
        QQ.page_labels(spark, folder, chunks),
        one(QQ.freshness_by_part(spark, folder, held).where("stale"), "stale_parts", F.count("*")),
        Q.unpivot(replay),
        Q.unpivot(parity),
        SE.embedding_coverage(spark, folder, held).where("measure in ('eligible', 'embedded', 'stale')"),
    )
    for name in ("chunks", "first_chunks"):
        scratch.drop(held[name])
    return plain


def _case(name: str) -> str:
    return f"max(value) FILTER (measure = '{name}')"


_EXACT = f"(SELECT query_id, exact FROM ({SE.INTENT_ROUTER_SQL}))"
RANKINGS_SQL = f"""WITH r AS MATERIALIZED (SELECT m.*, exact, intent FROM ({EV.MEASURES_SQL}) m JOIN {_EXACT} USING (query_id) JOIN (SELECT query_id, intent FROM eval_queries) USING (query_id)),
p AS (SELECT count(*) FILTER (h > l) AS w, count(*) FILTER (h < l) AS x FROM (SELECT query_id, max(ndcg) FILTER (mode = 'hybrid') AS h, max(ndcg) FILTER (mode = 'lexical') AS l FROM r WHERE NOT exact GROUP BY 1))
SELECT 'hybrid_ndcg' AS measure, avg(ndcg) FILTER (mode = 'hybrid' AND NOT exact) AS value FROM r UNION ALL SELECT 'ndcg_uplift', avg(ndcg) FILTER (mode = 'hybrid' AND NOT exact) - avg(ndcg) FILTER (mode = 'lexical' AND NOT exact) FROM r
UNION ALL SELECT 'exact_top1_rate', avg((mrr = 1)::INT::DOUBLE) FILTER (mode = 'lexical' AND exact) FROM r UNION ALL SELECT 'hybrid_mrr', avg(mrr) FILTER (mode = 'hybrid' AND intent IN ('exact_ref', 'keyword', 'table_intent')) FROM r
UNION ALL SELECT 'recall_delta', avg(recall) FILTER (mode = 'hybrid') - avg(recall) FILTER (mode = 'lexical') FROM r UNION ALL SELECT 'judged_at_10', avg(judged) FILTER (mode = 'hybrid') FROM r
UNION ALL SELECT 'uplift_p_value', CASE WHEN w + x > 0 THEN least(1.0, 2 * (SELECT sum(exp(lgamma(w + x + 1) - lgamma(i + 1) - lgamma(w + x - i + 1) - (w + x) * ln(2))) FROM range(0, least(w, x) + 1) t(i))) END FROM p"""
NOISE_SQL = f"SELECT 'noise_ratio' AS measure, avg(CASE WHEN (contains(lower(text), 'store order') AND contains(lower(text), 'downloaded:')) OR ((contains(lower(text), 'single user licence only') OR contains(lower(text), 'single user license only')) AND contains(lower(text), 'networking prohibited')) OR (contains(lower(text), 'licensed to') AND contains(lower(text), 'license #') AND contains(lower(text), 'downloaded:')) THEN 1.0 ELSE 0.0 END)::DOUBLE AS value FROM (WITH {QQ.C} SELECT * FROM c) WHERE text IS NOT NULL"
MEASURES_SQL = f"""WITH ge AS MATERIALIZED (SELECT * FROM ({GOLD_EVAL_SQL}) WHERE evaluable), gs AS ({_GOLD_SUMS} FROM ge),
al AS (SELECT sum(marker_rows) AS aligned_rows, sum(rated) AS rated, sum(malformed) AS malformed, sum(outliers) AS outliers FROM ({RP.ALIGNMENT_SQL})),
pa AS (SELECT sum(refs) AS parity_refs, sum(same_first) AS same_first, sum(same_pages) AS same_pages, sum(contained) AS contained FROM ({RP.PARITY_SQL})),
plain AS MATERIALIZED ({" UNION ALL ".join(f"SELECT '{m}' AS measure, {m}::DOUBLE AS value FROM gs" for m in _GOLD_MEASURES)}
  UNION ALL SELECT 'duplicate_chunks', count(*)::DOUBLE FROM ({QQ.DUPLICATE_SQL}) UNION ALL SELECT * FROM ({QQ.SCORECARD_SQL}) UNION ALL SELECT * FROM ({MARKER_SQL})
  UNION ALL SELECT 'structural_violations', sum(value) FROM ({QQ.INVARIANTS_SQL})
  UNION ALL {" UNION ALL ".join(f"SELECT '{m}', {m}::DOUBLE FROM al" for m in ("aligned_rows", "rated", "malformed", "outliers"))}
  UNION ALL SELECT 'target_problems', count(*)::DOUBLE FROM ({SO.COVERAGE_SQL}) UNION ALL SELECT 'stale_parts', count(*)::DOUBLE FROM ({QQ.FRESHNESS_SQL}) WHERE stale
  UNION ALL SELECT * FROM ({QQ.PRINTED_SQL})
  UNION ALL SELECT 'text_replay', max(stable) FILTER (backend = 'text_layer') FROM ({QQ.REPLAY_SQL}) UNION ALL SELECT 'ocr_replay', max(stable) FILTER (backend = 'ocr') FROM ({QQ.REPLAY_SQL})
  UNION ALL SELECT * FROM ({QQ.CLAUSE_SQL}) UNION ALL SELECT * FROM ({QQ.LIST_SQL}) UNION ALL SELECT * FROM ({QQ.TABLE_SQL}) UNION ALL SELECT * FROM ({NOISE_SQL})
  UNION ALL {" UNION ALL ".join(f"SELECT '{m}', {m}::DOUBLE FROM pa" for m in ("parity_refs", "same_first", "same_pages", "contained"))}
  UNION ALL SELECT * FROM ({SE.COVERAGE_SQL}) WHERE measure IN ('eligible', 'embedded', 'stale') UNION ALL SELECT * FROM ({RANKINGS_SQL}))
SELECT measure, round(value, 6) AS value FROM plain
{" ".join(f"UNION ALL SELECT '{r}', round({_case(a)} / nullif({_case(b)}, 0), 6) FROM plain" for r, (a, b) in RATIOS.items())}"""


def gate_clauses(spark: SparkSession, folder: str) -> DataFrame:
    """Every clause of every check in stages A and B."""
    measures = gate_measures(spark, folder)
    return G.clause_results(measures, "A").withColumn("stage", F.lit("A")).unionByName(G.clause_results(measures, "B").withColumn("stage", F.lit("B")))


_CLAUSES = ", ".join(f"('{c.check}', '{c.measure}', {c.limit}::DOUBLE, {str(c.at_most).lower()}, {str(c.hard).lower()})" for c in G.CLAUSES)
CLAUSES_SQL = f"""WITH m AS MATERIALIZED ({MEASURES_SQL}), g(chk, measure, lim, at_most, hard) AS (VALUES {_CLAUSES}), s(stage) AS (VALUES ('A'), ('B'))
SELECT chk AS "check", measure, value, lim AS "limit", hard, CASE WHEN value IS NULL THEN 'pending' WHEN (CASE WHEN at_most THEN value <= lim ELSE value >= lim END) OR (NOT hard AND stage = 'A') THEN 'pass' ELSE 'failed' END AS result, stage FROM g LEFT JOIN m USING (measure), s"""


def gate_results(spark: SparkSession, folder: str) -> DataFrame:
    """A row per check and stage."""
    return G.check_results(gate_clauses(spark, folder), "stage")


RESULTS_SQL = f"""SELECT stage, "check", CASE WHEN count(*) FILTER (result = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (result = 'pending') > 0 THEN 'pending' ELSE 'pass' END AS result, coalesce(string_agg(DISTINCT measure, ',' ORDER BY measure) FILTER (result = 'failed'), '') AS failing FROM ({CLAUSES_SQL}) GROUP BY stage, "check" """


def gate_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The report of stage B."""
    return G.summary(gate_results(spark, folder).where("stage = 'B'"))


SUMMARY_SQL = f"""WITH r AS ({RESULTS_SQL}) SELECT count(*) AS total, count(*) FILTER (result = 'pass') AS passed, count(*) FILTER (result = 'failed') AS failed, count(*) FILTER (result = 'pending') AS pending,
CASE WHEN count(*) FILTER (result = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (result = 'pending') > 0 THEN 'partial' ELSE 'passed' END AS status FROM r WHERE stage = 'B'"""

QUERIES = {
    "gold_evaluation": (gold_evaluation, GOLD_EVAL_SQL),
    "marker_citations": (marker_citations, MARKER_SQL),
    "gate_measures": (gate_measures, MEASURES_SQL),
    "gate_results": (gate_results, RESULTS_SQL),
    "gate_summary": (gate_summary, SUMMARY_SQL),
}
