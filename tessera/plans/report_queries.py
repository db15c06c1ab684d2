"""Queries of reports: row counts, gold references, table alignment, previews of descendants, citation parity and the verdict on a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as X
from tessera.operators import drift as D
from tessera.operators import parsing
from tessera.operators import quality as Q
from tessera.operators.ancestry import previews
from tessera.operators import retrieval as R
from tessera.plans import search_queries as SE
from tessera.plans.quality_queries import table_cells
from tessera.plans.search_queries import BM25_SQL, CORPUS_SQL, EXACT_SQL, LEXICAL_SQL, SEMANTIC_SQL, corpus, with_sql
from tessera.plans.structure import current_sql, key_sql
from tessera.plans.text_queries import WS, cur
from tessera.sources import embeddings as E
from tessera.sources.scratch import Scratch
from tessera.sources.shared import shared
from tessera.sources.tables import current_rows, read


def parsed_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The node tree of every extraction."""
    return parsing.structured_nodes(read(spark, folder, "extracted_pages"))


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Current rows per table and type."""
    n = cur(spark, folder, "nodes", ["node_type"]).select(F.lit("nodes").alias("table_name"), F.col("node_type").alias("kind"))
    c = cur(spark, folder, "chunks", ["type"]).select(F.lit("chunks").alias("table_name"), F.col("type").alias("kind"))
    d = cur(spark, folder, "docs", ["year"]).select(F.lit("docs").alias("table_name"), F.lit("document").alias("kind"))
    return n.unionByName(c).unionByName(d).groupBy("table_name", "kind").agg(F.count("*").alias("n"))


STATUS_SQL = f"SELECT table_name, kind, count(*) AS n FROM (SELECT 'nodes' AS table_name, node_type AS kind FROM {current_sql('nodes', 'node_id')} UNION ALL SELECT 'chunks', type FROM {current_sql('chunks', 'chunk_id')} UNION ALL SELECT 'docs', 'document' FROM {current_sql('docs', 'doc_id')}) GROUP BY ALL"


def gold_references(spark: SparkSession, folder: str) -> DataFrame:
    """Where each stated reference is found in each document: chunk or node, exact or contained, the first kind that has one, the first by
    page. Documents without chunks are left out."""
    refs = read(spark, folder, "eval_queries").where("intent = 'exact_ref'").select(F.lower(F.btrim("query_text")).alias("want")).distinct()
    chunks = corpus(spark, folder)
    evaluable = chunks.select("doc_id").distinct()
    nodes = cur(spark, folder, "nodes", ["doc_id", "ref", "page_pdf_start"]).withColumn("doc_id", F.btrim("doc_id")).join(evaluable, "doc_id", "left_semi")
    both = chunks.select("doc_id", F.col("chunk_id").alias("id"), F.lower("ref").alias("ref"), "page_pdf_start", F.lit(0).alias("kind"))
    both = both.unionByName(nodes.select("doc_id", F.col("node_id").alias("id"), F.lower("ref").alias("ref"), "page_pdf_start", F.lit(1).alias("kind")))
    held = both.join(F.broadcast(refs), F.contains(F.col("ref"), F.col("want")))  # the stated references
    tier = F.col("kind") + F.when(F.col("ref") == F.col("want"), 0).otherwise(2)
    best = held.groupBy("doc_id", "want").agg(F.min(F.struct(tier.alias("tier"), F.coalesce("page_pdf_start", F.lit(-1)).alias("page"), "id")).alias("b"))
    return best.select("doc_id", "want", F.col("b.tier").cast("long").alias("tier"), F.col("b.page").alias("page"), F.col("b.id").alias("id"))


GOLD_SQL = with_sql(
    CORPUS_SQL,
    f"""r AS (SELECT DISTINCT lower(trim(query_text)) AS want FROM eval_queries WHERE intent = 'exact_ref'),
b AS (SELECT doc_id, chunk_id AS id, lower(ref) AS ref, page_pdf_start, 0 AS kind FROM c UNION ALL SELECT trim(doc_id), k, lower(ref), page_pdf_start, 1 FROM {current_sql('nodes', 'node_id')} WHERE trim(doc_id) IN (SELECT doc_id FROM c)),
h AS (SELECT doc_id, want, kind + CASE WHEN ref = want THEN 0 ELSE 2 END AS tier, coalesce(page_pdf_start, -1) AS page, id FROM b JOIN r ON contains(ref, want))""",
    select="SELECT doc_id, want, tier, page, id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, want ORDER BY tier, page, id) AS rn FROM h) WHERE rn = 1",
)


def table_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Per table: marker rows, those with a rating, with a malformed description, and with more than ten cells."""
    marked = Q.aligned(table_cells(spark, folder).groupBy("table_id", "row_idx").agg(*Q.alignment_fields()))
    return marked.groupBy("table_id").agg(F.count("*").alias("marker_rows"), F.sum("rated").cast("long").alias("rated"), Q.count_if(F.col("bad")).alias("malformed"), Q.count_if(F.col("cells") > 10).alias("outliers"))


ALIGNMENT_SQL = rf"""WITH c AS (SELECT {key_sql('table_node_id')} AS table_id, row_idx, col_idx, coalesce(text, '') AS t FROM {current_sql('nodes', 'node_id')} WHERE node_type = 'table_cell' AND row_idx IS NOT NULL AND {key_sql('table_node_id')} IS NOT NULL),
r AS (SELECT table_id, row_idx, count(*) AS cells, max(t) FILTER (col_idx = 1) AS first, max(CASE WHEN col_idx > 1 AND len(list_intersect(regexp_split_to_array(t, '[\s\p{{Z}}]+'), ['+', '++', '-', '--', '+/-', '+/−', '−/+', 'o'])) > 0 THEN 1 ELSE 0 END) AS rated FROM c GROUP BY 1, 2),
m AS (SELECT *, trim(regexp_replace(first, '^\s*[0-9]+[A-Za-z]?[.)]?', '')) AS words FROM r WHERE regexp_extract(first, '^\s*([0-9]+[A-Za-z]?)(?:[.)]?\s|[.)]?$)', 1) <> '')
SELECT table_id, count(*) AS marker_rows, sum(rated)::BIGINT AS rated, count(*) FILTER (length(regexp_replace(words, '[^A-Za-z]', '', 'g')) <= 1 AND len(list_filter(regexp_split_to_array(words, '[\s\p{{Z}}]+'), lambda w: w <> '')) <= 1) AS malformed, count(*) FILTER (cells > 10) AS outliers FROM m GROUP BY 1"""


def descendant_preview(spark: SparkSession, folder: str) -> DataFrame:
    """For every document node the first 256 nodes below it, at most eight levels down, with the beginning of their text."""
    n = cur(spark, folder, "nodes", ["parent_node_id", "node_type", "order_index", F.md5(X.collapse(F.substring(F.coalesce("text", F.lit("")), 1, 180))).alias("preview")])
    return previews(n, n.where("node_type = 'document'"), ["preview"]).select("node_id", "descendant", "depth", "place", "preview")


PREVIEW_SQL = rf"""WITH RECURSIVE n AS MATERIALIZED (SELECT k, {key_sql('parent_node_id')} AS p, node_type, order_index, md5(trim(regexp_replace(substr(coalesce(text, ''), 1, 180), '{WS}', ' ', 'g'))) AS preview FROM {current_sql('nodes', 'node_id')}),
w AS (SELECT d.k AS node_id, n.k AS descendant, n.order_index, n.preview, 1 AS depth FROM n d JOIN n ON n.p = d.k WHERE d.node_type = 'document' UNION ALL SELECT w.node_id, n.k, n.order_index, n.preview, depth + 1 FROM w JOIN n ON n.p = w.descendant WHERE depth < 8)
SELECT node_id, descendant, depth::BIGINT AS depth, row_number() OVER (PARTITION BY node_id ORDER BY depth, order_index ASC NULLS FIRST, descendant) AS place, preview FROM w QUALIFY place <= 256"""


def citation_parity(spark: SparkSession, folder: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per document, how many references have the same first chunk, the same pages of it, and no new chunk among the first three, now and
    when they first came."""
    c = read(spark, folder, "chunks")
    columns = [F.btrim("doc_id").alias("doc_id"), X.base_reference(F.col("ref")).alias("ref"), "page_pdf_start", "page_pdf_end"]
    if held:
        now, then = (held[t].select("chunk_id", *columns) for t in ("chunks", "first_chunks"))
    else:
        now = current_rows(c, "chunk_id", columns)
        then = current_rows(c.withColumn("minus", -F.unix_micros("ingested_at")), "chunk_id", columns, order="minus")

    def first_three(rows: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy("doc_id", "ref").orderBy(F.asc_nulls_first("page_pdf_start"), "chunk_id")
        top = rows.where("ref is not null").withColumn("place", F.row_number().over(order)).where("place <= 3")
        return top.groupBy("doc_id", "ref").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", X.page_range(F.col("page_pdf_start"), F.col("page_pdf_end")).alias("pages")))).alias(name))

    j = first_three(now, "a").join(first_three(then, "b"), ["doc_id", "ref"])
    a1, b1 = F.element_at("a", 1), F.element_at("b", 1)
    kept = F.size(F.array_except(F.transform("a", lambda x: x["chunk_id"]), F.transform("b", lambda x: x["chunk_id"]))) == 0
    return j.groupBy("doc_id").agg(F.count("*").alias("refs"), Q.count_if(a1["chunk_id"] == b1["chunk_id"]).alias("same_first"), Q.count_if(a1["pages"] == b1["pages"]).alias("same_pages"), Q.count_if(kept).alias("contained"))


def _parity_side(name: str, order: str) -> str:
    base = "CASE " + " ".join(f"WHEN contains(ref, '{w}') THEN string_split(ref, '{w}')[1]" for w in (" item ", " note ", " para ", " row ")) + " ELSE ref END"
    pages = "CASE WHEN page_pdf_start IS NULL AND page_pdf_end IS NULL THEN 'unknown' WHEN page_pdf_start IS NULL THEN CAST(page_pdf_end AS VARCHAR) WHEN page_pdf_end IS NULL OR page_pdf_start = page_pdf_end THEN CAST(page_pdf_start AS VARCHAR) ELSE page_pdf_start || '-' || page_pdf_end END"
    return f"""{name}0 AS (SELECT trim(chunk_id) AS chunk_id, trim(doc_id) AS doc_id, {base} AS ref, page_pdf_start, {pages} AS pages FROM chunks QUALIFY row_number() OVER (PARTITION BY trim(chunk_id) ORDER BY ingested_at {order}) = 1),
{name}1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ref ORDER BY page_pdf_start ASC NULLS FIRST, chunk_id) AS place FROM {name}0 WHERE ref IS NOT NULL QUALIFY place <= 3),
{name} AS (SELECT doc_id, ref, list(chunk_id ORDER BY place) AS ids, arg_min(pages, place) AS pages FROM {name}1 GROUP BY 1, 2)"""


PARITY_SQL = f"WITH {_parity_side('a', 'DESC')}, {_parity_side('b', 'ASC')} SELECT doc_id, count(*) AS refs, count(*) FILTER (a.ids[1] = b.ids[1]) AS same_first, count(*) FILTER (a.pages = b.pages) AS same_pages, count(*) FILTER (len(list_filter(a.ids, lambda x: NOT list_contains(b.ids, x))) = 0) AS contained FROM a JOIN b USING (doc_id, ref) GROUP BY 1"


def _early_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The earliest row of every chunk of a known document: the corpus as it first was."""

    def build(scratch: Scratch) -> DataFrame:
        first = read(spark, folder, "chunks").withColumn("minus", -F.unix_micros("ingested_at"))
        rows = current_rows(first, "chunk_id", ["doc_id", "type", "ref", "heading", "text", "table_md", "page_pdf_start"], order="minus").drop("minus").withColumn("doc_id", F.btrim("doc_id"))
        return scratch.keep(rows.join(cur(spark, folder, "docs", ["part"]).drop("ingested_at"), "doc_id"), "early")

    return shared(spark, folder, "corpus-early", ["chunks", "docs"], build)


def _snapshots(spark: SparkSession, folder: str, early: bool) -> dict[str, DataFrame]:
    q = read(spark, folder, "eval_queries")
    one, members = R.alike(q)
    if early:
        c = _early_corpus(spark, folder)
        index, vectors = shared(spark, folder, "early-search", ["chunks", "docs"], lambda s: (R.build_index(c, s), s.keep(E.embed_run(c, E.empty_store(spark), E.model_of()), "store")))
    else:
        c, index, vectors = corpus(spark, folder), SE.index(spark, folder), SE.stored_vectors(spark, folder)
    expected = R.for_all(R.exact_tiers(c, one, 1).where("score >= 900").select("query_id", "chunk_id"), members)
    scratch = Scratch(spark, "snapshot")
    expected = scratch.keep(expected, "expected")
    found = {"lexical": R.lexical(c, one, index), "semantic": R.semantic(c, one, vectors)}
    return {mode: scratch.keep(D.query_snapshot(R.for_all(hits, members), q, expected), mode) for mode, hits in found.items()}


def drift_rules(spark: SparkSession, folder: str) -> DataFrame:
    """All rules on the answers to the evaluation queries over the corpus as it first was and as it is."""
    before, after = _snapshots(spark, folder, True), _snapshots(spark, folder, False)
    b = D.snapshot_summary(before["lexical"], "lexical").unionByName(D.snapshot_summary(before["semantic"], "semantic"))
    a = D.snapshot_summary(after["lexical"], "lexical").unionByName(D.snapshot_summary(after["semantic"], "semantic"))
    for mode in ("lexical", "semantic"):
        a = a.unionByName(D.overlap(before[mode], after[mode], mode))
    parity = citation_parity(spark, folder).agg((F.sum("same_first") / F.sum("refs")).alias("citation_top1"), F.lit(1.0).alias("benchmark_valid"))
    rules = D.drift_rules(b, a.unionByName(Q.unpivot(parity)))
    return rules.select("rule", "measure", "hard", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "broken")


_EARLY_SQL = CORPUS_SQL.replace(current_sql("chunks", "chunk_id"), current_sql("chunks", "chunk_id").replace("ORDER BY ingested_at DESC", "ORDER BY ingested_at"))


def _side_sql(corpus_sql: str) -> str:
    one = "SELECT '{0}' AS mode, query_id, must_hit_top1, coalesce(n, 0) AS n, coalesce(top, []) AS top, top[1] AS top1, (SELECT chunk_id FROM exact_top x WHERE x.query_id = e.query_id AND rank = 1 AND score >= 900) AS want FROM eval_queries e LEFT JOIN (SELECT query_id, count(*) AS n, (list(chunk_id ORDER BY rank))[1:10] AS top FROM {1} GROUP BY 1) USING (query_id)"
    return with_sql(corpus_sql, EXACT_SQL, BM25_SQL, LEXICAL_SQL, SEMANTIC_SQL, select=f"{one.format('lexical', 'lex')} UNION ALL {one.format('semantic', 'sem')}")


_SUMS = "SELECT mode, avg((n = 0)::INT::DOUBLE) AS no_result_rate, 0.0::DOUBLE AS timeout_rate, 0.0::DOUBLE AS fallback_rate, avg(coalesce(top1 = want, false)::INT::DOUBLE) FILTER (must_hit_top1) AS top1, avg(n) AS candidates FROM {0} GROUP BY 1"
_RULES = ", ".join(f"('{r.rule}', '{r.measure}', '{r.kind}', {r.limit}::DOUBLE, {str(r.hard).lower()})" for r in D.RULES)
_LONG = " UNION ALL ".join(f"SELECT mode || '_{m}' AS measure, {m} AS value FROM {{0}}" for m in ("no_result_rate", "timeout_rate", "fallback_rate", "top1", "candidates"))
RULES_SQL = f"""WITH b0 AS MATERIALIZED ({_side_sql(_EARLY_SQL)}), a0 AS MATERIALIZED ({_side_sql(CORPUS_SQL)}), bs AS ({_SUMS.format('b0')}), asum AS ({_SUMS.format('a0')}),
b AS MATERIALIZED ({_LONG.format('bs')}),
a AS MATERIALIZED ({_LONG.format('asum')} UNION ALL SELECT mode || '_jaccard', avg(CASE WHEN len(a0.top) + len(b0.top) = 0 THEN 1.0 ELSE len(list_intersect(a0.top, b0.top)) / len(list_distinct(list_concat(a0.top, b0.top))) END) FROM a0 JOIN b0 USING (mode, query_id) GROUP BY mode
  UNION ALL SELECT 'citation_top1', sum(same_first) / sum(refs) FROM ({PARITY_SQL}) UNION ALL SELECT 'benchmark_valid', 1.0),
r(rule, measure, kind, lim, hard) AS (VALUES {_RULES})
SELECT rule, measure, hard, round(b.value, 6) AS before, round(a.value, 6) AS after, coalesce(CASE kind WHEN 'floor' THEN a.value < lim WHEN 'no_drop' THEN a.value < b.value WHEN 'valid' THEN coalesce(a.value <> 1, true) WHEN 'no_more' THEN coalesce(a.value, 0) > coalesce(b.value, 0)
  WHEN 'crossed' THEN b.value >= lim AND a.value < lim WHEN 'rise' THEN a.value - b.value > lim WHEN 'drop' THEN b.value - a.value > lim WHEN 'relative' THEN (a.value - b.value) / nullif(b.value, 0) > lim WHEN 'latency' THEN a.value - b.value > greatest(5.0, 0.1 * b.value) ELSE false END, false) AS broken
FROM r LEFT JOIN b USING (measure) LEFT JOIN a USING (measure)"""


def drift_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on all rules."""
    rules = Scratch(spark, "verdict").keep(drift_rules(spark, folder), "rules")
    return D.verdict(rules).crossJoin(F.broadcast(rules.agg(Q.count_if(F.col("broken")).alias("broken"))))  # both are one row


VERDICT_SQL = f"WITH x AS ({RULES_SQL}), m AS (SELECT count(*) FILTER (broken AND hard) AS h, count(*) FILTER (broken AND NOT hard) AS s FROM x) SELECT CASE WHEN h > 0 THEN 'FAIL' WHEN s > 0 THEN 'WARN' ELSE 'PASS' END AS status, CASE WHEN h > 0 THEN 20 WHEN s > 0 THEN 10 ELSE 0 END AS exit_code, h + s AS broken FROM m"

QUERIES = {
    "parsed_nodes": (parsed_nodes, None),
    "status_counts": (status_counts, STATUS_SQL),
    "gold_references": (gold_references, GOLD_SQL),
    "table_alignment": (table_alignment, ALIGNMENT_SQL),
    "descendant_preview": (descendant_preview, PREVIEW_SQL),
    "citation_parity": (citation_parity, PARITY_SQL),
    "drift_rules": (drift_rules, RULES_SQL),
    "drift_verdict": (drift_verdict, VERDICT_SQL),
}
