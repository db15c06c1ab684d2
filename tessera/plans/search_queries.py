"""Queries of retrieval and of its evaluation over all evaluation queries and all current chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import driver as D
from tessera.operators import quality as Q
from tessera.operators import retrieval as R
from tessera.plans.structure import current_sql, key_sql
from tessera.plans.text_queries import INTENT_ROUTER_SQL, SERIES, _base_sql, cur
from tessera.sources import embeddings as E
from tessera.sources.scratch import Scratch
from tessera.sources.shared import has, shared
from tessera.sources.tables import current_rows, read


CHUNK_FIELDS = ["doc_id", "type", "ref", "heading", "text", "table_md", "page_pdf_start", "page_pdf_end", "citation_anchor_id", "origin_node_id", "leaf_node_type", "ancestor_path", "anchor_type", "anchor_label_norm"]
NODE_FIELDS = ["doc_id", "node_type", "ref", "heading", "text", "page_pdf_start", "page_pdf_end"]


def corpus(spark: SparkSession, folder: str, table: str = "chunks", held: dict[str, DataFrame] | None = None) -> DataFrame:
    """Current chunks (or nodes) of known documents with the part and year of their document; a table that all queries share. It is made of
    the current rows in ``held``, if they are there."""

    def build(scratch: Scratch) -> DataFrame:
        known = read(spark, folder, table).columns
        rows = cur(spark, folder, table, [c for c in (CHUNK_FIELDS if table == "chunks" else NODE_FIELDS) if c in known], held)
        rows = rows.drop("ingested_at").withColumn("doc_id", F.btrim("doc_id"))
        return scratch.keep(rows.join(cur(spark, folder, "docs", ["part", "year"], held).drop("ingested_at"), "doc_id"), table)

    return shared(spark, folder, f"corpus-{table}", [table, "docs"], build)


def index(spark: SparkSession, folder: str) -> R.Index:
    """The inverted index of the chunks; built once and used by all queries."""
    return shared(spark, folder, "index", ["chunks", "docs"], lambda scratch: R.build_index(corpus(spark, folder), scratch))


def stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The store of embeddings of the default model after a run over the chunks."""
    model = E.model_of()
    store = shared(spark, folder, "vectors", ["chunks", "docs"], lambda scratch: scratch.keep(E.embed_run(corpus(spark, folder), E.empty_store(spark), model), "store"))
    return store.where(F.col("model_id") == model.model_id)


def lexical(spark: SparkSession, folder: str, queries: DataFrame) -> DataFrame:
    return R.lexical(corpus(spark, folder), queries, index(spark, folder))


def semantic(spark: SparkSession, folder: str, queries: DataFrame, store: bool = True) -> DataFrame:
    """The semantic ranking. Without ``store`` no vectors are stored for it; those that are there already are used."""
    store = store or has(spark, folder, "vectors", ["chunks", "docs"])
    return R.semantic(corpus(spark, folder), queries, stored_vectors(spark, folder) if store else None)


def search_exact(spark: SparkSession, folder: str) -> DataFrame:
    return R.exact_tiers(corpus(spark, folder), read(spark, folder, "eval_queries")).select("query_id", "chunk_id", "score", "match_kind", "rank")


def search_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return R.node_tiers(corpus(spark, folder, "nodes"), read(spark, folder, "eval_queries")).select("query_id", "chunk_id", "score", "rank")


def search_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return R.bm25(index(spark, folder), read(spark, folder, "eval_queries")).select("query_id", "chunk_id", "bm25", "rank", "score")


def search_lexical(spark: SparkSession, folder: str) -> DataFrame:
    q, members = R.alike(read(spark, folder, "eval_queries"))
    return R.for_all(lexical(spark, folder, q).select("query_id", "chunk_id", "score", "tags", "rank"), members)


def search_semantic(spark: SparkSession, folder: str) -> DataFrame:
    return semantic(spark, folder, read(spark, folder, "eval_queries")).select("query_id", "chunk_id", "score", "rank")


def search_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    q, members = R.alike(read(spark, folder, "eval_queries"))
    fused = R.fuse_rrf(lexical(spark, folder, q), semantic(spark, folder, q))
    return R.for_all(fused.select("query_id", "chunk_id", "score", "match_kind", "rank"), members)


def routed(spark: SparkSession, folder: str, queries: DataFrame, limit: int = 10) -> DataFrame:
    """The final answers of every query: exact intents lexical, all others fused."""
    scratch = Scratch(spark, "routed")
    q = scratch.keep(queries.withColumn("exact", X.exact_intent(F.col("query_text"))), "queries")
    lex = scratch.keep(lexical(spark, folder, q), "lexical")
    fused = R.fuse_rrf(lex, semantic(spark, folder, q.where("not exact")))
    columns = ["query_id", "chunk_id", "part", "page_pdf_start", "score"]
    exact = lex.join(q.where("exact").select("query_id"), "query_id").select(*columns, F.lit("lexical").alias("mode"))
    other = fused.join(q.where("not exact").select("query_id"), "query_id").select(*columns, F.lit("hybrid").alias("mode"))
    return scratch.keep(R.ranked(exact.unionByName(other), limit).select("query_id", "chunk_id", "rank", "score", "mode"), "answers")


def search_router(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten answers with their pages."""
    pages = corpus(spark, folder).select("chunk_id", X.page_range(F.col("page_pdf_start"), F.col("page_pdf_end")).alias("pages"))
    q, members = R.alike(read(spark, folder, "eval_queries"))
    return R.for_all(routed(spark, folder, q).drop("mode").join(pages, "chunk_id"), members)


def search_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten answers of every evaluation query as they are given: citation, parent, ancestors, what is below, best passages."""
    nodes = cur(spark, folder, "nodes", D.NODE_FIELDS)
    q, members = R.alike(read(spark, folder, "eval_queries"))
    full = D.hydrate(routed(spark, folder, q), corpus(spark, folder), nodes, q)
    below = F.aggregate("descendants", F.lit(0).cast("long"), lambda n, d: n + 1)
    out = full.select(
        "query_id",
        "rank",
        "chunk_id",
        "mode",
        "citation",
        "parent_ref",
        F.array_join("ancestors", "|").alias("ancestors"),
        below.alias("descendants"),
        F.coalesce(F.element_at("descendants", 1)["node_id"], F.lit("")).alias("first_below"),
        F.coalesce(F.try_element_at("kinds", F.lit("table_cell")), F.lit(0)).cast("long").alias("cells"),
        F.array_join(F.transform("pinpoints", lambda p: p["unit_id"]), "|").alias("pinpoints"),
    )
    return R.for_all(out, members)


def chunk_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Hash of the payload, and the embedding as non-zero places and norm, of every chunk with something to embed."""
    e = stored_vectors(spark, folder).withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 6)))
    return e.select("chunk_id", "payload_hash", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("places"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


def _first_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The earliest row of each chunk, as an earlier state of the table."""
    first = read(spark, folder, "chunks").withColumn("minus", -F.unix_micros("ingested_at"))
    return current_rows(first, "chunk_id", ["type", "ref", "heading", "text", "table_md"], order="minus").drop("minus")


def embed_run(spark: SparkSession, folder: str) -> DataFrame:
    """The report of a run that makes what is missing or stale in a store of the earliest rows of the chunks."""
    model, scratch = E.model_of(), Scratch(spark, "embed")
    before = scratch.keep(E.embed_run(_first_rows(spark, folder), E.empty_store(spark), model), "before")
    after = scratch.keep(E.embed_run(corpus(spark, folder), before, model), "after")
    made = after.join(before.select("chunk_id", F.col("payload_hash").alias("old")), "chunk_id", "left").where("not (payload_hash <=> old)")
    counted = Q.unpivot(made.agg(F.count("*").alias("made"))).unionByName(Q.unpivot(after.agg(F.count("*").alias("stored"))))
    return E.run_report(corpus(spark, folder), before, after, model).unionByName(counted)


def embedding_coverage(spark: SparkSession, folder: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """How far the vectors made of the earliest rows cover the current chunks. What a run leaves in an empty store is compared by its keys,
    hashes and sizes; no vector is looked at, so none is made."""
    model = E.model_of()
    before = E.stated(held["first_chunks"] if held else _first_rows(spark, folder), model)
    return E.coverage(corpus(spark, folder), before, model).withColumn("value", F.round("value", 6))


_ALNUM = r"[^\p{L}\p{N}]+"
CORPUS_SQL = f"""
c AS MATERIALIZED (SELECT c.k AS chunk_id, trim(c.doc_id) AS doc_id, c.type, c.ref, c.heading, c.text, c.table_md, c.page_pdf_start, c.page_pdf_end, c.citation_anchor_id, c.origin_node_id, c.ancestor_path, c.anchor_type, c.anchor_label_norm, d.part, d.year
  FROM {current_sql('chunks', 'chunk_id')} c JOIN {current_sql('docs', 'doc_id')} d ON d.k = trim(c.doc_id)),
q AS MATERIALIZED (SELECT query_id, query_text, part_filter, chunk_type_filter, lower(trim(query_text)) AS q FROM eval_queries WHERE trim(query_text) <> '')"""
_FITS = "(q.part_filter IS NULL OR c.part = q.part_filter) AND (q.chunk_type_filter IS NULL OR c.type = q.chunk_type_filter)"
_ORDER = "ORDER BY score DESC, part ASC NULLS LAST, page_pdf_start ASC NULLS LAST, chunk_id ASC"
EXACT_SQL = f"""
exact_all AS (SELECT query_id, chunk_id, c.part, page_pdf_start,
  CASE WHEN lower(coalesce(ref, '')) = q.q THEN 1000.0 WHEN lower(coalesce(heading, '')) = q.q THEN 900.0 WHEN contains(lower(coalesce(ref, '')), q.q) THEN 700.0 ELSE 600.0 END::DOUBLE AS score
  FROM c JOIN q ON (contains(lower(coalesce(ref, '')), q.q) OR contains(lower(coalesce(heading, '')), q.q)) AND {_FITS}),
exact_top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id {_ORDER}) AS rank FROM exact_all QUALIFY rank <= 96)"""
BM25_SQL = f"""
toks AS (SELECT chunk_id, type, part, page_pdf_start, unnest([list_filter(regexp_split_to_array(lower(coalesce(x, '')), '{_ALNUM}'), lambda t: t <> '') FOR x IN [chunk_id, doc_id, ref, heading, text]]) AS f FROM c),
docs_t AS MATERIALIZED (SELECT chunk_id, list(f) AS fs, any_value(type) AS type, any_value(part) AS part, any_value(page_pdf_start) AS page_pdf_start, sum(len(f)) AS size, string_agg(' ' || array_to_string(f, '  ') || ' ', ' | ') AS joined FROM toks GROUP BY chunk_id),
st AS (SELECT count(*) AS n, avg(size) AS mean_size FROM docs_t),
ph AS MATERIALIZED (SELECT DISTINCT query_id, array_to_string(list_filter(regexp_split_to_array(w, '{_ALNUM}'), lambda t: t <> ''), ' ') AS phrase FROM (SELECT query_id, unnest(regexp_split_to_array(q, '\\s+')) AS w FROM q) WHERE regexp_matches(w, '[\\p{{L}}\\p{{N}}]')),
voc AS MATERIALIZED (SELECT DISTINCT phrase, string_split(phrase, ' ') AS pt, len(list_filter(range(1, len(string_split(phrase, ' '))), lambda n: string_split(phrase, ' ')[1:n] = string_split(phrase, ' ')[len(string_split(phrase, ' ')) - n + 1:])) > 0 AS laps, ' ' || replace(phrase, ' ', '  ') || ' ' AS sp FROM ph),
tf AS MATERIALIZED (SELECT chunk_id, phrase, size, type, part, page_pdf_start, CASE WHEN laps THEN list_sum(list_transform(fs, lambda f: len(list_filter(range(1, len(f) - len(pt) + 2), lambda i: f[i:i + len(pt) - 1] = pt))))::DOUBLE ELSE (length(joined) - length(replace(joined, sp, ''))) / length(sp) END AS tf FROM docs_t JOIN voc ON contains(joined, sp)),
df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT tf.*, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean_size)) AS w FROM tf JOIN df USING (phrase), st),
sc AS (SELECT query_id, chunk_id, count(*) AS matched, round(sum(w), 6) AS bm25, any_value(type) AS type, any_value(part) AS part, any_value(page_pdf_start) AS page_pdf_start FROM ph JOIN w USING (phrase) GROUP BY 1, 2),
need AS (SELECT query_id, count(*) AS phrases FROM ph GROUP BY 1),
bm_top AS MATERIALIZED (SELECT c.*, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank, 0.0 AS z FROM sc c JOIN need USING (query_id) JOIN q USING (query_id) WHERE matched = phrases AND {_FITS} QUALIFY rank <= 96)"""
LEXICAL_SQL = f"""
src AS (SELECT query_id, chunk_id, part, page_pdf_start, score, 'lexical_exact' AS tag FROM exact_top UNION ALL SELECT query_id, chunk_id, part, page_pdf_start, (501 - rank)::DOUBLE, 'lexical_fts' FROM bm_top),
mg AS (SELECT query_id, chunk_id, max(score) AS score, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags, any_value(part) AS part, any_value(page_pdf_start) AS page_pdf_start FROM src GROUP BY 1, 2),
lex AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id {_ORDER}) AS rank FROM mg QUALIFY rank <= 96)"""
PAYLOAD = r"CASE WHEN type IN ('clause', 'annex', 'table') AND trim(CASE WHEN type = 'table' THEN coalesce(table_md, text) ELSE text END, ' ' || chr(9) || chr(13) || chr(10)) <> '' THEN coalesce(ref, '') || chr(10) || coalesce(heading, '') || chr(10) || chr(10) || trim(CASE WHEN type = 'table' THEN coalesce(table_md, text) ELSE text END, ' ' || chr(9) || chr(13) || chr(10)) END"


def _embed_sql(name: str, source: str, key: str, text: str) -> str:
    """CTEs that give (key, idx, v) of the hashing embedding of ``text``."""
    return f"""
{name}_w AS MATERIALIZED (SELECT {key}, list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda t: t <> '') AS ws FROM {source}),
{name}_f AS (SELECT {key}, unnest(list_concat(list_transform(ws, lambda w: 'w:' || w), list_transform(range(1, greatest(len(ws), 1)), lambda i: 'b:' || ws[i] || '_' || ws[i + 1]))) AS f FROM {name}_w),
{name}_h AS (SELECT {key}, CAST('0x' || substr(md5(f), 1, 15) AS BIGINT) AS h FROM {name}_f),
{name}_v AS MATERIALIZED (SELECT {key}, h % 384 AS idx, sum(CASE WHEN (h >> 59) & 1 = 1 THEN -1 ELSE 1 END * (1 + ((h >> 48) & 255) / 255.0::DOUBLE)) AS v FROM {name}_h GROUP BY 1, 2),
{name}_n AS (SELECT {key}, sqrt(sum(v * v)) AS norm FROM {name}_v GROUP BY 1)"""


_SIGNAL = INTENT_ROUTER_SQL.split("array_to_string(")[1].split(", '|') AS signal")[0]
SEMANTIC_SQL = f"""
pl AS MATERIALIZED (SELECT *, {PAYLOAD} AS p FROM c),
plk AS MATERIALIZED (SELECT * FROM pl WHERE p IS NOT NULL),
rt AS MATERIALIZED (SELECT query_id, embedded AS e, {_SIGNAL} AS toks FROM ({INTENT_ROUTER_SQL}) JOIN (SELECT query_id AS qid, query_text FROM eval_queries) ON qid = query_id),
{_embed_sql('ce', 'plk', 'chunk_id', 'p')},
{_embed_sql('qe', 'rt', 'query_id', 'e')},
dt AS (SELECT query_id, chunk_id, sum(a.v * b.v) AS d FROM qe_v a JOIN ce_v b USING (idx) GROUP BY 1, 2),
hy AS (SELECT q.query_id, c.chunk_id, c.part, c.page_pdf_start, round(0.45 * coalesce(d / nullif(qe_n.norm * ce_n.norm, 0), 0) + 0.55 * CASE WHEN len(toks) = 0 THEN 0 ELSE len(list_filter(toks, lambda t: contains(lower(coalesce(ref, '') || ' ' || coalesce(heading, '') || ' ' || substr(coalesce(text, ''), 1, 420)), t))) / len(toks) END, 6) AS score
  FROM plk c JOIN q ON {_FITS} JOIN rt USING (query_id) LEFT JOIN dt USING (query_id, chunk_id) LEFT JOIN qe_n USING (query_id) LEFT JOIN ce_n USING (chunk_id)),
sem AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id {_ORDER}) AS rank FROM hy QUALIFY rank <= 96)"""
FUSED_SQL = f"""
fu AS (SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.chunk_id, s.chunk_id) AS chunk_id, coalesce(l.part, s.part) AS part, coalesce(l.page_pdf_start, s.page_pdf_start) AS page_pdf_start,
  round(coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 9) AS score,
  CASE WHEN l.rank IS NULL THEN 'semantic_rrf' WHEN s.rank IS NULL THEN 'lexical_rrf' ELSE 'hybrid_rrf' END AS match_kind
  FROM lex l FULL JOIN sem s ON l.query_id = s.query_id AND l.chunk_id = s.chunk_id),
fused AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id {_ORDER}) AS rank FROM fu QUALIFY rank <= 96)"""


def with_sql(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


NODES_SQL = f"""
WITH n AS MATERIALIZED (SELECT 'node::' || c.k AS chunk_id, c.node_type AS type, c.page_pdf_start, d.part, lower(coalesce(c.ref, '')) AS r, lower(coalesce(c.heading, '')) AS h, lower(coalesce(c.text, '')) AS t
  FROM {current_sql('nodes', 'node_id')} c JOIN {current_sql('docs', 'doc_id')} d ON d.k = trim(c.doc_id)),
q AS (SELECT query_id, part_filter, chunk_type_filter, lower(trim(query_text)) AS q FROM eval_queries),
a AS (SELECT query_id, chunk_id, c.part, page_pdf_start, CASE WHEN r = q.q THEN 850.0 WHEN h = q.q THEN 760.0 WHEN contains(r, q.q) THEN 650.0 WHEN contains(h, q.q) THEN 620.0 WHEN contains(substr(t, 1, 420), q.q) THEN 580.0 ELSE 550.0 END::DOUBLE AS score
  FROM n c JOIN q ON (contains(r, q.q) OR contains(h, q.q) OR contains(t, q.q)) AND {_FITS})
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id {_ORDER}) AS rank FROM a QUALIFY rank <= 96
"""
EMBED_SQL = with_sql(CORPUS_SQL, f"pl AS (SELECT *, {PAYLOAD} AS p FROM c), plk AS MATERIALIZED (SELECT * FROM pl WHERE p IS NOT NULL)", _embed_sql("ce", "plk", "chunk_id", "p"), select="SELECT chunk_id, any_value(sha256(p)) AS payload_hash, count(*) FILTER (round(v / norm, 6) <> 0) AS places, round(sum(round(v / norm, 6)), 3) AS total FROM plk JOIN ce_v USING (chunk_id) JOIN ce_n USING (chunk_id) GROUP BY chunk_id")
ROUTER_SQL = with_sql(
    CORPUS_SQL, EXACT_SQL, BM25_SQL, LEXICAL_SQL, SEMANTIC_SQL, FUSED_SQL,
    f"ans AS (SELECT query_id, chunk_id, part, page_pdf_start, score FROM lex JOIN (SELECT query_id, exact FROM ({INTENT_ROUTER_SQL})) USING (query_id) WHERE exact UNION ALL SELECT query_id, chunk_id, part, page_pdf_start, score FROM fused JOIN (SELECT query_id, exact FROM ({INTENT_ROUTER_SQL})) USING (query_id) WHERE NOT exact),"
    f"top10 AS (SELECT *, row_number() OVER (PARTITION BY query_id {_ORDER}) AS rank FROM ans QUALIFY rank <= 10)",
    select="SELECT query_id, chunk_id, rank, score, CASE WHEN c.page_pdf_start IS NULL AND page_pdf_end IS NULL THEN 'unknown' WHEN c.page_pdf_start IS NULL THEN CAST(page_pdf_end AS VARCHAR) WHEN page_pdf_end IS NULL OR c.page_pdf_start = page_pdf_end THEN CAST(c.page_pdf_start AS VARCHAR) ELSE c.page_pdf_start || '-' || page_pdf_end END AS pages FROM top10 JOIN c USING (chunk_id)",
)

_MODE = f"(SELECT query_id, exact FROM ({INTENT_ROUTER_SQL}))"
#: The units of the first ten answers are those of ``pinpoint_scored``, which the module of evaluation adds.
ANSWER_CTES = (
    CORPUS_SQL, EXACT_SQL, BM25_SQL, LEXICAL_SQL, SEMANTIC_SQL, FUSED_SQL,
    f"ans AS (SELECT query_id, chunk_id, part, page_pdf_start, score, 'lexical' AS mode FROM lex JOIN {_MODE} USING (query_id) WHERE exact UNION ALL SELECT query_id, chunk_id, part, page_pdf_start, score, 'hybrid' FROM fused JOIN {_MODE} USING (query_id) WHERE NOT exact),"
    f"top10 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id {_ORDER}) AS rank FROM ans QUALIFY rank <= 10)",
)
_STATES = f"""e0 AS (SELECT k AS chunk_id, type, ref, heading, text, table_md FROM (SELECT *, {key_sql('chunk_id')} AS k, row_number() OVER (PARTITION BY {key_sql('chunk_id')} ORDER BY ingested_at) AS rn FROM chunks WHERE {key_sql('chunk_id')} IS NOT NULL) WHERE rn = 1),
now AS MATERIALIZED (SELECT chunk_id, sha256({PAYLOAD}) AS h FROM c WHERE type IN ('clause', 'annex', 'table')), old AS MATERIALIZED (SELECT chunk_id, sha256({PAYLOAD}) AS h FROM e0 WHERE {PAYLOAD} IS NOT NULL),
j AS MATERIALIZED (SELECT now.chunk_id, now.h, old.h AS oh FROM now LEFT JOIN old USING (chunk_id))"""
EMBED_RUN_SQL = with_sql(CORPUS_SQL, _STATES, select="""SELECT 'chunks' AS measure, count(*)::DOUBLE AS value FROM j UNION ALL SELECT 'eligible', count(h)::DOUBLE FROM j UNION ALL SELECT 'skipped_empty', count(*) FILTER (h IS NULL)::DOUBLE FROM j
UNION ALL SELECT 'stale_before', count(*) FILTER (h IS NOT NULL AND (oh IS NULL OR oh <> h))::DOUBLE FROM j UNION ALL SELECT 'stale_after', 0 UNION ALL SELECT 'embedded', count(h)::DOUBLE FROM j
UNION ALL SELECT 'made', count(*) FILTER (h IS NOT NULL AND (oh IS NULL OR oh <> h))::DOUBLE FROM j UNION ALL SELECT 'stored', count(*)::DOUBLE FROM (SELECT chunk_id FROM old UNION SELECT chunk_id FROM j WHERE h IS NOT NULL)""")
COVERAGE_SQL = with_sql(CORPUS_SQL, _STATES, "m AS (SELECT count(h)::DOUBLE AS eligible, count(*) FILTER (h IS NOT NULL AND oh IS NOT NULL)::DOUBLE AS embedded, count(*) FILTER (h <> oh)::DOUBLE AS stale FROM j)", select="""SELECT 'eligible' AS measure, eligible AS value FROM m UNION ALL SELECT 'embedded', embedded FROM m UNION ALL SELECT 'stale', stale FROM m
UNION ALL SELECT 'coverage', round(embedded / eligible, 6) FROM m UNION ALL SELECT 'stale_ratio', round(stale / embedded, 6) FROM m""")

QUERIES = {
    "search_exact": (search_exact, with_sql(CORPUS_SQL, EXACT_SQL, select="SELECT query_id, chunk_id, score, CASE score WHEN 1000 THEN 'exact_ref' WHEN 900 THEN 'exact_heading' WHEN 700 THEN 'ref_contains' ELSE 'heading_contains' END AS match_kind, rank FROM exact_top")),
    "search_nodes": (search_nodes, NODES_SQL),
    "search_bm25": (search_bm25, with_sql(CORPUS_SQL, BM25_SQL, select="SELECT query_id, chunk_id, bm25, rank, (501 - rank)::DOUBLE AS score FROM bm_top")),
    "search_lexical": (search_lexical, with_sql(CORPUS_SQL, EXACT_SQL, BM25_SQL, LEXICAL_SQL, select="SELECT query_id, chunk_id, score, tags, rank FROM lex")),
    "search_semantic": (search_semantic, with_sql(CORPUS_SQL, SEMANTIC_SQL, select="SELECT query_id, chunk_id, score, rank FROM sem")),
    "search_hybrid": (search_hybrid, with_sql(CORPUS_SQL, EXACT_SQL, BM25_SQL, LEXICAL_SQL, SEMANTIC_SQL, FUSED_SQL, select="SELECT query_id, chunk_id, score, match_kind, rank FROM fused")),
    "search_router": (search_router, ROUTER_SQL),
    "chunk_embeddings": (chunk_embeddings, EMBED_SQL),
    "embed_run": (embed_run, EMBED_RUN_SQL),
    "embedding_coverage": (embedding_coverage, COVERAGE_SQL),
}
