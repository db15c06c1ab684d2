"""Queries as they are asked and answered: modes, filters, fallback and time limit of one query, and the facts that go with its results."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import pinpoint as P
from tessera.operators import retrieval as R
from tessera.operators.ancestry import PREVIEW, nearest_refs, previews
from tessera.sources import embeddings as E
from tessera.sources.scratch import Scratch
from tessera.sources.tables import key_of

MODES = ("lexical", "semantic", "hybrid")
NODE_FIELDS = ["parent_node_id", "node_type", "ref", "heading", "order_index", "page_pdf_start", "page_pdf_end", "text", "row_idx", "col_idx", "table_node_id", "citation_anchor_id"]


@dataclass(frozen=True)
class Ask:
    """One query with its options. Filters are trimmed, in lower case and none if blank; candidates and passages are kept within bounds."""

    text: str
    mode: str = "lexical"
    lexical_k: int = R.CANDIDATES
    semantic_k: int = R.CANDIDATES
    rrf_k: int = R.RRF_K
    model_id: str | None = None
    allow_fallback: bool = False
    timeout_ms: int = 2000
    limit: int = 10
    part: int | None = None
    chunk_type: str | None = None
    node_type: str | None = None
    with_ancestors: bool = False
    with_descendants: bool = False
    with_pinpoint: bool = False
    max_units: int = 3

    def checked(self) -> Ask:
        def filter_of(value: str | None) -> str | None:
            return (value or "").strip().lower() or None

        if not self.text.strip():
            raise ValueError("the query is empty")
        if self.mode not in MODES:
            raise ValueError(f"no such mode: {self.mode}")
        limit = max(1, self.limit)
        return replace(self, text=self.text.strip(), limit=limit, lexical_k=R.clamp(self.lexical_k, limit), semantic_k=R.clamp(self.semantic_k, limit), chunk_type=filter_of(self.chunk_type), node_type=filter_of(self.node_type), max_units=max(1, min(self.max_units, 12)))


class TimeLimit:
    """The time a query may take, looked at between its stages; 0 is no limit."""

    def __init__(self, timeout_ms: int):
        self.began, self.timeout_ms = time.monotonic(), timeout_ms

    @property
    def passed_ms(self) -> float:
        return (time.monotonic() - self.began) * 1000

    def check(self, stage: str) -> None:
        if self.timeout_ms and self.passed_ms > self.timeout_ms:
            raise TimeoutError(f"query timed out after {self.timeout_ms} ms during {stage}")


def exact_intent(text: str) -> bool:
    """Whether a query names a reference: ``table 3``, ``annex b`` or a dotted clause number first."""
    words = text.strip().lower().split()
    if len(words) > 1 and words[0] in ("table", "annex"):
        return words[1].isascii() and (words[1].isdigit() if words[0] == "table" else words[1].isalpha())
    parts = words[0].split(".") if words else []
    return len(parts) > 1 and all(p.isascii() and p.isdigit() for p in parts)


def hydrate(hits: DataFrame, chunks: DataFrame, nodes: DataFrame, queries: DataFrame, max_units: int = 3, series: str = "RDS") -> DataFrame:
    """The hits (query_id, chunk_id, ...) with their chunk's facts, ``snippet``, ``citation``, ``parent_ref``, ``ancestors`` (of the stored
    path), ``descendants`` (array of the nodes below with previews), ``kinds`` (their number by type) and ``pinpoints`` (the best passages).

    Each of these is one join for all hits. A chunk without a known node has no parent and nothing below it.
    """
    scratch = Scratch(chunks.sparkSession, "answers")
    hits = scratch.keep(hits, "hits")
    facts = chunks.select("chunk_id", "doc_id", "part", "year", "type", "ref", "heading", "page_pdf_start", "page_pdf_end", "leaf_node_type", "ancestor_path", "anchor_type", "anchor_label_norm", "citation_anchor_id", key_of("origin_node_id").alias("origin"), "text")
    asked = facts.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    cited = X.citation(series, F.col("part"), F.col("year"), F.col("ref"), F.col("anchor_type"), F.col("anchor_label_norm"), F.col("page_pdf_start"), F.col("page_pdf_end"))
    ancestors = F.when(F.coalesce(F.btrim("ancestor_path"), F.lit("")) != "", F.split("ancestor_path", " > ")).otherwise(F.array().cast("array<string>"))
    preview = X.collapse(F.substring(F.coalesce("text", F.lit("")), 1, R.SNIPPET))
    facts = asked.select("*", cited.alias("citation"), ancestors.alias("ancestors"), preview.alias("snippet"))
    origins = asked.where("origin is not null").select(F.col("origin").alias("node_id")).distinct()
    marked = nodes.join(origins.withColumn("wanted", F.lit(True)), "node_id", "left")
    parents = nearest_refs(marked, F.col("wanted")).withColumnRenamed("node_id", "p_id")
    below = previews(nodes.withColumn("preview", X.collapse(F.substring(F.coalesce("text", F.lit("")), 1, PREVIEW))), origins, ["parent_node_id", "node_type", "ref", "heading", "page_pdf_start", "page_pdf_end", "preview"])
    row = F.struct("place", F.col("descendant").alias("node_id"), "parent_node_id", "node_type", "ref", "heading", "order_index", "page_pdf_start", "page_pdf_end", "preview")
    listed = below.groupBy(F.col("node_id").alias("b_id")).agg(F.array_sort(F.collect_list(row)).alias("descendants"))
    kinds = below.where("node_type is not null").groupBy("node_id", "node_type").agg(F.count("*").alias("n")).groupBy(F.col("node_id").alias("k_id")).agg(F.map_from_entries(F.collect_list(F.struct("node_type", "n"))).alias("kinds"))
    found = P.pinpoint(hits.select("query_id", "chunk_id"), chunks, nodes, queries, max_units)
    unit = F.struct("place", "unit_id", "unit_type", "score", "text")
    points = found.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(unit)).alias("pinpoints"))
    out = hits.join(facts.drop("text", *[c for c in hits.columns if c != "chunk_id"]), "chunk_id")
    out = out.join(parents, F.col("origin") == F.col("p_id"), "left").drop("p_id")
    out = out.join(listed, F.col("origin") == F.col("b_id"), "left").drop("b_id").join(kinds, F.col("origin") == F.col("k_id"), "left").drop("k_id")
    return out.join(points, ["query_id", "chunk_id"], "left")


def answer(ask: Ask, chunks: DataFrame, nodes: DataFrame, index: R.Index, store: DataFrame | None = None, models: DataFrame | None = None) -> dict:
    """The answer to one query as a dict that JSON can hold: the query, its filters, what was done (``retrieval``) and the results.

    A query that names a reference is answered lexically whatever its mode. Where the semantic side isn't there the answer is lexical if
    that is allowed, else it is an error. The time limit is looked at after each stage.
    """
    ask = ask.checked()
    spark, limit = chunks.sparkSession, TimeLimit(ask.timeout_ms)
    row = [(1, ask.text, ask.part, ask.chunk_type, ask.node_type)]
    query = spark.createDataFrame(row, "query_id int, query_text string, part_filter int, chunk_type_filter string, node_type_filter string")
    exact = exact_intent(ask.text)
    mode = "lexical" if exact else ask.mode
    counts = {"lexical": 0, "semantic": 0}
    fallback = None
    lex = sem = None
    if mode != "lexical":
        if ask.model_id is None:
            raise ValueError("semantic retrieval needs a model")
        there, why = E.status(store, models, E.model_of(ask.model_id))
        if not there:
            if not ask.allow_fallback:
                raise LookupError(why)
            mode, fallback = "lexical", why
    if mode in ("lexical", "hybrid"):
        lex = R.lexical(chunks, query, index, ask.lexical_k, nodes).cache()
        counts["lexical"] = lex.count()
        limit.check("lexical retrieval")
    if mode in ("semantic", "hybrid"):
        held = store.where(F.col("model_id") == E.model_of(ask.model_id).model_id)
        sem = R.semantic(chunks, query, held, ask.semantic_k).cache()
        counts["semantic"] = sem.count()
        limit.check("semantic retrieval")
    if mode == "hybrid":
        hits = R.fuse_rrf(lex, sem, 2 * R.CANDIDATE_CAP, ask.rrf_k)
    elif mode == "lexical":
        hits = lex.withColumn("match_kind", F.col("tags"))
    else:
        hits = sem.withColumn("match_kind", F.lit("semantic"))
    columns = [c for c in ("lexical_rank", "semantic_rank") if c in hits.columns]
    fused = hits.count()
    # Hits on nodes name no chunk; they are answered as they are.
    top = R.ranked(hits.drop("rank"), ask.limit).select("query_id", "chunk_id", "rank", "score", "match_kind", *columns).cache()
    limit.check("candidate ranking")
    found = [r.asDict(recursive=True) for r in hydrate(top, chunks, nodes, query, ask.max_units).orderBy("rank").collect()]
    known = {r["chunk_id"] for r in found}
    found += [r.asDict() for r in top.collect() if r["chunk_id"] not in known]
    limit.check("result hydration")
    for df in (lex, sem, top):
        if df is not None:
            df.unpersist()
    for r in found:
        r.pop("query_id", None)
        if not ask.with_ancestors:
            r.pop("ancestors", None)
        if not ask.with_descendants:
            r.pop("descendants", None)
            r.pop("kinds", None)
        if not ask.with_pinpoint:
            r.pop("pinpoints", None)
    retrieval = {
        "requested_mode": ask.mode,
        "effective_mode": mode,
        "lexical_k": ask.lexical_k,
        "semantic_k": ask.semantic_k,
        "lexical_candidate_count": counts["lexical"],
        "semantic_candidate_count": counts["semantic"],
        "fused_candidate_count": fused,
        "fusion": "rrf",
        "rrf_k": ask.rrf_k,
        "semantic_model_id": ask.model_id,
        "exact_intent": exact,
        "exact_intent_forced_lexical": exact and ask.mode != "lexical",
        "fallback_used": fallback is not None,
        "fallback_reason": fallback,
        "pinpoint_enabled": ask.with_pinpoint,
        "pinpoint_max_units": ask.max_units,
        "timeout_ms": ask.timeout_ms,
        "query_duration_ms": round(limit.passed_ms, 3),
    }
    results = sorted(found, key=lambda r: r["rank"])
    return {"query": ask.text, "limit": ask.limit, "returned": len(results), "part_filter": ask.part, "chunk_type_filter": ask.chunk_type, "node_type_filter": ask.node_type, "retrieval": retrieval, "results": results}


def as_json(response: dict) -> str:
    """The answer as indented JSON with a line end."""
    return json.dumps(response, indent=2, ensure_ascii=False, default=str) + "\n"


def as_text(response: dict, series: str = "RDS") -> str:
    """The answer as indented lines: scores with six digits, those of passages with five."""
    done = response["retrieval"]
    out = [
        f"Query: {response['query']}",
        f"Retrieval: requested={done['requested_mode']} effective={done['effective_mode']} fallback={str(done['fallback_used']).lower()} limit_ms={done['timeout_ms']} took_ms={done['query_duration_ms']:.3f}",
        f"Candidates: lexical={done['lexical_candidate_count']} semantic={done['semantic_candidate_count']} fused={done['fused_candidate_count']}",
        f"Results: {response['returned']}",
    ]
    for r in response["results"]:
        start, end = r.get("page_pdf_start"), r.get("page_pdf_end")
        pages = "unknown" if start is None and end is None else str(end) if start is None else str(start) if end in (None, start) else f"{start}-{end}"
        out.append(f"{r['rank']}.\t{series} {r.get('part')}:{r.get('year')}\t{r.get('type')}\t{r.get('ref') or '(unreferenced)'}\tpages {pages}")
        out.append(f"\tmatch={r['match_kind']} score={r['score']:.6f} chunk_id={r['chunk_id']}")
        out += [f"\t{name}: {r[name]}" for name in ("lexical_rank", "semantic_rank", "parent_ref", "citation", "snippet") if r.get(name) is not None]
        for unit in r.get("pinpoints") or ():
            out += [f"\tpinpoint[{unit['place']}]: type={unit['unit_type']} score={unit['score']:.5f} unit_id={unit['unit_id']}", f"\t  text: {unit['text']}"]
    return "\n".join(out) + "\n"
