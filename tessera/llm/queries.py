"""Queries of the problems on texts and scores, over whole tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import fusion, lookalikes, packing, scans, splitting, stuffing, tokens
from tessera.sources.scratch import Scratch
from tessera.sources.tables import current_rows, read

CAPACITY = 2048


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode_column(read(spark, folder, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with text, its size in tokens and its container of 2,048 tokens."""
    sizes = tokens.count_column(read(spark, folder, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY).withColumnRenamed("size", "n_tokens")


LIMIT, OVERLAP = 4000, 200


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return current_rows(read(spark, folder, "chunks"), "chunk_id", ["doc_id", "ref", "chunk_seq", "text"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks whose text had to be cut."""
    return splitting.split_rows(_chunks(spark, folder), "chunk_id", "text", "chunk_seq", ["doc_id", "ref"], LIMIT, OVERLAP, only_cut=True).where("piece = 1").select("chunk_id")


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk, the long ones in pieces."""
    return splitting.split_rows(_chunks(spark, folder), "chunk_id", "text", "chunk_seq", ["doc_id", "ref"], LIMIT, OVERLAP)


def p6_joined_again(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every cut chunk put together again, and whether they keep to limit, overlap and numbering."""
    pieces = Scratch(spark, "joined").keep(p6_pieces(spark, folder), "pieces")
    return splitting.joined_again(pieces, "chunk_id", "text", "chunk_seq", ["doc_id", "ref"], LIMIT, OVERLAP)


_CURRENT_CHUNKS = "SELECT chunk_id, text FROM (SELECT trim(chunk_id) AS chunk_id, text, row_number() OVER (PARTITION BY trim(chunk_id) ORDER BY ingested_at DESC) AS rn FROM chunks) WHERE rn = 1"
P6_JOINED_SQL = f"SELECT chunk_id, md5(text) AS digest, true AS fits, true AS overlaps, true AS counted FROM ({_CURRENT_CHUNKS}) WHERE length(text) > 4000"
P6_FOUND_SQL = """
SELECT chunk_id FROM (SELECT trim(chunk_id) AS chunk_id, text, row_number() OVER (PARTITION BY trim(chunk_id) ORDER BY ingested_at DESC) AS rn FROM chunks)
WHERE rn = 1 AND length(text) > 4000
"""


def _shares(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "hybrid_rows").select(F.col("query_id").alias("query"), F.col("hit.chunk_id").alias("item"), "scorer", "score", F.col("scored_at").alias("at"))
    return fusion.fuse(rows, read(spark, folder, "scorers"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk that comes first for each query."""
    return fusion.first_places(_shares(spark, folder)).withColumnsRenamed({"query": "query_id", "item": "chunk_id"})


def p2_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk of each query with its share and place."""
    return fusion.ranking(_shares(spark, folder)).withColumnsRenamed({"query": "query_id", "item": "chunk_id"})


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are stuffing by their larger part."""
    return p9_line_shares(spark, folder).where("stuffed").select("doc_id")


def p9_line_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The words of every document by the kind of their line."""
    return stuffing.line_shares(read(spark, folder, "documents"), "doc_id", "text")


def _looks(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, key, text): current nodes by text and current chunks by table_md."""
    nodes = current_rows(read(spark, folder, "nodes"), "node_id", ["text"]).select(F.lit("nodes").alias("table_name"), F.col("node_id").alias("key"), "text")
    chunks = current_rows(read(spark, folder, "chunks"), "chunk_id", ["table_md"]).select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("key"), F.col("table_md").alias("text"))
    return nodes.unionByName(chunks)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of nodes by text, and of chunks by table_md, that look the same and differ in their characters."""
    return lookalikes.same_looks(_looks(spark, folder), "table_name", "key", "text")


def p5_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every current node with its text, and every current chunk with its table_md, in the one form."""
    scratch = Scratch(spark, "canonical")
    rows = scratch.keep(_looks(spark, folder), "rows")
    odd = lookalikes.canonical_texts(rows, ["table_name", "key"], "text", scratch).select("table_name", "key", F.col("canon").alias("text"))
    return rows.where(F.col("text").isNull() | F.col("text").rlike(lookalikes.PLAIN)).unionByName(odd)


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The classes of rows that look the same and aren't the same characters, with every member."""
    return lookalikes.classes(_looks(spark, folder), "table_name", "key", "text")


def _form_sql(text: str) -> str:
    """What ``lookalikes.table_form`` gives for texts in Latin letters, in SQL; the lists of characters are made by rule."""
    forms = {chr(c): unicodedata.normalize("NFC", lookalikes.look(chr(c))) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and not lookalikes.ignorable(chr(c))}
    one = [(c, f) for c, f in forms.items() if len(f) == 1 and f != c]
    out = f"regexp_replace({text}, '\\r\\n|[\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g')"
    out = f"regexp_replace({out}, '[\\p{{Cf}}\\x{{FE00}}-\\x{{FE0F}}\\x{{180B}}-\\x{{180F}}\\x{{E0100}}-\\x{{E01EF}}\\x{{34F}}\\x{{115F}}\\x{{1160}}\\x{{17B4}}\\x{{17B5}}\\x{{3164}}\\x{{FFA0}}]', '', 'g')"
    for c, f in forms.items():
        if len(f) > 1 and f.isascii() and f.isalpha():
            out = f"replace({out}, '{c}', '{f}')"
    pairs = [(c, f.replace("'", "''")) for c, f in one]
    return f"nfc_normalize(translate(nfc_normalize({out}), '{''.join(c for c, _ in pairs)}', '{''.join(f for _, f in pairs)}'))"


def _p5_sql(select: str) -> str:
    current = "(SELECT *, row_number() OVER (PARTITION BY trim({0}) ORDER BY ingested_at DESC) AS rn FROM {1} WHERE trim({0}) <> '')"
    sides = f"SELECT 'nodes' AS table_name, trim(node_id) AS key, text FROM {current.format('node_id', 'nodes')} WHERE rn = 1 UNION ALL SELECT 'chunks', trim(chunk_id), table_md FROM {current.format('chunk_id', 'chunks')} WHERE rn = 1"
    return f"""WITH r AS ({sides}),
o AS (SELECT text, {_form_sql('text')} AS canon FROM (SELECT DISTINCT text FROM r WHERE regexp_matches(text, '[^\x20-\x7e\n\t]'))),
f AS MATERIALIZED (SELECT table_name, key, text, coalesce(canon, text) AS canon FROM r LEFT JOIN o USING (text)),
s AS MATERIALIZED (SELECT table_name, canon, text, min(key) AS spelling_key, count(*) AS copies FROM f WHERE text IS NOT NULL GROUP BY ALL),
w AS (SELECT table_name, canon, min(spelling_key) AS class_key, count(*) AS spellings FROM s GROUP BY ALL HAVING count(*) > 1)
{select}"""


P5_CANONICAL_SQL = _p5_sql("SELECT table_name, key, canon AS text FROM f")
P5_CLASSES_SQL = _p5_sql("SELECT table_name, key, class_key, spelling_key, copies, spellings FROM f JOIN s USING (table_name, canon, text) JOIN w USING (table_name, canon)")
P5_FOUND_SQL = _p5_sql("SELECT DISTINCT table_name, least(f.key, s.spelling_key) AS key_a, greatest(f.key, s.spelling_key) AS key_b FROM f JOIN s USING (table_name, canon) WHERE f.text <> s.text")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that carry marks of scanning: extractions with all their pages, current nodes and chunks with one text."""
    pages = read(spark, folder, "extracted_pages").select(F.lit("extracted_pages").alias("table_name"), F.col("extract_id").cast("string").alias("record_key"), F.lit(True).alias("paged"), "pages")
    out = pages
    for name, key in (("nodes", "node_id"), ("chunks", "chunk_id")):
        rows = current_rows(read(spark, folder, name), key, ["text"]).where("text is not null")
        out = out.unionByName(rows.select(F.lit(name).alias("table_name"), F.col(key).alias("record_key"), F.lit(False).alias("paged"), F.array("text").alias("pages")))
    return Scratch(spark, "records").keep(out, "records")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct repairs of every record."""
    return scans.Repair(_records(spark, folder)).repairs().select("table_name", "record_key", "noise", "token").distinct()


def p3_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every record as continuous paragraphs."""
    return scans.Repair(_records(spark, folder)).texts()
