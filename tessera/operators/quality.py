"""Structure, completeness and consistency measures of nodes, chunks and pages, and the gates built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as X
from tessera.operators.ranks import positions
from tessera.sources.scratch import Scratch
from tessera.sources.tables import key_of

#: Which parents a node type may have.
ALLOWED_PARENTS = {
    "table_row": ("table",),
    "table_cell": ("table_row",),
    "list_item": ("list", "list_item"),
    "note": ("clause", "subclause", "annex"),
    "note_item": ("note",),
    "paragraph": ("clause", "subclause", "annex"),
}


def count_if(condition: Column) -> Column:
    """Rows for which it holds; 0 for no rows, and an unknown condition doesn't hold."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b > 0, a / b)


def unpivot(row: DataFrame, name: str = "measure", value: str = "value") -> DataFrame:
    """A row of measures as rows (measure, value); values as double."""
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in row.columns]
    return row.select(F.inline(F.array(*pairs)))


def _missing_parent() -> Column:
    return count_if((F.col("node_type") != "document") & key_of("parent_node_id").isNull()).alias("missing_parent")


def _wrong_parents() -> list[Column]:
    """Counts over nodes that name a parent, with its key ``k`` and its type; the key is null where there is no such node."""
    wrong = [count_if((F.col("node_type") == t) & F.col("k").isNotNull() & ~F.col("parent_type").isin(*allowed)).alias(f"invalid_{t}_parent") for t, allowed in ALLOWED_PARENTS.items()]
    return [count_if(F.col("k").isNull()).alias("dangling_parent"), *wrong]


def structural_invariants(nodes: DataFrame) -> DataFrame:
    """(measure, value): violations of the tree's rules: missing and dangling parents, and parents of the wrong type.

    A blank parent key counts as none. One self-join over all nodes; all counts come from it.
    """
    child = nodes.select(key_of("parent_node_id").alias("p"), "node_type")
    parent = nodes.select(F.col("node_id").alias("k"), F.col("node_type").alias("parent_type"))
    joined = child.where("p is not null").join(parent, F.col("p") == F.col("k"), "left")
    return unpivot(nodes.agg(_missing_parent())).unionByName(unpivot(joined.agg(*_wrong_parents())))


def _item_counts() -> list[Column]:
    item = F.col("node_type") == "list_item"
    complete = F.col("list_depth").isNotNull() & F.col("list_marker_style").isNotNull() & F.col("item_index").isNotNull()
    return [count_if(item).alias("list_items"), count_if(item & complete).alias("complete")]


def _deep_item() -> Column:
    return (F.col("node_type") == "list_item") & (F.coalesce("list_depth", F.lit(1)) > 1)


def _deeper_than_parent() -> Column:
    return (F.col("parent_type") != "list_item") | F.col("parent_depth").isNull() | (F.col("parent_depth") >= F.col("list_depth"))


def list_semantics(nodes: DataFrame) -> DataFrame:
    """(measure, value): list items, those with all their fields, and those deeper than one whose parent isn't a shallower item."""
    parent = nodes.select(F.col("node_id").alias("k"), F.col("node_type").alias("parent_type"), F.col("list_depth").alias("parent_depth"))
    deep = nodes.where(_deep_item()).select(key_of("parent_node_id").alias("p"), "list_depth").join(parent, F.col("p") == F.col("k"))
    bad = deep.agg(count_if(_deeper_than_parent()).alias("depth_violations"))
    return unpivot(nodes.where("node_type = 'list_item'").agg(*_item_counts())).unionByName(unpivot(bad))


def _cell_counts() -> list[Column]:
    cell = F.col("node_type") == "table_cell"
    complete = F.lit(True)
    for f in ["table_node_id", "row_idx", "col_idx", "is_header", "row_span", "col_span"]:
        complete = complete & F.col(f).isNotNull()
    return [
        count_if(cell).alias("cells"),
        count_if(cell & complete).alias("complete_cells"),
        count_if(cell & ((F.col("row_span") < 1) | (F.col("col_span") < 1))).alias("invalid_spans"),
        count_if(cell & (F.col("row_idx") == 1)).alias("header_cells"),
        count_if(cell & (F.col("row_idx") == 1) & F.col("is_header").isNotNull()).alias("flagged_header_cells"),
    ]


def _row_counts(nodes: DataFrame) -> DataFrame:
    per_row = nodes.where("node_type = 'table_cell'").select(key_of("parent_node_id").alias("p")).where("p is not null").groupBy("p").agg(F.count("*").alias("n"))
    rows = nodes.where("node_type = 'table_row'").select("node_id").join(per_row, F.col("node_id") == F.col("p"), "left")
    return rows.agg(F.count("*").alias("rows"), count_if(F.col("n") == 1).alias("one_cell_rows"))


def table_semantics(nodes: DataFrame) -> DataFrame:
    """(measure, value): cells, complete cells, wrong spans, header cells and flags, rows, and rows of one cell."""
    return unpivot(nodes.where("node_type = 'table_cell'").agg(*_cell_counts())).unionByName(unpivot(_row_counts(nodes)))


def node_measures(nodes: DataFrame, *more: Column) -> DataFrame:
    """(measure, value): what ``structural_invariants``, ``list_semantics`` and ``table_semantics`` give, and the sums ``more``, in one pass
    over the nodes and one join of them with their parents."""
    child = nodes.select(key_of("parent_node_id").alias("p"), "node_type", "list_depth").where("p is not null")
    parent = nodes.select(F.col("node_id").alias("k"), F.col("node_type").alias("parent_type"), F.col("list_depth").alias("parent_depth"))
    joined = child.join(parent, F.col("p") == F.col("k"), "left")
    deep = count_if(F.col("k").isNotNull() & _deep_item() & _deeper_than_parent()).alias("depth_violations")
    plain = nodes.agg(_missing_parent(), *_item_counts(), *_cell_counts(), *more)
    return unpivot(plain).unionByName(unpivot(joined.agg(*_wrong_parents(), deep))).unionByName(unpivot(_row_counts(nodes)))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, copies) of keys with more than one row."""
    return rows.select(key_of(key).alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")


def sequence_gaps(chunks: DataFrame) -> DataFrame:
    """(doc_id, ref, chunk_seq, expected): chunks whose number doesn't follow the one before of the same document and reference; the first
    should be 1. After a gap counting goes on from the number found."""
    keyed = chunks.where("type = 'clause'").select("doc_id", F.lower("ref").alias("ref"), "chunk_seq", "chunk_id")
    before = F.lag("chunk_seq").over(Window.partitionBy("doc_id", "ref").orderBy("chunk_seq", "chunk_id"))
    out = keyed.withColumn("expected", F.coalesce(before + 1, F.lit(1)))
    return out.where(F.col("chunk_seq") != F.col("expected")).select("doc_id", "ref", "chunk_id", "chunk_seq", "expected")


#: Words of a clause piece, and words that two neighbouring pieces should share.
PIECE_WORDS, SHARED_WORDS = 900, (50, 100)


def _words(chunks: DataFrame) -> Column:
    """The words of each chunk, from its column ``words`` where a caller has counted them."""
    return F.col("words") if "words" in chunks.columns else X.word_count(F.col("text"))


def overlap_words(chunks: DataFrame, least: int = 250, most: int = SHARED_WORDS[1]) -> DataFrame:
    """(doc_id, ref, chunk_seq, overlap): of neighbouring pieces of a clause, both of at least ``least`` words, the most words that end one
    and start the next, letter case aside, behind the heading of each."""

    def words(text: Column) -> Column:
        return F.filter(F.split(F.lower(text), X.SPACE), lambda w: w != "")

    def body(text: str) -> Column:
        return words(F.regexp_replace(text, r"(?s)^.*?\n\n", ""))

    # Texts move as they are, and only those of pieces that are long enough; they are cut into words once they are in a pair.
    keyed = chunks.where("type = 'clause' and text is not null").select("doc_id", F.lower("ref").alias("ref"), "chunk_seq", "chunk_id", "text", _words(chunks).alias("size"))
    keyed = keyed.withColumn("text", F.when(F.col("size") >= least, F.col("text")))
    w = Window.partitionBy("doc_id", "ref").orderBy("chunk_seq", "chunk_id")
    pairs = keyed.withColumns({"prev_text": F.lag("text").over(w), "prev_seq": F.lag("chunk_seq").over(w), "prev_size": F.lag("size").over(w)})
    pairs = pairs.where((F.col("chunk_seq") == F.col("prev_seq") + 1) & (F.col("size") >= least) & (F.col("prev_size") >= least)).withColumns({"words": body("text"), "prev": body("prev_text")})
    longest = F.least(F.lit(most), F.size("words"), F.size("prev"))
    sizes = F.when(longest > 0, F.sequence(F.lit(1), longest)).otherwise(F.array().cast("array<int>"))
    fits = F.filter(sizes, lambda n: F.slice("prev", F.size("prev") - n + 1, n) == F.slice("words", F.lit(1), n))
    return pairs.select("doc_id", "ref", "chunk_id", "chunk_seq", F.coalesce(F.array_max(fits), F.lit(0)).cast("long").alias("overlap"))


def clause_split(chunks: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """(measure, value): words of the longest clause piece, pieces of over 900 words, those among them that aren't exempt by (doc_id, ref),
    neighbouring long pieces, those that share 50 to 100 words, and breaks in the numbering."""
    clauses = chunks.where("type = 'clause' and text is not null").select("doc_id", F.lower("ref").alias("ref"), "type", "text", _words(chunks).alias("words"))
    if exempt is not None:
        clauses = clauses.join(exempt.select("doc_id", F.lower("ref").alias("ref"), F.lit(True).alias("exempt")).distinct(), ["doc_id", "ref"], "left")
    return unpivot(clauses.agg(*clause_sizes(clauses))).unionByName(clause_neighbours(chunks))


def clause_sizes(chunks: DataFrame) -> list[Column]:
    """The counts of ``clause_split`` over the sizes of single pieces; a column ``exempt`` of the chunks tells which are."""
    words = F.when((F.col("type") == "clause") & F.col("text").isNotNull(), _words(chunks))
    exempt = F.coalesce("exempt", F.lit(False)) if "exempt" in chunks.columns else F.lit(False)
    over = words > PIECE_WORDS
    return [F.max(words).alias("longest_piece"), count_if(over).alias("oversize"), count_if(over & ~exempt).alias("oversize_not_exempt")]


def clause_neighbours(chunks: DataFrame) -> DataFrame:
    """The measures of ``clause_split`` that look at neighbouring pieces."""
    pairs = overlap_words(chunks).agg(F.count("*").alias("overlap_pairs"), count_if(F.col("overlap").between(*SHARED_WORDS)).alias("overlap_compliant"))
    gaps = sequence_gaps(chunks).agg(F.count("*").alias("sequence_violations"))
    return unpivot(pairs).unionByName(unpivot(gaps))


def repeated_edge_lines(pages: DataFrame, least: int = 3, longest: int = 120) -> DataFrame:
    """(extract_id, edge, line, pages): first or last lines that at least three pages of an extraction share; lines of up to 120 bytes."""
    lines = F.filter(F.transform(F.split("page", "\n"), lambda x: X.edge_form(x)), lambda x: x != "")
    ends = pages.select("extract_id", lines.alias("ls")).where(F.size("ls") > 0).select("extract_id", F.inline(F.array(F.struct(F.lit("header").alias("edge"), F.element_at("ls", 1).alias("line")), F.struct(F.lit("footer").alias("edge"), F.element_at("ls", -1).alias("line")))))
    return ends.where(F.octet_length("line") <= longest).groupBy("extract_id", "edge", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)


def nearest_pages(chunks: DataFrame, seeds: DataFrame, k: int = 256) -> DataFrame:
    """(seed, chunk_id, place): for each seed (seed, chunk_id, doc_id, page) the k chunks of its document with the nearest first page, the
    seed's own chunk first; a chunk without a page is at no distance, a seed without one is on page 0.

    Of each page the first k chunks can matter. They are numbered by page within their document, over ranges; a seed meets the blocks of k
    places around its page only, so no document is paired with itself.
    """
    scratch = Scratch(chunks.sparkSession, "nearest")
    near = chunks.select("doc_id", "chunk_id", F.col("page_pdf_start").alias("c_page"))
    first = near.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "c_page").orderBy("chunk_id"))).where(F.col("n") <= k).drop("n")
    first = scratch.keep(first, "first")
    paged = first.where("c_page is not null")
    held = scratch.keep(positions(paged, ["doc_id"], [F.col("c_page"), F.col("chunk_id")], scratch).withColumn("block", F.floor((F.col("place") - 1) / k)).drop("place"), "held")
    # Where each asked page would be: the block of the last chunk on that page or before it.
    asked = seeds.select("doc_id", F.coalesce("page", F.lit(0)).alias("page")).distinct()
    spans = held.groupBy("doc_id", "block").agg(F.min("c_page").alias("low"))
    marks = spans.select("doc_id", F.col("low").alias("at"), "block", F.lit(0).alias("asks")).unionByName(asked.select("doc_id", F.col("page").alias("at"), F.lit(None).cast("long").alias("block"), F.lit(1).alias("asks")))
    behind = Window.partitionBy("doc_id").orderBy("at", "asks", "block").rowsBetween(Window.unboundedPreceding, 0)  # a row per block and asked page
    located = marks.withColumn("block", F.coalesce(F.max("block").over(behind), F.lit(0))).where("asks = 1").select("doc_id", F.col("at").alias("page"), "block")
    # Chunks of one page may fill three blocks; two further ones on each side hold the k before and behind it, and the pages they end in.
    reach = located.withColumn("block", F.explode(F.sequence(F.col("block") - 3, F.col("block") + 3)))
    gap = F.abs(F.col("c_page") - F.col("page"))
    around = reach.join(held, ["doc_id", "block"]).select("doc_id", "page", "chunk_id", gap.alias("gap"))
    anywhere = located.select("doc_id", "page").join(first.where("c_page is null"), "doc_id").select("doc_id", "page", "chunk_id", F.lit(0).cast("long").alias("gap"))
    best = around.unionByName(anywhere).withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("gap", "chunk_id"))).where(F.col("n") <= k)
    own = seeds.select("seed", "doc_id", F.coalesce("page", F.lit(0)).alias("page"), F.col("chunk_id").alias("own"))
    others = own.join(best, ["doc_id", "page"]).where("chunk_id != own").select("seed", "chunk_id", "n")
    everything = others.unionByName(own.select("seed", F.col("own").alias("chunk_id"), F.lit(0).alias("n")))
    return everything.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("n"))).where(F.col("place") <= k).select("seed", "chunk_id", "place")


def alignment_fields() -> list[Column]:
    """Of the cells (col_idx, text) of a table row: how many, the text of the first, and whether another one has a rating."""
    rated = F.max(F.when((F.col("col_idx") > 1) & F.exists(F.split("text", X.SPACE), lambda w: X.is_rating(w)), 1).otherwise(0))
    return [F.count("*").alias("cells"), F.max(F.when(F.col("col_idx") == 1, F.col("text"))).alias("first"), rated.alias("rated")]


def aligned(rows: DataFrame) -> DataFrame:
    """The table rows whose first cell begins with a marker, with ``bad``: no description follows it there."""
    marker = F.regexp_extract(F.col("first"), r"^\s*([0-9]+[A-Za-z]?)(?:[.)]?\s|[.)]?$)", 1)
    words = F.btrim(F.regexp_replace(F.col("first"), r"^\s*[0-9]+[A-Za-z]?[.)]?", ""))
    bad = (F.length(F.regexp_replace(words, "[^A-Za-z]", "")) <= 1) & (X.word_count(words) <= 1)
    return rows.where(marker != "").withColumn("bad", bad)


def table_scorecard(cells: DataFrame) -> DataFrame:
    """(measure, value) over all table rows of (table_id, row_idx, col_idx, text): rows, those with at most one filled cell, those with more
    than one marker, marker rows, those with a description in their second cell, markers seen and markers to be expected.

    A marker is a number with or without a letter. Of a number with letters as many markers are expected as its letters span; else one.
    """
    return scored(table_rows(cells))


def table_rows(cells: DataFrame, *more: Column) -> DataFrame:
    """(table_id, row_idx, filled, tokens, marked, described, markers) and the sums ``more`` of each table row; the cells are looked at once."""
    digit_first = F.filter(F.split("text", X.SPACE), lambda t: F.substring(t, 1, 1).between("0", "9"))  # as every marker is
    tokens = F.filter(F.transform(digit_first, lambda t: F.lower(F.regexp_replace(t, r"[).:;]+$", ""))), lambda t: t.rlike(MARKER))
    marks = cells.select("table_id", "row_idx", "col_idx", "text", tokens.alias("tokens"))
    first = F.max(F.when(F.col("col_idx") == 1, F.lower(F.regexp_replace(F.btrim("text"), r"[).:;]+$", "")).rlike(MARKER)))
    rows = marks.groupBy("table_id", "row_idx").agg(
        *more,
        count_if(F.btrim("text") != "").alias("filled"),
        F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"),
        F.coalesce(first, F.lit(False)).alias("marked"),
        F.coalesce(F.max(F.when(F.col("col_idx") == 2, F.col("text").rlike("[A-Za-z]"))), F.lit(False)).alias("described"),
    )
    return Scratch(cells.sparkSession, "scorecard").keep(rows.withColumn("markers", F.size("tokens")), "rows")


def scored(rows: DataFrame) -> DataFrame:
    """The measures of ``table_scorecard`` over its rows."""
    counted = rows.agg(F.count("*").alias("table_rows"), count_if(F.col("filled") <= 1).alias("sparse_rows"), count_if(F.col("markers") > 1).alias("overloaded_rows"), count_if(F.col("marked")).alias("marker_rows"), count_if(F.col("marked") & F.col("described")).alias("described_rows"))
    seen = rows.select("table_id", F.explode("tokens").alias("token")).distinct()
    seen = seen.select("table_id", "token", F.regexp_extract("token", "^([0-9]+)", 1).alias("number"), F.regexp_extract("token", "([a-z])$", 1).alias("letter"))
    letter = F.when(F.col("letter") != "", F.ascii("letter"))
    span = F.greatest(F.max(letter) - F.min(letter) + 1, F.countDistinct(letter), F.lit(1))
    numbers = seen.groupBy("table_id", "number").agg(F.count("*").alias("n"), span.alias("wanted"))
    total = numbers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("markers_seen"), F.coalesce(F.sum("wanted"), F.lit(0)).alias("markers_expected"))
    return unpivot(counted).unionByName(unpivot(total))


#: A marker of a table row.
MARKER = "^[0-9]+[a-z]?$"
