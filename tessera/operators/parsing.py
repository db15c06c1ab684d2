"""From pages to structured chunks, and from chunks to paragraphs, lists, notes and table rows.

A row holds all pages of an extraction, or one chunk, so each is parsed by itself: the parsers keep state from line to line, which is why
they are Python over Arrow batches. Null pages and texts give no rows.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of headings, markers, cells and requirements, and the tokens of ratings.
TOC = re.compile(r"\.{3,}\s*\d+\s*$")
TABLE_HEADING = re.compile(r"^\s*(Table\s+\d+)\s*[-:–—]?\s*(.*)$")
ANNEX_HEADING = re.compile(r"^\s*(Annex\s+[A-Z])(?:\s*\([^)]*\))?\s*[-:–—]?\s*(.*)$")
CLAUSE_HEADING = re.compile(r"^\s*(\d+(?:\.\d+)+)\s+(.+)$")
LIST_ITEM = re.compile(r"^((?:(?:\d+[A-Za-z]?|[A-Za-z])(?:[.)])?|[-*•—–]))(?:\s+(.+))?$")
NOTE_ITEM = re.compile(r"^(NOTE(?:\s+\d+)?)(?:\s+(.+))?$", re.I)
CELL_SPLIT = re.compile(r"\t+|\s{2,}")
MARKER_TOKEN = re.compile(r"^\d+[a-z]?$")
RATINGS = frozenset(["+", "++", "-", "--", "+/-", "+/−", "−/+", "o"])
#: Punctuation around a rating, and the words that occur together in download and licence banners.
AROUND = "().:;,"
BANNERS = (("store order", "downloaded:"), ("single user licence only", "networking prohibited"), ("single user license only", "networking prohibited"), ("licensed to", "license #", "downloaded:"))
#: A heading's title is at most so many bytes; a page's edge line that may repeat, too.
TITLE_BYTES, EDGE_BYTES, EDGE_PAGES = 140, 120, 3
CLAUSE_WORDS, LEAST_WORDS, OVERLAP_WORDS = 900, 300, 75


def marker_label(marker: str) -> str:
    bare = re.sub(r"[–—]", "-", marker.strip().rstrip(").:;"))
    if not marker.strip() or bare in ("-", "*", "•"):
        return "-"
    note = re.fullmatch(r"NOTE(?:\s+(\d+))?\s*", bare, re.I)
    if note:
        return f"NOTE {note[1]}" if note[1] else "NOTE"
    return bare.lower()


def marker_style(label: str) -> str:
    for style, pattern in (("bullet", "-"), ("numeric", r"\d+"), ("alpha", "[a-z]"), ("roman", "[ivxlcdm]{2,}"), ("alnum", r"\d+[a-z]?")):
        if re.fullmatch(pattern, label):
            return style
    return "symbol"


# --- pages --------------------------------------------------------------------------------------------------------------------------------


def edge_form(line: str) -> str:
    return " ".join(line.split()).lower()


def is_banner(line: str) -> bool:
    low = line.lower()
    return any(all(w in low for w in words) for words in BANNERS)


def rating_of(token: str) -> str | None:
    """A rating without the punctuation around it; None for other tokens."""
    bare = token.strip(AROUND)
    return bare if bare in RATINGS else None


def normalise_pages(pages: list[str]) -> tuple[list[str], dict[str, int]]:
    """Pages without banners and lines that repeat at their top or bottom, with words divided at line ends joined; and how much was done.
    Which lines repeat is told from the pages as they came."""
    split = [p.split("\n") for p in pages]
    filled = [[i for i, x in enumerate(lines) if x.strip()] for lines in split]
    repeated = []
    for end in (0, -1):
        seen = Counter(edge_form(lines[at[end]]) for lines, at in zip(split, filled) if at)
        repeated.append({x for x, n in seen.items() if n >= EDGE_PAGES and len(x.encode()) <= EDGE_BYTES})
    done = {"headers": 0, "footers": 0, "merges": 0}
    out = []
    for lines in split:
        lines = [x for x in lines if not is_banner(x)]
        for end, name in ((0, "headers"), (-1, "footers")):
            at = [i for i, x in enumerate(lines) if x.strip()]
            if at and edge_form(lines[at[end]]) in repeated[end]:
                lines = lines[: at[end]] + lines[at[end] + 1 :]
                done[name] += 1
        merged, i = [], 0
        while i < len(lines):
            if i + 1 < len(lines) and divides(lines[i], lines[i + 1]):
                merged.append(lines[i].rstrip().rstrip("-") + lines[i + 1].lstrip())
                done["merges"] += 1
                i += 2
            else:
                merged.append(lines[i])
                i += 1
        out.append("\n".join(merged))
    return out, done


def divides(line: str, after: str) -> bool:
    """Whether a line ends in the middle of a word: a hyphen after an ASCII letter, and a small ASCII letter next."""
    left, right = line.rstrip(), after.lstrip()
    stem = left.rstrip("-")
    return left.endswith("-") and right[:1].isascii() and right[:1].islower() and stem[-1:].isascii() and stem[-1:].isalpha()


def heading_of(line: str) -> tuple[str, str] | None:
    """(type, reference) of a heading line."""
    if TOC.search(line):
        return None
    for kind, pattern in (("table", TABLE_HEADING), ("annex", ANNEX_HEADING)):
        if m := pattern.match(line):
            return kind, m[1].strip()
    m = CLAUSE_HEADING.match(line)
    return ("clause", m[1]) if m and m[2].strip() and len(m[2].strip().encode()) <= TITLE_BYTES else None


@dataclass
class Chunk:
    kind: str
    ref: str
    heading: str
    page_start: int
    page_end: int
    lines: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        body = "\n".join(self.lines).strip()
        return f"{self.heading}\n\n{body}" if body else self.heading


def chunks_of(pages: list[str]) -> list[Chunk]:
    """Each heading opens a chunk that takes all lines up to the next, over pages; what comes before the first is left out."""
    out: list[Chunk] = []
    for number, page in enumerate(pages, 1):
        for line in filter(None, map(str.strip, page.splitlines())):
            found = heading_of(line)
            if found:
                out.append(Chunk(*found, line, number, number))
            elif out:
                out[-1].lines.append(line)
                out[-1].page_end = number
    return out


def word_windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of at most ``size`` words, each repeating the last ``overlap`` of the one before."""
    words = text.split()
    if len(words) <= size:
        return [" ".join(words)] if words else []
    step = max(1, size - min(overlap, size - 1))
    return [" ".join(words[i : i + size]) for i in range(0, max(1, len(words) - (size - step)), step)]


def split_long(chunk: Chunk) -> list[str]:
    """The texts of a chunk, more than one if a clause or annex has too many words."""
    body = " ".join(chunk.lines)
    if chunk.kind == "table" or len(body.split()) <= CLAUSE_WORDS:
        return [chunk.text]
    size = max(CLAUSE_WORDS - len(chunk.heading.split()), LEAST_WORDS)
    return [f"{chunk.heading}\n\n{w}" for w in word_windows(body, size, OVERLAP_WORDS)]


# --- blocks -------------------------------------------------------------------------------------------------------------------------------


def body_lines(text: str, heading: str | None, blanks: bool = False) -> list[str]:
    """The lines of a text without its heading; trimmed and without blank ones unless they are asked for."""
    lines = text.split("\n")
    if lines and heading is not None and lines[0].strip() == heading.strip():
        lines = lines[1:]
    return lines if blanks else [x.strip() for x in lines if x.strip()]


def paragraphs(text: str, heading: str | None = None) -> list[str]:
    """Paragraphs end at blank lines, before list and note markers, and after a sentence unless a small letter follows."""
    out: list[str] = []
    held = ""
    for raw in [*body_lines(text, heading, blanks=True), ""]:
        line = raw.strip()
        opens = bool(LIST_ITEM.match(line) or NOTE_ITEM.match(line))
        if held and (not line or opens or (held[-1] in ".;" and not line[0].islower())):
            out.append(held)
            held = ""
        held = f"{held} {line}".strip()
    return out


@dataclass
class Item:
    label: str
    style: str
    depth: int
    text: str


def list_items(text: str, heading: str | None = None) -> tuple[list[Item], bool, bool]:
    """(items, fell back, had candidates): marked lines with what follows them; a note ends an item. Without any item that has a text the
    parse fell back."""
    items: list[Item] = []
    held: list = []
    seen = False

    def close() -> None:
        if held and held[2].strip():
            label, raw, body = held
            style = marker_style(label)
            indent = raw[: len(raw) - len(raw.lstrip())]
            depth = min(sum(4 if c == "\t" else 1 for c in indent) // 2, 5) + 1
            if depth == 1 and items and (items[-1].style, style) in {("numeric", "alpha"), ("numeric", "roman"), ("alpha", "bullet")}:
                depth = min(items[-1].depth + 1, 6)
            items.append(Item(label, style, depth, body.strip()))
        held.clear()

    for raw in body_lines(text, heading, blanks=True):
        line = raw.strip()
        if not line:
            continue
        if m := LIST_ITEM.match(line):
            close()
            seen = True
            held.extend([marker_label(m[1]), raw, m[2] or ""])
        elif NOTE_ITEM.match(line):
            close()
        elif held:
            held[2] = f"{held[2]} {line}"
    close()
    return in_marker_order(items), seen and not items, seen


def in_marker_order(items: list[Item]) -> list[Item]:
    """Three items or more in the order of their markers, if all are letters or all are numbers with or without a letter."""
    labels = [i.label for i in items]
    if len(items) >= 3 and all(re.fullmatch("[a-z]", x) for x in labels):
        return sorted(items, key=lambda i: i.label)
    if len(items) >= 3 and all(MARKER_TOKEN.match(x) for x in labels):
        return sorted(items, key=lambda i: (int(re.match(r"\d+", i.label)[0]), re.sub(r"\d+", "", i.label) or "~"))
    return items


def note_items(text: str, heading: str | None = None) -> list[tuple[str, str]]:
    """(label, text) of notes; a list marker ends a note."""
    out: list[list[str]] = []
    is_open = False
    for line in body_lines(text, heading):
        if m := NOTE_ITEM.match(line):
            out.append([marker_label(m[1]), m[2] or ""])
            is_open = True
        elif LIST_ITEM.match(line):
            is_open = False
        elif is_open:
            out[-1][1] = f"{out[-1][1]} {line}"
    return [(a, b.strip()) for a, b in out if b.strip()]


# --- tables -------------------------------------------------------------------------------------------------------------------------------


def is_marker(cell: str) -> bool:
    return bool(MARKER_TOKEN.match(marker_label(cell)))


def cells_of(line: str) -> list[str]:
    """The cells of a line: parted by tabs or two spaces, else by bars, else one."""
    for parts in (CELL_SPLIT.split(line.strip()), line.split("|")):
        cells = [c.strip() for c in parts if c.strip()]
        if len(cells) > 1:
            return cells
    return [line.strip()] if line.strip() else []


def merge_continuations(rows: list[list[str]]) -> list[list[str]]:
    """Rows of one cell go to the description of the marker row before them."""
    out: list[list[str]] = []
    for row in rows:
        if len(row) == 1 and not is_marker(row[0]) and out and len(out[-1]) > 1 and is_marker(out[-1][0]):
            out[-1][1] = f"{out[-1][1]} {row[0]}"
        else:
            out.append(list(row))
    return out


def split_ratings(rows: list[list[str]]) -> list[list[str]]:
    """Two ratings or more at the end of a description become cells, if the description keeps a word."""
    out = []
    for row in rows:
        tokens = row[1].split() if len(row) == 2 and is_marker(row[0]) else []
        n = len(tokens)
        while n and rating_of(tokens[n - 1]):
            n -= 1
        out.append([row[0], " ".join(tokens[:n]), *map(rating_of, tokens[n:])] if len(tokens) >= 3 and 0 < n <= len(tokens) - 2 else list(row))
    return out


def spread_ratings(rows: list[list[str]], least: int = 8, width: int = 6) -> list[list[str]]:
    """Eight ratings or more in one row belong to the marker rows right above it: they are dealt from the top, up to six cells a row."""
    out = [list(r) for r in rows]
    for i, row in enumerate(out):
        pool = deque(r for r in map(rating_of, row[2:]) if r)
        start = i
        while start and is_marker(out[start - 1][0]):
            start -= 1
        if len(pool) < least or start == i or not is_marker(row[0]):
            continue
        out[i] = row[:2]
        for target in out[start:i]:
            while pool and len(target) < width:
                target.append(pool.popleft())
        out[i].extend(pool)
    return out


def backfill_ratings(rows: list[list[str]], lines: list[str]) -> list[list[str]]:
    """In a matrix of levels A to D, each on a line of its own, marker rows without a rating get one each from those of the body, the last first."""
    letters = {x.strip().upper() for x in lines} & set("ABCD")
    if not any("ASIL" in x.upper() for x in lines) or len(letters) < 4:
        return rows
    pool = [r for line in lines for r in map(rating_of, line.split()) if r]
    out = [list(r) for r in rows]
    for row in out:
        if pool and row and is_marker(row[0]) and not any(rating_of(t) for c in row[2:] for t in c.split()):
            row.append(pool.pop())
    return out


def reconstruct(lines: list[str]) -> list[list[str]]:
    """Rows from a body in which markers, descriptions and ratings stand on lines of their own."""
    rows: list[list[str]] = []
    waiting: deque[str] = deque()
    row: list[str] = []

    def close(new: list[str]) -> list[str]:
        if len(row) > 1:
            rows.append(row)
        return new

    for line in filter(None, map(str.strip, lines)):
        if re.fullmatch(r"(?:\d+[A-Za-z]?\s+)+\d+[A-Za-z]?", line):
            row = close([])
            waiting = deque(line.split())
        elif m := re.fullmatch(r"(\d+[A-Za-z]?)[.)]?\s+(.+)", line):
            row = close([m[1], m[2].strip()])
        elif m := re.fullmatch(r"(\d+[A-Za-z]?)[.)]?", line):
            row = close([])
            waiting.append(m[1])
        elif line in ("+", "++"):
            if row:
                row.append(line)
        elif waiting and re.fullmatch("[a-z]", line.strip(" .,;:()").lower()):
            continue
        elif waiting:
            row = close([waiting.popleft(), line])
        elif len(row) > 1:
            row[1] = f"{row[1]} {line}".strip()
    close([])
    return rows + [[m, ""] for m in waiting]


@dataclass
class Quality:
    rows: int = 0
    markers: int = 0
    described: int = 0
    sparse: int = 0
    overloaded: int = 0
    observed: int = 0
    expected: int = 0


def quality_of(rows: list[list[str]]) -> Quality:
    """Counts of rows with markers and descriptions, of sparse and overloaded rows, and of the markers seen and to be expected."""
    q, seen = Quality(rows=len(rows)), set()
    for row in rows:
        tokens = {t for cell in row for t in map(marker_label, cell.split()) if MARKER_TOKEN.match(t)}
        described = len(row) > 1 and any(c.isascii() and c.isalpha() for c in row[1])
        if row and is_marker(row[0]):
            q.markers += 1
            q.described += described
        q.sparse += sum(bool(c.strip()) for c in row) <= 1
        q.overloaded += len(tokens) > 1
        seen |= tokens
    q.observed = len(seen)
    letters: dict[int, set[str]] = {}
    for t in seen:
        letters.setdefault(int(re.match(r"\d+", t)[0]), set()).update(re.sub(r"\d+", "", t))
    q.expected = sum(max(ord(max(s)) - ord(min(s)) + 1, len(s)) if s else 1 for s in letters.values())
    return q


def prefer(original: Quality, other: Quality) -> bool:
    """Whether a reconstruction is the better reading: clearly fewer sparse rows, or clearly more described ones."""
    if other.rows < 2 or not other.markers:
        return False
    sparse = original.sparse / original.rows if original.rows else 1.0
    described = original.described / original.markers if original.markers else 0.0
    return other.sparse / other.rows + 0.05 < sparse or other.described / other.markers > described + 0.10 or (other.sparse < original.sparse and other.described >= original.described)


def header_rows(rows: list[list[str]]) -> int:
    """1 if the first row has no marker and at least two filled cells."""
    return int(bool(rows) and bool(rows[0]) and not is_marker(rows[0][0]) and sum(bool(c.strip()) for c in rows[0]) >= 2)


def table_rows(text: str, heading: str | None = None) -> tuple[list[list[str]], bool]:
    """(rows, fell back) of a table's text."""
    lines = body_lines(text, heading)

    def aligned(rows: list[list[str]]) -> list[list[str]]:
        return backfill_ratings(spread_ratings(split_ratings(merge_continuations(rows))), lines)

    def structured(rows: list[list[str]]) -> bool:
        return len(rows) >= 2 and any(len(r) > 1 for r in rows)

    rows = aligned([c for c in (cells_of(x) for x in lines if not is_banner(x)) if c])
    other = reconstruct(lines)
    if other and (prefer(quality_of(rows), quality_of(other)) or (not structured(rows) and structured(other))):
        rows = aligned(other)
    return rows, not structured(rows)


def markdown(rows: list[list[str]]) -> str:
    """A Markdown table, short rows filled up; the first row is its head."""
    if not rows:
        return ""
    width = max(map(len, rows))
    full = [[*(c.replace("|", "\\|") for c in r), *[""] * (width - len(r))] for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" if r is not None else "|" + "---|" * width for r in [full[0], None, *full[1:]])


def csv_line(row: list[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n ') else c for c in row)


# --- DataFrames ---------------------------------------------------------------------------------------------------------------------------


def structured_chunks(extractions: DataFrame) -> DataFrame:
    """(extract_id, type, ref, heading, occurrence, part, page_start, page_end, text, table_md, table_csv, rows, header_rows, markers, sparse,
    fell_back) of all extractions (extract_id, pages); those behind the text are null for other chunks than tables."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, pages in zip(batch["extract_id"], batch["pages"]):
                seen: Counter = Counter()
                clean, _ = normalise_pages([p or "" for p in pages] if pages is not None else [])
                for c in chunks_of(clean):
                    table: tuple = (None,) * 7
                    if c.kind == "table":
                        rows, fell_back = table_rows(c.text, c.heading)
                        q = quality_of(rows)
                        table = (markdown(rows), "\n".join(map(csv_line, rows)), q.rows, header_rows(rows), q.markers, q.sparse, fell_back)
                    for part, text in enumerate(split_long(c), 1):
                        seen[c.ref] += 1
                        out.append((key, c.kind, c.ref, c.heading, seen[c.ref], part, c.page_start, c.page_end, text, *table))
            columns = ["extract_id", "type", "ref", "heading", "occurrence", "part", "page_start", "page_end", "text", "table_md", "table_csv", "rows", "header_rows", "markers", "sparse", "fell_back"]
            yield pd.DataFrame(out, columns=columns).astype({"rows": "Int32", "header_rows": "Int32", "markers": "Int32", "sparse": "Int32", "fell_back": "boolean"})

    key = extractions.schema["extract_id"].dataType.simpleString()
    return extractions.select("extract_id", "pages").mapInPandas(run, f"extract_id {key}, type string, ref string, heading string, occurrence int, part int, page_start int, page_end int, text string, table_md string, table_csv string, rows int, header_rows int, markers int, sparse int, fell_back boolean")


def blocks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, kind, place, label, style, depth, text): the paragraphs, list items and notes of clauses and annexes, and the rows of
    tables (cells joined by a bar), from (chunk_id, type, heading, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, kind, text in zip(batch["chunk_id"], batch["type"], batch["text"]):
                heading = text.split("\n", 1)[0]
                if kind == "table":
                    rows, _ = table_rows(text, heading)
                    heads = header_rows(rows)
                    out += [(key, "header_row" if i <= heads else "table_row", i, marker_label(r[0]) if is_marker(r[0]) else None, None, None, " | ".join(r)) for i, r in enumerate(rows, 1)]
                else:
                    out += [(key, "paragraph", i, None, None, None, p) for i, p in enumerate(paragraphs(text, heading), 1)]
                    out += [(key, "list_item", i, x.label, x.style, x.depth, x.text) for i, x in enumerate(list_items(text, heading)[0], 1)]
                    out += [(key, "note_item", i, a, None, None, b) for i, (a, b) in enumerate(note_items(text, heading), 1)]
            yield pd.DataFrame(out, columns=["chunk_id", "kind", "place", "label", "style", "depth", "text"]).astype({"depth": "Int32"})

    return chunks.where(F.col("text").isNotNull()).select("chunk_id", "type", "text").mapInPandas(run, "chunk_id string, kind string, place int, label string, style string, depth int, text string")


# --- the node tree of a document ----------------------------------------------------------------------------------------------------------


def safe_id(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", text).lower().strip("_")


@dataclass
class Node:
    node_id: str
    parent: str | None
    kind: str
    ref: str | None
    heading: str | None
    page_start: int
    page_end: int
    text: str | None
    path: str
    label: str | None = None
    list_depth: int | None = None
    item_index: int | None = None
    row: int | None = None
    col: int | None = None
    is_header: bool | None = None
    order: int = 0


def nodes_of(doc: str, pages: list[str], title: str | None = None, sections: list[tuple[str, str, int]] = (), with_pages: bool = False) -> list[Node]:
    """All nodes of a document.

    ``sections`` are headings of its outline as (reference, heading, page); ``with_pages`` adds a node per page that isn't blank. A clause
    hangs on the latest earlier clause of its longest dotted prefix, else on the section of its first part, else on the document; a table on
    the last clause, else on its section. Blocks of a chunk hang on its node: lists with nested items (an item's parent is the last one a
    level higher; where there is none its level goes down until there is), notes, paragraphs, requirements, rows and cells. A path joins
    the type and reference (or heading) of each node from the document down.
    """
    out: list[Node] = []
    root = f"{doc}:node:document"
    clauses: dict[str, str] = {}
    of_section: dict[str, str] = {}
    paths: dict[str, str] = {}
    seen: Counter = Counter()
    last: str | None = None

    def add(node: str, parent: str | None, kind: str, ref: str | None, heading: str | None, span: tuple[int, int], text: str | None, **more) -> str:
        named = f"{kind}:{ref or heading or 'unlabeled'}"
        paths[node] = f"{paths[parent]} > {named}" if parent in paths else named
        out.append(Node(node, parent, kind, ref, heading, *span, text, paths[node], order=len(out) + 1, **more))
        return node

    whole = (1, max(1, len(pages)))
    add(root, None, "document", None, title, whole, None)
    for ref, heading, page in sections:
        of_section.setdefault(ref, add(f"{doc}:node:section_heading:{safe_id(ref)}", root, "section_heading", ref, heading, (page, page), heading, label=ref))
    clean, _ = normalise_pages(pages)
    if with_pages:
        for number, page in enumerate(clean, 1):
            if page.strip():
                add(f"{doc}:node:page:{number:04d}", root, "page", f"PDF page {number}", f"Page {number}", (number, number), page.strip())
    for c in chunks_of(clean):
        kind = "subclause" if c.kind == "clause" and c.ref.count(".") > 1 else c.kind
        span = (c.page_start, c.page_end)
        seen[kind, safe_id(c.ref)] += 1
        name = f"{doc}:node:{kind}:{safe_id(c.ref)}:{seen[kind, safe_id(c.ref)]:03d}"
        parent = None
        if c.kind == "table":
            parent = last
        elif c.kind == "clause":
            prefix = c.ref
            while "." in prefix and parent is None:
                prefix = prefix.rpartition(".")[0]
                parent = clauses.get(prefix)
        parent = parent or of_section.get(c.ref.partition(".")[0]) or root
        node = add(name, parent, kind, c.ref, c.heading, span, c.heading, label=safe_id(c.ref))
        if c.kind == "clause":
            clauses[c.ref] = last = node
        if c.kind == "table":
            rows, _ = table_rows(c.text, c.heading)
            heads = header_rows(rows)
            for r, cells in enumerate(rows, 1):
                row = add(f"{node}:row:{r:03d}", node, "table_row", c.ref, None, span, " | ".join(cells), label=f"row {r}", row=r, is_header=r <= heads)
                for k, cell in enumerate(cells, 1):
                    add(f"{node}:cell:{r:03d}:{k:03d}", row, "table_cell", c.ref, None, span, cell, label=f"r{r}c{k}", row=r, col=k, is_header=r <= heads)
            continue
        items, _, _ = list_items(c.text, c.heading)
        if items:
            over = {0: add(f"{node}:list:001", node, "list", c.ref, None, span, None)}
            counts: Counter = Counter()
            for i, item in enumerate(items, 1):
                level = item.depth
                while level - 1 not in over:
                    level -= 1
                over = {d: n for d, n in over.items() if d < level}
                counts[over[level - 1]] += 1
                over[level] = add(f"{node}:list:001:item:{i:03d}", over[level - 1], "list_item", c.ref, None, span, item.text, label=item.label, list_depth=level, item_index=counts[over[level - 1]])
        notes = note_items(c.text, c.heading)
        if notes:
            note = add(f"{node}:note:001", node, "note", c.ref, None, span, None)
            for i, (label, text) in enumerate(notes, 1):
                add(f"{note}:item:{i:03d}", note, "note_item", c.ref, None, span, text, label=label, item_index=i)
        for i, text in enumerate(paragraphs(c.text, c.heading), 1):
            add(f"{node}:paragraph:{i:03d}", node, "paragraph", c.ref, None, span, text, label=str(i))
        atoms = [a.strip() for a in re.split(r"[.;]\s+", " ".join(body_lines(c.text, c.heading)))]
        for i, text in enumerate((a for a in atoms if re.search(r"\bshall(?:\s+not)?\b|\bshould\b", a, re.I)), 1):
            add(f"{node}:req:{i:03d}", node, "requirement_atom", c.ref, None, span, text, label=f"req {i}")
    return out


NODE_COLUMNS = ["node_id", "parent_node_id", "node_type", "ref", "heading", "page_start", "page_end", "text", "ancestor_path", "label", "list_depth", "item_index", "row_idx", "col_idx", "is_header", "order_index"]


def structured_nodes(extractions: DataFrame, with_pages: bool = False) -> DataFrame:
    """The nodes of all extractions (extract_id, doc_id, pages, and if there are any sections: array of (ref, heading, page)); ids start with
    the document and the extraction, as a document may have several."""
    has_sections = "sections" in extractions.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            outlines = batch["sections"] if has_sections else [None] * len(batch)
            for key, doc, pages, outline in zip(batch["extract_id"], batch["doc_id"], batch["pages"], outlines):
                sections = [(x["ref"], x["heading"], int(x["page"])) for x in outline] if outline is not None else []
                out.extend((key, *vars(n).values()) for n in nodes_of(f"{doc}:{key}", [p or "" for p in pages] if pages is not None else [], None, sections, with_pages))
            yield pd.DataFrame(out, columns=["extract_id", *NODE_COLUMNS]).astype({c: "Int32" for c in ("list_depth", "item_index", "row_idx", "col_idx")} | {"is_header": "boolean"})

    key = extractions.schema["extract_id"].dataType.simpleString()
    schema = f"extract_id {key}, node_id string, parent_node_id string, node_type string, ref string, heading string, page_start int, page_end int, text string, ancestor_path string, label string, list_depth int, item_index int, row_idx int, col_idx int, is_header boolean, order_index int"
    return extractions.select("extract_id", "doc_id", "pages", *(["sections"] if has_sections else [])).mapInPandas(run, schema)


# --- outlines and what was read -----------------------------------------------------------------------------------------------------------

# The entities of outline labels.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&#160;": " ", "\xa0": " ", "&amp;": "&"}


def outline_label(raw: str) -> str:
    """The text of an outline entry: entities and no-break spaces resolved, white space collapsed."""
    for entity, text in ENTITIES.items():
        raw = raw.replace(entity, text)
    return " ".join(raw.split())


def sections_of(outline: str) -> list[tuple[str, str, int]]:
    """(reference, heading, page) of the numbered entries of an outline in XML, the first of each reference."""
    out: dict[str, tuple[str, str, int]] = {}
    for page, raw in re.findall(r'<item\s+page="(\d+)"\s*>(.*?)</item>', outline, re.S):
        m = re.fullmatch(r"(\d+)\s+(\S.*)", outline_label(raw))
        if m:
            out.setdefault(m[1], (m[1], m[2], int(page)))
    return list(out.values())


def ocr_candidates(pages: list[str], mode: str, least_chars: int = 120) -> list[int]:
    """The numbers of the pages that an OCR backend should read: none (``off``), all (``force``) or those with few visible characters."""
    if mode not in ("off", "auto", "force"):
        raise ValueError(f"no such mode: {mode}")
    return [i for i, p in enumerate(pages, 1) if mode == "force" or (mode == "auto" and len("".join(p.split())) < least_chars)]
