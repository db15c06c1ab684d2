"""Scalar functions on text, identifiers and markers as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]+"
RATING_TOKENS = ("+", "++", "-", "--", "+/-", "+/−", "−/+", "o")

# Words that carry no signal in a query, and openings of a query that are stripped before it is embedded.
SIGNAL_STOPWORDS = "a an and around concept concerning for guidance in of on related requirement requirements the to with".split()
PINPOINT_STOPWORDS = "a an and as at by concept concerning for from guidance in into of on or related requirement requirements table that the to with".split()
QUERY_OPENINGS = ("concept guidance for ", "requirements concerning ", "requirements regarding ", "requirements for ", "guidance for ")


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, SPACE, " "))


def edge_form(line: Column) -> Column:
    """A page's first or last line as it is compared with those of other pages."""
    return F.lower(collapse(line))


def sanitise_id(ref: Column) -> Column:
    """A reference as a part of an identifier: lower-case ASCII letters, digits and single underscores."""
    return F.btrim(F.lower(F.regexp_replace(ref, "[^A-Za-z0-9]+", "_")), F.lit("_"))


def marker_label(marker: Column) -> Column:
    """A list or note marker in its normal form: ``-`` for bullets, ``NOTE n`` for notes, else lower case without its closing sign."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(marker), r"[).:;]+$", ""), "[–—]", "-")
    number = F.regexp_extract(F.upper(bare), r"^NOTE\s+([0-9]+)\s*$", 1)
    return (
        F.when(F.btrim(marker) == "", "-")
        .when(bare.isin("-", "*", "•"), "-")
        .when(F.upper(bare) == "NOTE", "NOTE")
        .when(number != "", F.concat(F.lit("NOTE "), number))
        .otherwise(F.lower(bare))
    )


def marker_style(label: Column) -> Column:
    """The kind of a normal marker label."""
    return (
        F.when(label == "-", "bullet")
        .when(label.rlike("^[0-9]+$"), "numeric")
        .when(label.rlike("^[a-z]$"), "alpha")
        .when(label.rlike("^[ivxlcdm]{2,}$"), "roman")
        .when(label.rlike("^[0-9]+[a-z]?[0-9]*$") & ~label.rlike("[a-z][0-9]"), "alnum")
        .otherwise("symbol")
    )


def marker_number(label: Column) -> Column:
    """The number of a marker like 12 or 12b, null for others."""
    return F.regexp_extract(label, "^([0-9]{1,18})[a-z]?$", 1).try_cast("long")


def marker_suffix(label: Column) -> Column:
    """The letter of a marker like 12b, null for others."""
    suffix = F.regexp_extract(label, "^[0-9]+([a-z])$", 1)
    return F.when(suffix != "", suffix)


def list_depth(line: Column) -> Column:
    """1 to 6 from the white space before a line; a tab counts as four."""
    indent = F.regexp_extract(line, r"^(\s*)", 1)
    units = F.length(indent) + 3 * (F.length(indent) - F.length(F.replace(indent, F.lit("\t"), F.lit(""))))
    return F.when(line.isNotNull(), (F.least(F.floor(units / 2), F.lit(5)) + 1).cast("long"))


def ref_path(ref: Column, kind: Column) -> Column:
    """A clause reference as a path; other references as they are."""
    return F.when(kind == "clause", F.replace(ref, F.lit("."), F.lit(" > "))).otherwise(ref)


def clause_type(ref: Column, kind: Column) -> Column:
    """The node type of a chunk: a clause of more than two parts is a subclause."""
    return F.when((kind == "clause") & (F.size(F.split(ref, "[.]")) > 2), "subclause").otherwise(kind)


def citation_anchor(doc: Column, parent_ref: Column, kind: Column, label: Column, order: Column) -> Column:
    """doc:ref:kind:label; the order, or else ``root``, stands for a missing label."""
    last = F.coalesce(F.when(F.btrim(label) != "", sanitise_id(label)), order.cast("string"), F.lit("root"))
    return F.concat_ws(":", doc, sanitise_id(parent_ref), sanitise_id(kind), last)


def visible_chars(text: Column) -> Column:
    """The number of characters that aren't white space."""
    return F.length(F.regexp_replace(text, SPACE, ""))


def word_count(text: Column) -> Column:
    """The number of words between white space; 0 for blank texts."""
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")


def page_range(start: Column, end: Column) -> Column:
    """``3``, ``3-5`` or ``unknown``."""
    return F.when(start.isNull() & end.isNull(), "unknown").when(start.isNull(), end.cast("string")).when(end.isNull() | (start == end), start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def base_reference(ref: Column) -> Column:
    """A reference cut before its first item, note, paragraph or row, whichever is named first in that order."""
    out = ref
    for word in (" row ", " para ", " note ", " item "):
        out = F.when(F.contains(ref, F.lit(word)), F.substring_index(ref, word, 1)).otherwise(out)
    return out


def citation(series: str, part: Column, year: Column, ref: Column, anchor: Column, label: Column, start: Column, end: Column) -> Column:
    """A citation as it is printed."""
    name = F.when(F.coalesce(ref, F.lit("")) == "", "(unreferenced chunk)").otherwise(ref)
    labelled = F.coalesce(label, F.lit("")) != ""
    base = base_reference(name)
    named = (
        F.when((anchor == "marker") & labelled & F.startswith(label, F.lit("NOTE")), F.concat(base, F.lit(", "), label))
        .when((anchor == "marker") & labelled, F.concat(base, F.lit("("), label, F.lit(")")))
        .when((anchor == "paragraph") & labelled, F.concat(base, F.lit(", para "), label))
        .otherwise(name)
    )
    return F.concat(F.lit(series), F.lit(" "), F.coalesce(part.cast("string"), F.lit("?")), F.lit(":"), F.coalesce(year.cast("string"), F.lit("?")), F.lit(", "), named, F.lit(", PDF pages "), page_range(start, end))


def is_toc_line(line: Column) -> Column:
    """A line of a table of contents: dots and a page number at its end."""
    return line.rlike(r"\.{3,}\s*[0-9]+\s*$")


def is_licence_noise(text: Column) -> Column:
    """A download or licence banner, told by words that occur together."""
    low = F.lower(text)

    def has(*words: str) -> Column:
        out = F.lit(True)
        for w in words:
            out = out & F.contains(low, F.lit(w))
        return out

    single = F.contains(low, F.lit("single user licence only")) | F.contains(low, F.lit("single user license only"))
    return (has("store order", "downloaded:")) | (single & has("networking prohibited")) | has("licensed to", "license #", "downloaded:")


def is_printed_label(label: Column) -> Column:
    """A page label of digits or of Roman letters."""
    return label.rlike("^([0-9]+|[ivxlcdmIVXLCDM]+)$")


def is_rating(token: Column) -> Column:
    return token.isin(*RATING_TOKENS)


def printed_label(page: Column) -> Column:
    """The label printed on a page: of its last five lines from below, then its first two, the first that is one."""
    lines = F.split(F.regexp_replace(page, r"\n$", ""), "\n")
    order = F.concat(F.slice(F.reverse(lines), 1, 5), F.slice(lines, 1, 2))
    bare = F.transform(order, lambda x: F.btrim(F.regexp_replace(x, r"[^A-Za-z0-9\s]", "")))
    found = F.filter(bare, lambda x: x.rlike(r"(?i)^(page\s+[0-9ivxlcdm]+|[0-9]{1,4}|[ivxlcdm]{1,8})$"))
    return F.lower(F.regexp_replace(F.try_element_at(found, F.lit(1)), r"(?i)^page\s+", ""))


def alnum_tokens(text: Column, least: int, stopwords: list[str], digits: bool = False) -> Column:
    """The sorted distinct tokens of ASCII letters and digits of a text, without short ones and stopwords."""
    tokens = F.split(F.lower(text), "[^a-z0-9]+")

    def kept(t: Column) -> Column:
        long_enough = F.length(t) >= least
        if digits:
            long_enough = long_enough | t.rlike("^[0-9]+$")
        return long_enough & ~t.isin(*stopwords)

    return F.array_sort(F.array_distinct(F.filter(tokens, kept)))


def strip_opening(query: Column) -> Column:
    """A query without the first of the usual openings, unless nothing would be left."""
    text = collapse(query)
    out = text
    for opening in reversed(QUERY_OPENINGS):
        rest = F.btrim(F.substring(text, F.lit(len(opening) + 1), F.length(text)))
        out = F.when(F.startswith(F.lower(text), F.lit(opening)) & (rest != ""), rest).otherwise(out)
    return out


def exact_intent(query: Column) -> Column:
    """Whether a query names a reference: ``table 3``, ``annex b`` or a dotted clause number first."""
    low = F.lower(F.btrim(query))
    second = F.regexp_extract(low, r"^\S+\s+(\S+)", 1)
    first = F.regexp_extract(low, r"^(\S+)", 1)
    return F.when(F.startswith(low, F.lit("table ")), second.rlike("^[0-9]+$")).when(F.startswith(low, F.lit("annex ")), second.rlike("^[a-z]+$")).otherwise(first.rlike(r"^[0-9]+(\.[0-9]+)+$"))
