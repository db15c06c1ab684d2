"""One form for texts that look the same on the page.

The distinct tokens of the corpus are its vocabulary. Its clean spellings (composed, one script, nothing invisible) are put into tries, and
every token with other than plain characters walks through them with a weighted edit automaton: look-alikes and ignorable characters cost
nothing, other edits do. What it reaches within the budget, which is zero, are all spellings that look like it, of which the canonical one
is taken. A token that reaches none is normalised by table. A trie holds the spellings that begin alike and are as long, so that tries can
be spread over all workers.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch

# Letters of other scripts, and rare Latin ones, that look like Latin letters in usual fonts.
LOOK_ALIKES = {
    other: latin
    for others, latins in (
        ("асеорхуѕіјԁһԛԝӏѵүАВЕЅІЈКМНОРСТУХҮԌԚԜѴ", "aceopxysijdhqwlvyABESIJKMHOPCTYXYGQWV"),
        ("οϲϳνΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ocjvABEZHIKMNOPTYXCJ"),
        ("օսոհցՏՕԼ", "ounhgSOL"),
        ("ɑɡı", "agi"),
        ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
        ("ⲞⲢⲤⲦⲨⲬⲎⲔⲘⲚⲟⲣⲥ", "OPCTYXHKMNopc"),
        ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
    )
    for other, latin in zip(others, latins, strict=True)
}
HYPHENS = "‐‑⁃﹣－"
#: Decompositions of a compatibility character into what it looks like; raised and lowered digits, fractions, circles differ in looks.
SAME_LOOKS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")
PLAIN = r"^[\x20-\x7e\n\t]*$"
#: Distinct tokens that one task matches, on average.
SHARD_TOKENS = 20_000
#: What edits cost: an accent more or less, another letter case, any other character. Only what is reached within the budget looks the same.
ACCENT, CASE, OTHER, BUDGET = 1, 1, 2, 0
#: Looks of the first characters by which tokens are routed to a trie. ASCII tokens without letters or with more characters take no place
#: there: what looks like them is normalised by table, which gives the same.
ROUTE, LONGEST = 6, 64
#: A token that is in more than one of so many places is heavy; there are fewer of them than this, which bounds their broadcast.
HEAVY_SHARE = 1000


def ignorable(ch: str) -> bool:
    """Invisible: format characters, variation selectors, fillers and the joiner of graphemes."""
    return unicodedata.category(ch) == "Cf" or "︀" <= ch <= "️" or "᠋" <= ch <= "᠏" or "\U000e0100" <= ch <= "\U000e01ef" or ch in "͏ᅟᅠ឴឵ㅤﾠ"


@lru_cache(maxsize=65536)
def look(ch: str) -> str:
    """What a character looks like, in decomposed plain characters; an ignorable one looks like nothing."""
    if ch < "\x80":
        return ch
    if ignorable(ch):
        return ""
    if ch in LOOK_ALIKES:
        return LOOK_ALIKES[ch]
    if ch in HYPHENS:
        return "-"
    if unicodedata.category(ch) == "Zs":
        return " "
    tag, _, codes = unicodedata.decomposition(ch).partition(" ")
    letters = unicodedata.category(ch)[0] == "L" or unicodedata.category(ch) == "Nl"
    if tag in SAME_LOOKS or (tag == "<compat>" and letters):
        return "".join(look(chr(int(c, 16))) for c in codes.split())
    return "".join(LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFD", ch))


def table_form(text: str) -> str:
    """The composed text of what each character looks like."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(map(look, text)))


def _script(ch: str) -> str:
    return unicodedata.name(ch, "").split(" ")[0] if ch.isalpha() else ""


def clean(token: str) -> bool:
    """A spelling fit to be canonical: composed, nothing invisible or of another width, letters of one script."""
    if token.isascii():
        return True
    if unicodedata.normalize("NFC", token) != token:
        return False
    if any(look(c) != "".join(LOOK_ALIKES.get(x, x) for x in unicodedata.normalize("NFD", c)) for c in token):
        return False
    return len({s for s in map(_script, token) if s}) <= 1


class Trie:
    """Clean spellings by their decomposed characters."""

    def __init__(self, spellings: dict[str, int]):
        self.root: dict = {}
        for spelling, count in spellings.items():
            node = self.root
            for ch in unicodedata.normalize("NFD", spelling):
                node = node.setdefault(ch, {})
            node.setdefault("", []).append((not spelling.isascii(), -count, spelling))

    def reach(self, token: str, budget: int = BUDGET) -> str | None:
        """The canonical one of the spellings within the budget: the cheapest, of these one in ASCII, else the most frequent, else the
        first."""
        states: dict[int, tuple[int, dict]] = {id(self.root): (0, self.root)}
        for ch in unicodedata.normalize("NFD", token):
            if ignorable(ch):  # deleted at no cost
                continue
            for plain in look(ch):
                states = self._step(states, plain, budget)
            if not states:
                return None
        for _ in range(budget // ACCENT):  # accents that only the spelling has, at its end
            states = self._accents(states, budget)
        ends = [(cost, *e) for cost, node in states.values() for e in node.get("", ())]
        return min(ends)[3] if ends else None

    @staticmethod
    def _keep(states: dict[int, tuple[int, dict]], cost: int, node: dict) -> None:
        if cost < states.get(id(node), (1 << 30, node))[0]:
            states[id(node)] = (cost, node)

    def _accents(self, states: dict[int, tuple[int, dict]], budget: int) -> dict[int, tuple[int, dict]]:
        out = dict(states)
        for cost, node in states.values():
            for edge, child in node.items() if cost + ACCENT <= budget else ():
                if edge and unicodedata.combining(edge):
                    self._keep(out, cost + ACCENT, child)
        return out

    def _step(self, states: dict[int, tuple[int, dict]], plain: str, budget: int) -> dict[int, tuple[int, dict]]:
        """One character of the token's looks read from every state: along edges that look the same at no cost, along others or not at all
        at theirs."""
        ahead: dict[int, tuple[int, dict]] = {}
        if budget:
            states = self._accents(states, budget)
        for cost, node in states.values():
            for edge in (plain, *_BACK.get(plain, ())):
                if edge in node:
                    self._keep(ahead, cost, node[edge])
            if cost + ACCENT <= budget and unicodedata.combining(plain):
                self._keep(ahead, cost + ACCENT, node)
            for edge, child in node.items() if cost + min(CASE, OTHER) <= budget else ():
                price = CASE if edge and look(edge).lower() == plain.lower() else OTHER
                if edge and cost + price <= budget:
                    self._keep(ahead, cost + price, child)
        return ahead


_BACK: dict[str, list[str]] = {}
for _other, _latin in LOOK_ALIKES.items():
    _BACK.setdefault(_latin, []).append(_other)


def looks(token: str) -> str:
    """What a token's characters look like, in the order they are read; invisible ones are left out."""
    return "".join(map(look, unicodedata.normalize("NFD", token)))


def _match(group: pd.DataFrame) -> pd.DataFrame:
    tokens = group["token"].tolist()
    trie = Trie({t: int(n) for t, n in zip(tokens, group["n"]) if clean(t)})
    asked = [t for t in tokens if not t.isascii()]
    found = [trie.reach(t) for t in asked]
    return pd.DataFrame({"token": asked, "canonical": [x if x is not None else table_form(t) for x, t in zip(found, asked)]}, dtype=object)


def _routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen = [looks(t) for t in batch["token"]]
        yield pd.DataFrame({"token": batch["token"], "n": batch["n"], "route": [x[:ROUTE] for x in seen], "size": [len(x) for x in seen]})


def canonical_tokens(odd: DataFrame, plain: DataFrame, scratch: Scratch) -> DataFrame:
    """(token, canonical) of the tokens of ``odd``, which aren't plain ASCII, in the vocabulary of these and the ASCII tokens ``plain``; both
    have (token, n). Tokens that look alike begin alike and are as long, so they meet in the same trie."""
    routed = odd.mapInPandas(_routes, "token string, n long, route string, size int")
    routed = scratch.keep(routed, "odd")
    # ASCII tokens are what they look like; those that begin like none of the odd tokens of their length aren't asked for.
    asked = routed.select(F.col("route").alias("r_route"), F.col("size").alias("r_size")).distinct()
    plain = plain.select("token", "n", F.substring("token", 1, ROUTE).alias("route"), F.length("token").cast("int").alias("size"))
    plain = plain.join(asked, (F.col("route") == F.col("r_route")) & (F.col("size") == F.col("r_size")), "left_semi")
    together = scratch.keep(routed.unionByName(plain), "together")
    shards = max(1, together.count() // SHARD_TOKENS)
    shard = F.pmod(F.xxhash64("route", "size"), F.lit(shards))
    return together.withColumn("shard", shard).groupBy("shard").applyInPandas(_match, "token string, canonical string")


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([^\s\p{Z}\x85]+|[\s\p{Z}\x85]+)"), F.lit(1))


def _space(piece: Column) -> Column:
    """White space with each kind of space as a space and each kind of line end as a line feed; tabs stay."""
    piece = F.regexp_replace(piece, r"\r\n|[\r\x85\x{2028}\x{2029}]", "\n")
    return F.regexp_replace(piece, r"\p{Zs}", " ")


def _is_blank(piece: Column) -> Column:
    return piece.rlike(r"^[\s\p{Z}\x85]")


def canonical_texts(rows: DataFrame, keys: list[str], text: str, scratch: Scratch) -> DataFrame:
    """(keys..., text, canon) of rows whose text isn't plain ASCII; ``keys`` must name a row. A plain text is its own form.

    Only the distinct odd tokens of a text leave it: they are counted for the vocabulary, looked up, and put back into the text, whose plain
    tokens and white space stay where they are. Tokens that very many texts have are looked up in a broadcast of bounded size.
    """
    filled = rows.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("text"))
    odd = scratch.keep(filled.where(~F.col("text").rlike(PLAIN)), "odd")
    plain_token = F.regexp_extract_all(F.col("text"), F.lit(r"(?<![^\s\p{Z}\x85])([\x21-\x7e]*[A-Za-z][\x21-\x7e]*)(?![^\s\p{Z}\x85])"), F.lit(1))
    plain = filled.select(F.explode(plain_token).alias("token")).where(F.length("token") <= LONGEST).groupBy("token").agg(F.count("*").alias("n"))
    distinct = F.array_distinct(F.filter(_pieces(F.col("text")), lambda p: ~_is_blank(p) & ~p.rlike(PLAIN)))
    asked = scratch.keep(odd.select(*keys, F.explode(distinct).alias("token")), "asked")
    counts = scratch.keep(asked.groupBy("token").agg(F.count("*").alias("n")), "counts")
    spelled = scratch.keep(canonical_tokens(counts, plain, scratch), "spelled").where("token != canonical").withColumnRenamed("token", "s_token")
    limit = max(1, asked.count() // HEAVY_SHARE)
    heavy = counts.where(F.col("n") > limit).select(F.col("token").alias("h_token"))
    on = F.col("token") == F.col("s_token")
    often = F.broadcast(spelled.join(F.broadcast(heavy), F.col("s_token") == F.col("h_token"), "left_semi"))  # fewer than HEAVY_SHARE tokens
    rare = spelled.join(F.broadcast(heavy), F.col("s_token") == F.col("h_token"), "left_anti")
    rest = asked.join(F.broadcast(heavy), F.col("token") == F.col("h_token"), "left_anti")
    changed = asked.join(often, on).unionByName(rest.join(rare, on))
    found = changed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "canonical"))).alias("spelling"))

    def read(piece: Column) -> Column:
        return F.when(_is_blank(piece), _space(piece)).otherwise(F.coalesce(F.try_element_at("spelling", piece), piece))

    canon = F.array_join(F.transform(_pieces(F.col("text")), read), "")
    return odd.join(found, keys, "left").select(*keys, "text", canon.alias("canon"))


def _alike(rows: DataFrame, group: str, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((g, k, text, canon), (g, canon, other, least, copies)): the rows that look like a row of other characters, and the spellings of each
    form."""
    scratch = Scratch(rows.sparkSession, "looks")
    base = scratch.keep(rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(text).alias("text")).where("g is not null and k is not null and text is not null"), "rows")
    odd = scratch.keep(canonical_texts(base, ["g", "k"], "text", scratch), "odd")
    hashed = F.xxhash64("g", "canon")
    changed = odd.where("canon != text").select(hashed.alias("h")).distinct()
    plain = base.where(F.col("text").rlike(PLAIN)).select("g", "k", "text", F.col("text").alias("canon"))
    # Of two spellings at least one isn't canonical, so only forms that some changed text has can make a pair.
    alike = plain.unionByName(odd).withColumn("h", hashed).join(changed, "h", "left_semi").drop("h")
    alike = scratch.keep(alike, "alike")
    spellings = alike.groupBy("g", "canon", F.col("text").alias("other")).agg(F.min("k").alias("least"), F.count("*").alias("copies"))
    return alike, spellings


def same_looks(rows: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """(group, key_a, key_b), key_a < key_b: rows of one group whose texts look the same and aren't the same characters.

    Of exact copies one stands for all: each row is paired with the least key of every other spelling, so no spelling and no row is lost
    and copies aren't multiplied; ``classes`` gives the membership from which all pairs follow. Null texts look like nothing; an empty text
    looks like one of invisible characters only. Rows with null keys are left out; letter case, accents, raised digits, punctuation and
    line breaks tell texts apart.
    """
    alike, spellings = _alike(rows, group, key, text)
    pairs = alike.join(spellings, ["g", "canon"]).where("text != other")
    return pairs.select(F.col("g").alias(group), F.least("k", "least").alias("key_a"), F.greatest("k", "least").alias("key_b")).where("key_a < key_b").distinct()


def classes(rows: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """(group, key, class_key, spelling_key, copies, spellings): every row that looks like one of other characters, with the least key of all
    rows that look so, the least key of those with just its characters, how many these are, and the number of spellings of the class. The
    pairs are the rows of one class with different spellings."""
    alike, spellings = _alike(rows, group, key, text)
    whole = spellings.groupBy("g", "canon").agg(F.min("least").alias("class_key"), F.count("*").alias("spellings")).where("spellings > 1")
    each = spellings.join(whole, ["g", "canon"]).withColumnRenamed("other", "text")
    return alike.join(each, ["g", "canon", "text"]).select(F.col("g").alias(group), F.col("k").alias(key), "class_key", F.col("least").alias("spelling_key"), "copies", "spellings")
