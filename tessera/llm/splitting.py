"""Cutting long texts into pieces at natural boundaries, with overlap.

Lexical cohesion: at each boundary between sentences the words of the sentences before it are compared with those after it; where they
differ most from what is around, in the deepest valley of that similarity, the topic changes. Within the window of places where a piece
may end the deepest valley is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.scratch import Scratch

#: Sentences on each side of a boundary that are compared.
BLOCK = 4
#: A piece ends in the last part of its window, so that it is at least so full unless no boundary is there.
LEAST_FULL = 0.5

_WORD = re.compile(r"\w+")
#: Ends of a paragraph, of a line, of a sentence, of a clause, and of a word, the strongest first.
_ENDS = (re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n\s*"), re.compile(r"[.!?…][\"'»”’)\]]*\s+"), re.compile(r"[,;:|]\s+"), re.compile(r"\s+"))
#: How much of the depth of a valley each kind of boundary adds.
_WEIGHT = (0.5, 0.25, 0.0)


def _boundaries(text: str) -> dict[int, int]:
    """Places after paragraphs, lines and sentences, with the kind of the boundary."""
    out: dict[int, int] = {}
    for kind in (2, 1, 0):
        for m in _ENDS[kind].finditer(text):
            if 0 < m.end() < len(text):
                out[m.end()] = kind
    return out


def valleys(text: str) -> dict[int, float]:
    """Every boundary of the text with the depth of the similarity there below the peaks on its two sides."""
    at = sorted(_boundaries(text).items())
    places = [p for p, _ in at]
    edges = [0, *places, len(text)]
    words = [[w for w in map(str.lower, _WORD.findall(text, a, b)) if len(w) > 2] for a, b in zip(edges, edges[1:])]
    before: dict[str, int] = {}
    after: dict[str, int] = {}
    dot = square_b = square_a = 0  # of the two blocks, kept up as words move
    similar = []
    for w in (w for part in words[:BLOCK] for w in part):
        n = after.get(w, 0)
        square_a += 2 * n + 1
        after[w] = n + 1
    for i in range(len(places)):
        for w in words[i]:
            n, m = before.get(w, 0), after[w]
            dot += m - n - 1  # (n + 1) * (m - 1) - n * m
            square_b += 2 * n + 1
            square_a -= 2 * m - 1
            before[w], after[w] = n + 1, m - 1
        for w in words[i + BLOCK] if i + BLOCK < len(words) else ():
            m = after.get(w, 0)
            dot += before.get(w, 0)
            square_a += 2 * m + 1
            after[w] = m + 1
        for w in words[i - BLOCK] if i >= BLOCK else ():
            n = before[w]
            dot -= after.get(w, 0)
            square_b -= 2 * n - 1
            before[w] = n - 1
        similar.append(dot / sqrt(square_b * square_a) if square_b and square_a else 0.0)
    left, right = list(similar), list(similar)
    for i in range(1, len(similar)):  # the peak that a climb to each side reaches
        if similar[i - 1] >= similar[i]:
            left[i] = left[i - 1]
    for i in range(len(similar) - 2, -1, -1):
        if similar[i + 1] >= similar[i]:
            right[i] = right[i + 1]
    return {p: left[i] + right[i] - 2 * similar[i] + _WEIGHT[kind] for i, (p, kind) in enumerate(at)}


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text in code points; each at most ``limit`` long.

    A piece ends at the deepest valley of its window, else after a clause, else after a word, else where the limit is. Each piece but the
    first starts up to ``overlap`` before the end of the one before, at the start of a word. White space counts to the piece before it. A
    text within the limit is one piece.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    depth = valleys(text)
    places = sorted(depth)
    pieces, start, new = [], 0, 0  # new: where the text not yet in a piece starts
    i = 0
    while len(text) - start > limit:
        last = start + limit
        least = max(new + 1, start + int(limit * LEAST_FULL))
        while i < len(places) and places[i] <= new:
            i += 1
        window = []
        for p in places[i:]:
            if p > last:
                break
            if p >= least:
                window.append(p)
        if window:
            end = max(window, key=lambda p: (depth[p], p))
        else:
            end = next((m[-1] for m in ([x.end() for x in rx.finditer(text, least, last) if x.end() <= last] for rx in _ENDS[3:]) if m), last)
        pieces.append((start, end))
        new = end
        start = max(end - overlap, pieces[-1][0] + 1)
        if start and not text[start - 1].isspace():  # to the start of a word, so the overlap is shorter
            m = _ENDS[4].search(text, start, end)
            start = m.end() if m else start
        if start >= end and overlap:
            start = max(end - overlap, pieces[-1][0] + 1)
    pieces.append((start, len(text)))
    return pieces


def too_long(text: Column, limit: int) -> Column:
    return F.length(text) > limit


def count_on(sizes: DataFrame, group: list[str], scratch: Scratch) -> DataFrame:
    """(key, first): the number of the first piece of each row (key, group..., seq, pieces), so that numbers within a group count on.

    A row keeps its own number, moved up by the pieces that rows before it add; of rows with the same number the one with the later key
    goes behind the other. With P the pieces before row i of its group, that is P + the largest (seq - place) up to i, so sums and maxima
    over ranges of rows suffice and no group is in one task.
    """
    order = [F.col("seq"), F.col("key")]
    ranged = sizes.select("key", *group, F.coalesce("seq", F.lit(1)).alias("seq"), "pieces")
    ranged = scratch.keep(ranged.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy(*group, "part").orderBy(*order)
    up_to = within.rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({"at": F.row_number().over(within) - 1, "before": F.sum("pieces").over(up_to) - F.col("pieces")})
    local = scratch.keep(local.withColumn("lead", F.max(F.col("seq") - F.col("at")).over(up_to)), "local")
    parts = local.groupBy(*group, "part").agg(F.count("*").alias("rows"), F.sum("pieces").alias("made"), F.max("lead").alias("most"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = parts.withColumns({"rows_before": F.coalesce(F.sum("rows").over(earlier), F.lit(0)), "made_before": F.coalesce(F.sum("made").over(earlier), F.lit(0))})
    parts = parts.withColumn("most", F.col("most") - F.col("rows_before")).withColumn("most_before", F.max("most").over(earlier))
    parts = parts.select(*[F.col(g).alias(f"p_{g}") for g in group], F.col("part").alias("p_part"), "rows_before", "made_before", "most_before")
    on = F.col("part") == F.col("p_part")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"p_{g}"))
    lead = F.greatest(F.col("lead") - F.col("rows_before"), "most_before")  # greatest passes over nulls
    return local.join(parts, on).select("key", (F.col("before") + F.col("made_before") + lead).alias("first"))


def split_rows(rows: DataFrame, key: str, text: str, seq: str, keep: list[str], limit: int = 4000, overlap: int = 200, only_cut: bool = False) -> DataFrame:
    """Rows with their text in pieces: (key, keep..., seq, text, piece, pieces, start).

    A row within the limit stays as it is, with piece 1 of 1; a null text stays null and an empty one empty. The pieces of a longer one
    count on from its own ``seq`` (1 where that is null), and the rows behind it in its group, which have the same values of ``keep``, move
    up by as many (see ``count_on``); groups in which nothing is cut keep their numbers, nulls included, and without ``keep`` each row is a
    group. ``piece`` counts from 1; ``start``
    is the place of the piece in the text. ``limit``, ``overlap`` and ``start`` count code points. With ``only_cut`` rows within the limit
    are left out and pieces count from their own ``seq``. Keys must name a row. Only long texts go to Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    base = rows.select(F.col(key).alias("key"), *[F.col(k).alias(f"k_{i}") for i, k in enumerate(keep)], F.col(seq).cast("long").alias("seq"), F.col(text).alias("text"))
    names = [f"k_{i}" for i in range(len(keep))]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select("key", *names).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                whole = row[-1]
                spans = cut(whole, limit, overlap)
                first = 1 if pd.isna(row[-2]) else int(row[-2])
                out.extend((*row[:-2], first, whole[a:b], i + 1, len(spans), a) for i, (a, b) in enumerate(spans))
            yield pd.DataFrame(out, columns=["key", *names, "seq", "text", "piece", "pieces", "start"])

    pieces = base.where(too_long(F.col("text"), limit)).mapInPandas(run, f"{head}, seq long, text string, piece int, pieces int, start long")
    back = {"key": key, "seq": seq, "text": text} | dict(zip(names, keep))
    if only_cut:
        return pieces.withColumn("seq", F.col("seq") + F.col("piece") - 1).withColumnsRenamed(back)
    scratch = Scratch(rows.sparkSession, "pieces")
    pieces = scratch.keep(pieces, "pieces")
    short = base.where(~F.coalesce(too_long(F.col("text"), limit), F.lit(False)))
    first = pieces.where("piece = 1").select("key", F.col("seq").alias("first"))
    if names:
        changed = pieces.where("piece = 1").select("key", *names, "seq", "pieces")
        beside = F.lit(True)
        for n in names:
            beside = beside & F.col(n).eqNullSafe(F.col(f"t_{n}"))
        siblings = short.select("key", *names, "seq").join(changed.select(*[F.col(n).alias(f"t_{n}") for n in names]).distinct(), beside, "left_semi")
        first = scratch.keep(count_on(changed.unionByName(siblings.withColumn("pieces", F.lit(1))), names, scratch), "first")
    first = first.withColumnRenamed("key", "f_key")
    moved = pieces.join(first, F.col("key") == F.col("f_key")).select("key", *names, (F.col("first") + F.col("piece") - 1).alias("seq"), "text", "piece", "pieces", "start")
    kept = short.join(first, F.col("key") == F.col("f_key"), "left").select("key", *names, F.coalesce("first", "seq").alias("seq"), "text", F.lit(1).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).cast("long").alias("start"))
    return kept.unionByName(moved).withColumnsRenamed(back)


def joined_again(pieces: DataFrame, key: str, text: str, seq: str, keep: list[str], limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(key, digest, fits, overlaps, counted) of the rows that were cut: the MD5 of the pieces put together without what they repeat, and
    whether all are within the limit, repeat no more than the overlap, and have numbers that follow each other and that no other row of
    their group has."""
    cut_rows = pieces.where("pieces > 1")
    parts = cut_rows.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct("piece", "start", F.col(text).alias("text"), F.col(seq).alias("seq")))).alias("ps"))
    ends = F.transform("ps", lambda p: p["start"] + F.length(p["text"]))
    before = F.concat(F.array(F.lit(0).cast("long")), ends)
    fresh = F.transform("ps", lambda p, i: F.substring(p["text"], F.element_at(before, i + 1) - p["start"] + 1, F.lit(limit)))
    repeats = F.transform("ps", lambda p, i: F.element_at(before, i + 1) - p["start"])
    follow = F.forall(F.transform("ps", lambda p, i: p["seq"] - i), lambda x: x == F.element_at("ps", 1)["seq"])
    shared = pieces.groupBy(*keep, seq).agg(F.count("*").alias("n")).where("n > 1")
    on = F.lit(True)
    shared = shared.select(*[F.col(k).alias(f"s_{i}") for i, k in enumerate([*keep, seq])])
    for i, k in enumerate([*keep, seq]):
        on = on & F.col(k).eqNullSafe(F.col(f"s_{i}"))
    clash = cut_rows.join(shared, on, "left_semi").select(F.col(key).alias("c_key")).distinct()
    out = parts.join(clash, F.col("key") == F.col("c_key"), "left")
    return out.select(
        F.col("key").alias(key),
        F.md5(F.array_join(fresh, "")).alias("digest"),
        F.forall("ps", lambda p: F.length(p["text"]) <= limit).alias("fits"),
        F.forall(repeats, lambda n: (n >= 0) & (n <= overlap)).alias("overlaps"),
        (follow & F.col("c_key").isNull()).alias("counted"),
    )
