"""Pages of repeated keywords, links or tags instead of sentences.

A page is read as a sequence of lines (long ones in parts that end with a sentence). A hidden Markov model labels each line as prose,
heading, table, link list, tag list or menu; a page is stuffed if the last three hold more than half of its words. The model is trained
here: lines of a bounded sample that a plain rule can name give the first counts, then a few rounds of expectation-maximisation over the
sample adjust emissions and transitions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of the training sample, and lines of each that are used for training.
SAMPLE_DOCS, SAMPLE_LINES = 2000, 200
#: Rounds of expectation-maximisation, and the weight of one seed line against the smoothing count of each value.
ROUNDS, SMOOTHING = 4, 0.5
#: Words of a line part without sentence ends.
PART = 40
#: Words count as the same within a page if so many first letters are; they are frequent if they occur so often.
STEM, OFTEN = 5, 4

STATES = ("prose", "heading", "table", "links", "tags", "menu")
STUFFING = np.array([False, False, False, True, True, True])

# The most frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """
    a an the and or of in on at to for from with by as is are was were be been has have had that this these those it its not no if when
    where which who will shall should may can could must would than then into during after before under over between within without each
    every all any both such other until unless only also there their they he she we you do does did but so because while our your his her
    der die das den dem des ein eine einer eines einem einen und oder im am auf aus bei mit nach von vor zu zum zur für ist sind war wird
    werden soll muss kann dass ob wenn nicht kein keine durch über unter ohne als wie auch nur bis während gemäß es er sie man sich aber
    le la les l un une d du de et ou en au aux à dans par pour sur avec sans est sont doit que qui ne pas n se ce cette il elle selon
    pendant après avant sous si quand chaque tous toutes mais nous vous leur leurs sa son ses
    el los las una unos unas del y o al con por para sin son debe su sus lo como cuando durante antes según bajo cada todos todas pero más
    """.split()
)
_LINK = re.compile(r"(?:https?://|www\.|href=|<a\b)\S*|\b[\w-]+(?:\.[\w-]+)+/\S*", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SEPARATOR = re.compile(r"[|,;/•*>#·»+]|\s[-–—]\s|\(\d+\)")
_END = re.compile(r"(?<=[.!?。！？])[\"'»”’)\]]*\s+")
_FULL_STOP = re.compile(r"[.!?:。！？][\"'»”’)\]]*\s*$")
_TABLE = re.compile(r"^\s*\|.*\|\s*$|(?:\s(?:\+\+|\+|o|-|--)){2,}\s*$|^[\s|:+-]+$")


def parts(text: str) -> list[str]:
    """The lines of a text, long ones cut after sentences, or after so many words where there is no sentence end."""
    out = []
    for line in text.splitlines():
        if not line.strip():
            continue
        for sentence in _END.split(line) if len(line) > 120 else (line,):
            words = sentence.split()
            if len(words) <= PART * 3 // 2:
                out.append(sentence)
            else:
                out.extend(" ".join(words[i : i + PART]) for i in range(0, len(words), PART))
    return out


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x 7 small integers, words of each line): shares of function words, links, repeats in the line and in the page, separators
    per word, whether it ends as a sentence does, and its length."""
    lines = parts(text)
    rows, sizes, words_of = [], [], []
    for line in lines:
        low = line.lower()
        bare, links = _LINK.subn(" ", low) if "/" in low or "<" in low or "www." in low or "href=" in low else (low, 0)
        words = _WORD.findall(bare)
        n = max(1, len(words) + links)
        content = [w for w in words if w not in FUNCTION_WORDS]
        stems = [w[:STEM] for w in content]
        words_of.append((stems, max(1, len(words))))
        function = (len(words) - len(content)) / n
        repeats = 1 - len(set(content)) / len(content) if content else 0.0
        separators = len(_SEPARATOR.findall(bare)) / n
        rows.append([
            (function > 0) + (function > 0.1) + (function > 0.2) + (function > 0.3),
            (links > 0) + (links / n > 0.2) + (links / n > 0.5),
            (repeats > 0.05) + (repeats > 0.2) + (repeats > 0.4),
            0,
            (separators > 0) + (separators > 0.1) + (separators > 0.3),
            2 if _TABLE.search(line) else int(bool(_FULL_STOP.search(line))),
            (n > 3) + (n > 8) + (n > 20),
        ])
        sizes.append(max(1, len(line.split())))
    seen = Counter(chain.from_iterable(stems for stems, _ in words_of))
    frequent = {w for w, n in seen.items() if n >= OFTEN}
    for row, (stems, n) in zip(rows, words_of):
        often = sum(w in frequent for w in stems) / n
        row[3] = int(often > 0.2) + int(often > 0.5) + int(often > 0.8)
    return np.array(rows, dtype=np.int8).reshape(-1, 7), np.array(sizes, dtype=np.int64)


VALUES = (5, 4, 4, 4, 4, 3, 4)


def seed_labels(x: np.ndarray) -> np.ndarray:
    """The state of lines that a plain rule can name, -1 for others."""
    function, link, repeat, often, separator, end, length = x.T
    out = np.full(len(x), -1)
    out[(length <= 1) & (separator == 0) & (link == 0) & (end == 0) & (often == 0)] = 1
    out[(function >= 3) & (length >= 1) & (link <= 1) & (repeat <= 1)] = 0
    out[(function <= 1) & (end == 1) & (separator <= 1) & (repeat == 0) & (link == 0) & (often == 0) & (length >= 1)] = 0
    out[(function <= 1) & (often >= 2) & (length <= 1) & (link == 0)] = 5
    out[(function <= 1) & (often >= 2) & (length >= 2) & ((separator >= 1) | (repeat >= 2))] = 4
    out[(function <= 1) & (link >= 2)] = 3
    out[end == 2] = 2
    return out


class LineModel:
    """Start, transition and emission log-probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]):
        self.start, self.move, self.emit = start, move, emit

    def lines(self, x: np.ndarray) -> np.ndarray:
        return sum(e[:, x[:, f]] for f, e in enumerate(self.emit)).T

    def aligned(self, pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, length, score): pages of at least one line, the longest first, with the scores of their lines, filled up with zeros."""
        length = np.array([len(x) for x in pages])
        order = np.argsort(-length, kind="stable")
        score = np.zeros((len(pages), int(length.max()), len(STATES)))
        flat = self.lines(np.concatenate([pages[i] for i in order]))
        at = 0
        for row, i in enumerate(order):
            score[row, : length[i]] = flat[at : at + length[i]]
            at += length[i]
        return order, length[order], score

    def viterbi(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The most likely states of the lines of each page; all pages step together, so a step is one operation on all of them."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(pages)
        filled = [i for i, x in enumerate(pages) if len(x)]
        for group in near_in_length(filled, pages):
            order, length, score = self.aligned([pages[i] for i in group])
            best = self.start + score[:, 0]
            back = np.zeros(score.shape, dtype=np.int8)
            for t in range(1, score.shape[1]):
                n = int((length > t).sum())  # the longest are first
                step = best[:n, :, None] + self.move
                back[:n, t] = step.argmax(1)
                best[:n] = step.max(1) + score[:n, t]
            state = best.argmax(1)
            states = np.zeros(score.shape[:2], dtype=np.int8)
            for t in range(score.shape[1] - 1, -1, -1):
                n = int((length > t).sum())
                states[:n, t] = state[:n]
                if t:
                    state[:n] = back[np.arange(n), t, state[:n]]
            for row, i in enumerate(order):
                out[group[i]] = states[row, : length[row]]
        return out

    def posterior(self, pages: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Expected states of each line of each page, and expected moves of all pages."""
        out: list[np.ndarray] = [np.zeros((0, len(STATES)))] * len(pages)
        moves, move = np.zeros_like(self.move), np.exp(self.move)
        for group in near_in_length(list(range(len(pages))), pages):
            order, length, score = self.aligned([pages[i] for i in group])
            p = np.exp(score - score.max(2, keepdims=True))
            fwd, back = np.zeros_like(p), np.ones_like(p)
            fwd[:, 0] = np.exp(self.start) * p[:, 0]
            fwd[:, 0] /= fwd[:, 0].sum(1, keepdims=True)
            for t in range(1, p.shape[1]):
                n = int((length > t).sum())
                fwd[:n, t] = (fwd[:n, t - 1] @ move) * p[:n, t]
                fwd[:n, t] /= fwd[:n, t].sum(1, keepdims=True)
            for t in range(p.shape[1] - 2, -1, -1):
                n = int((length > t + 1).sum())
                ahead = p[:n, t + 1] * back[:n, t + 1]
                pair = fwd[:n, t, :, None] * move * ahead[:, None, :]
                moves += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                back[:n, t] = ahead @ move.T
                back[:n, t] /= back[:n, t].sum(1, keepdims=True)
            states = fwd * back
            states /= np.maximum(states.sum(2, keepdims=True), 1e-300)
            for row, i in enumerate(order):
                out[group[i]] = states[row, : length[row]]
        return out, moves


def near_in_length(at: list[int], pages: list[np.ndarray], cells: int = 400_000) -> list[list[int]]:
    """Groups of pages of similar length, each of a bounded size when filled up; a longer page is a group by itself."""
    groups: list[list[int]] = []
    for i in sorted(at, key=lambda i: -len(pages[i])):
        if groups and (len(groups[-1]) + 1) * len(pages[groups[-1][0]]) <= cells and len(pages[i]) * 2 >= len(pages[groups[-1][0]]):
            groups[-1].append(i)
        else:
            groups.append([i])
    return groups


def train(pages: list[np.ndarray]) -> LineModel:
    """A model from the features of sample pages. Seeded lines keep their state in every round; a prior that needs no page gives every
    state its typical values, so that the model is defined on an empty sample and all states on a sample without stuffing."""
    k = len(STATES)
    typical = ((4, 0, 0, 0, 1, 1, 2), (1, 0, 0, 0, 0, 0, 0), (0, 0, 0, 1, 3, 2, 1), (0, 3, 0, 1, 1, 0, 1), (0, 0, 3, 3, 2, 0, 2), (0, 0, 0, 3, 3, 0, 1))
    prior = [np.full((k, v), SMOOTHING) for v in VALUES]
    for s, values in enumerate(typical):
        for f, v in enumerate(values):
            prior[f][s, v] += 4
    pages = [x for x in pages if len(x)]
    seeds = [seed_labels(x) for x in pages]
    weights = [np.where(s[:, None] >= 0, np.eye(k)[np.maximum(s, 0)], 0.0) for s in seeds]
    start, moves = np.full(k, 1.0), np.full((k, k), 1.0) + 6 * np.eye(k)
    for w in weights:
        moves += w[:-1].T @ w[1:]
        start += w[0]
    model = None
    for _ in range(ROUNDS + 1):
        emit = [p.copy() for p in prior]
        for x, w in zip(pages, weights):
            for f in range(len(VALUES)):
                np.add.at(emit[f].T, x[:, f], w)
        model = LineModel(np.log(start / start.sum()), np.log(moves / moves.sum(1, keepdims=True)), [np.log(e / e.sum(1, keepdims=True)) for e in emit])
        expected, pairs = model.posterior(pages)
        for states, s in zip(expected, seeds):
            states[s >= 0] = np.eye(k)[s[s >= 0]]
        weights, moves = expected, np.full((k, k), 1.0) + 6 * np.eye(k) + pairs
        start = np.full(k, 1.0) + sum((states[0] for states in expected), np.zeros(k))
    return model


def shares(texts: list[str | None], model: LineModel) -> list[tuple[int, list[int]]]:
    """(words, words of lines in each state) of each page."""
    read = [features(t or "") for t in texts]
    labelled = model.viterbi([x for x, _ in read])
    return [(int(sizes.sum()), np.bincount(states, sizes, len(STATES)).astype(int).tolist()) for (_, sizes), states in zip(read, labelled)]


def sample_features(docs: DataFrame, text: str) -> list[np.ndarray]:
    """The features of the training sample: the distinct texts that aren't blank with the smallest hashes, so neither the order of rows nor
    copies matter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [features("\n".join(t.splitlines()[:SAMPLE_LINES]))[0][:SAMPLE_LINES].tobytes() for t in batch["text"]]})

    filled = docs.select(F.col(text).alias("text")).where(F.col("text").rlike(r"\S")).select("text", F.xxhash64("text").alias("h"))
    smallest = [r["h"] for r in filled.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).collect()]
    if not smallest:
        return []
    picked = filled.where(F.col("h") <= smallest[-1]).groupBy("h").agg(F.min("text").alias("text"))
    return [np.frombuffer(bytes(r["x"]), dtype=np.int8).reshape(-1, 7) for r in picked.orderBy("h").select("text").mapInPandas(run, "x binary").collect()]


def line_shares(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words, one column per state with its words, stuffed): one row per row of ``docs``.

    ``stuffed`` says that more than half of the words are in lines of links, tags or menus. Null, empty and blank texts have no words and
    aren't stuffed. Repeated rows are rows of their own; other columns are ignored. Texts are read whole.
    """
    model = train(sample_features(docs, text))
    held = (model.start, model.move, model.emit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = LineModel(*held)
        for batch in batches:
            found = shares(batch["text"].tolist(), m)
            out = {"key": batch["key"], "words": [w for w, _ in found]}
            out |= {s: [by[i] for _, by in found] for i, s in enumerate(STATES)}
            yield pd.DataFrame(out | {"stuffed": [2 * sum(n for n, bad in zip(by, STUFFING) if bad) > w for w, by in found]})

    kind = docs.schema[key].dataType.simpleString()
    columns = ", ".join(f"`{s}` long" for s in STATES)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, words long, {columns}, stuffed boolean").withColumnRenamed("key", key)
