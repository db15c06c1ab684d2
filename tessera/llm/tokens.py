"""Byte-pair encoding by prefixes: the ids of a text, exact appends, and re-encoding near an edit.

Of every prefix of a piece the last token of its encoding is unique and doesn't depend on how the encoding of the shorter prefix was
found; so one token per byte is all the state there is. A token may follow another just when encoding the two together gives these two
again, which is checked against the merge order. Appending bytes extends the table; an edit leaves the table before it as it is.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces kept encoded per worker; when so many are known the memory starts afresh. It only saves time.
KEPT_PIECES = 400_000


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    """The ranks of a public tokenizer: in $TESSERA_TOKENIZERS or the installed package of vocabularies."""
    folder = os.environ.get("TESSERA_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return f"{folder}/{name}.tiktoken"


def pre_token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PrefixEncoder:
    """Encoder of one vocabulary of byte tokens with merge ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pieces = regex.compile(pattern)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._known: dict[str, list[int]] = {}
        self._ends: dict[int, list[bytes]] = {}
        for token in self.ranks:
            self._ends.setdefault(token[-1], []).append(token)

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a single byte."""
        if token not in self._parts:
            word = [self.bytes_of[token][i : i + 1] for i in range(len(self.bytes_of[token]))]
            while len(word) > 2:  # by the merge order, until the last merge
                best = min(range(len(word) - 1), key=lambda i: self.ranks.get(word[i] + word[i + 1], 1 << 60))
                word[best : best + 2] = [word[best] + word[best + 1]]
            self._parts[token] = (self.ranks[word[0]], self.ranks[word[1]]) if len(word) == 2 else None
        return self._parts[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens stay two when their bytes are encoded together.

        The merge that would break them joins the end of ``left`` to the start of ``right`` before one of the two was complete. So the
        two are taken apart from the later merge back, and at each stage the bytes across the border must not have a merge that was due.
        """
        key = (left, right)
        held = self._pairs.get(key)
        if held is None:
            held, bound, a, b = True, 1 << 60, left, right
            while True:
                across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
                if across is not None and across < bound:
                    held = False
                    break
                if a > b:  # undo the later merge
                    bound, split = a, self.parts(a)
                    if split is None:
                        bound, split_b = b, self.parts(b)
                        if split_b is None:
                            break
                        b = split_b[0]
                        # a border merge at the same rank as an inner merge of the right token comes first, being further left
                        bound += 1
                    else:
                        a = split[1]
                else:
                    bound, split = b, self.parts(b)
                    if split is None:
                        bound, split_a = a, self.parts(a)
                        if split_a is None:
                            break
                        a = split_a[1]
                    else:
                        b = split[0]
                        bound += 1
            self._pairs[key] = held
        return held

    def extend(self, data: bytes, last: list[int], start: int) -> list[int]:
        """The last token of each prefix of ``data`` longer than ``start``, appended to those up to there."""
        ranks, bytes_of = self.ranks, self.bytes_of
        for end in range(start + 1, len(data) + 1):
            for size in range(min(self.longest, end), 0, -1):
                token = ranks.get(data[end - size : end])
                if token is not None:
                    before = end - size
                    # the token of the bytes alone must be itself, which holds for every token of a merge vocabulary
                    if before == 0 or self.may_follow(last[before - 1], token):
                        last.append(token)
                        break
        return last

    def walk_back(self, last: list[int]) -> list[int]:
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= len(self.bytes_of[ids[-1]])
        return ids[::-1]

    def piece_ids(self, piece: str) -> list[int]:
        ids = self._known.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "replace")
            whole = self.ranks.get(data)
            ids = [whole] if whole is not None else self.walk_back(self.extend(data, [], 0))
            if len(self._known) >= KEPT_PIECES:
                self._known.clear()
            self._known[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens; none for a null or empty text."""
        if not text:
            return []
        known, out = self._known, []
        for piece in self.pieces.findall(text):
            ids = known.get(piece)
            out.extend(ids if ids is not None else self.piece_ids(piece))
        return out

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """A piece's bytes and table with ``more`` added; only the new bytes are looked at."""
        return data + more, self.extend(data + more, list(last), len(data))

    def edit(self, data: bytes, last: list[int], at: int, removed: int, added: bytes) -> tuple[bytes, list[int], int]:
        """A piece with ``removed`` bytes at ``at`` replaced, its table, and the bytes looked at.

        The table before the edit stays. Behind it, once the last tokens of so many prefixes as the longest token has bytes are the same
        as before, all later ones are, as they depend on nothing else.
        """
        new = data[:at] + added + data[at + removed :]
        table, shift, same = last[:at], len(added) - removed, 0
        for end in range(at + 1, len(new) + 1):
            self.extend(new[:end], table, end - 1)
            old = end - shift
            same = same + 1 if end > at + len(added) and 0 < old <= len(last) and last[old - 1] == table[-1] else 0
            if same >= self.longest:
                return new, table + last[old:], end - at
        return new, table, len(new) - at


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> PrefixEncoder:
    """One encoder per worker."""
    return PrefixEncoder(path, pattern)


def encode_column(docs: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each row's text; an empty list for null and empty texts. Rows and copies stay as they are."""
    path, pattern = path or vocabulary_path(), pre_token_pattern()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path, pattern)
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "ids": [e.encode(t) for t in batch["text"]]})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_column(docs: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_tokens): the size of each row's text in tokens, 0 for null and empty texts."""
    path, pattern = path or vocabulary_path(), pre_token_pattern()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path, pattern)
        for batch in batches:
            sizes = [sum(len(e.piece_ids(p)) for p in e.pieces.findall(t)) if t else 0 for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "n_tokens": sizes})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, n_tokens int").withColumnRenamed("key", key)
