"""Byte-level BPE by backtracking over longest matches.

The vocabulary is a pyahocorasick automaton over bytes mapped to Latin-1.
From each position the longest token is tried first, then its shorter prefixes.
A token may follow another only if merging by ranks would not have chosen
otherwise across their border; that compatibility is memoised. Positions from
which no compatible sequence goes on are marked and never tried again, so the
time is linear in the text. The result is the one that merging by ranks gives.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Memo, pieces


class BytePairEncoder:
    """Encodes text with the ranks of a tiktoken file and a split pattern."""

    def __init__(self, path: str, pattern: str, pairs: int = 300_000):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.halves = {i: self._halves(t, i) for t, i in ranks.items()}
        self.joined = {h: i for i, h in self.halves.items() if h[0] != h[1] or len(self.tokens[i]) > 1}
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[int, bool] = {}
        self.pairs = pairs
        self.memo = Memo(self._piece)

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; itself twice for a byte."""
        ranks, parts = self.ranks, [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            options = [
                (r, k)
                for k in range(len(parts) - 1)
                if (r := ranks.get(parts[k] + parts[k + 1])) is not None and r < rank
            ]
            if not options:
                raise ValueError(f"token {rank} is not made by merges")
            _, k = min(options)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (rank, rank) if len(parts) == 1 else (ranks[parts[0]], ranks[parts[1]])

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between two adjacent tokens.

        The merges that made both tokens are undone, the later one first. The
        border falls if the two parts that touch it would have merged before
        the merge undone last.
        """
        halves, joined = self.halves, self.joined
        bound = 1 << 62
        while True:
            merge = joined.get((left, right))
            if merge is not None and merge < bound:
                return False
            # at equal ranks the left one was merged first, so the right is undone first
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left" and halves[left][1] != left:
                    bound, left = left, halves[left][1]
                    break
                if side == "right" and halves[right][0] != right:
                    bound, right = right + 1, halves[right][0]
                    break
            else:
                return True

    def _fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= self.pairs:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _prefix(self, token: int) -> int | None:
        """The longest token that is a shorter prefix of this one."""
        if token not in self.shorter:
            text = self.tokens[token]
            self.shorter[token] = next(
                (i for n in range(len(text) - 1, 0, -1) if (i := self.ranks.get(text[:n])) is not None), None
            )
        return self.shorter[token]

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        tokens = self.tokens
        longest: list[int | None] = [None] * len(data)
        for end, i in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - len(tokens[i])] = i  # later matches from one start are longer
        open_ends = bytearray(b"\1") * (len(data) + 1)
        out: list[int] = []
        at, option = 0, longest[0]
        while at < len(data):
            while option is not None:
                end = at + len(tokens[option])
                if open_ends[end] and (not out or self._fits(out[-1], option)):
                    break
                option = self._prefix(option)
            if option is not None:
                out.append(option)
                at = end
                option = longest[at] if at < len(data) else None
            else:
                if not out:
                    raise ValueError("the vocabulary doesn't cover these bytes")
                open_ends[at] = 0
                option = out.pop()
                at -= len(tokens[option])
        return out

    def _piece(self, piece: str) -> bytes:
        ids: list[int] = []
        for match in self.find(piece):
            ids += self.encode_bytes(match.encode("utf-8", "surrogatepass"))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One encoder for each worker process, vocabulary and pattern."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = BytePairEncoder(path, pattern)
    return _encoders[path, pattern]


def bpe_encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """docs with token_ids (binary: little-endian uint32), decoded (binary).

    ranks: path of a tiktoken rank file on every machine. A null text is an
    empty one. Columns of these names are replaced; others stay. Nothing is
    shuffled; repeated rows give a row each and an empty table none.
    """
    columns = [c for c in docs.columns if c not in ("token_ids", "decoded")]

    @F.pandas_udf("token_ids binary, decoded binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(ranks, pattern)
        for texts in parts:
            ids = [own.encode(t or "") for t in texts]
            yield pd.DataFrame({"token_ids": ids, "decoded": [own.decode(x) for x in ids]})

    coded = docs.withColumn("__coded", run(F.col("text").cast("string")))
    return coded.select(*columns, "__coded.token_ids", "__coded.decoded")


def bpe_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs."""
    coded = bpe_encode(docs.select("doc_id", "text"), ranks, pattern)
    return coded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


