"""Byte-level BPE as a monoid: halves are encoded, and joined by re-encoding a window at the seam.

A sequence of tokens is the encoding of its bytes exactly if each pair of neighbours is the encoding of its
own bytes. So when a re-encoded window begins with the token it began with, and ends with the token it
ended with, the tokens outside can't change; until then the window is doubled. The leaves of all trees of
a piece of a batch are encoded at once, as arrays. Decoding joins the bytes of neighbouring leaves up a tree.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import common as C

#: Bytes of text that are encoded at once.
PIECE = 1 << 20
#: Bytes encoded without a split, ids decoded without one, and matches, and bytes of them, that a worker remembers.
LEAF_BYTES, LEAF_IDS, REMEMBERED, REMEMBERED_BYTES = 24, 1 << 16, 1 << 18, 16 << 20


class Numbers(dict):
    """Numbers matches in the order in which they are first met; the new ones wait in a list."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, match: str) -> int:
        n = self[match] = len(self)
        self.new.append(match)
        return n


class Vocabulary:
    """The bytes and the decimal forms of the ids."""

    def __init__(self, file: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line)}
        self.none = max(self.ranks.values(), default=0) + 1
        self.by_id = [b""] * self.none
        for token, i in self.ranks.items():
            self.by_id[i] = token
        self.tokens = pa.array(self.by_id, pa.binary())
        self.decimals = pa.array([b"%d," % i for i in range(self.none)], pa.binary())

    def decode(self, ids: np.ndarray) -> bytes:
        """Concatenation up the tree: bytes of the leaves first, then neighbours joined two by two."""
        level = [_joined(self.tokens, ids[i : i + LEAF_IDS]) for i in range(0, len(ids), LEAF_IDS)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""

    def written(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return _joined(self.decimals, ids)[:-1]


class Bpe(Vocabulary):
    def __init__(self, file: bytes, pattern: str) -> None:
        super().__init__(file)
        self.find = regex.compile(pattern).findall
        self.single = np.array([self.ranks.get(bytes([a]), 0) for a in range(256)])
        # (left, right) of every two tokens that make a token, as one number, sorted
        pairs = {}
        for token, i in self.ranks.items():
            for at in range(1, len(token)):
                left, right = self.ranks.get(token[:at]), self.ranks.get(token[at:])
                if left is not None and right is not None:
                    pairs[left * self.none + right] = i
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pairs.tolist()] + [self.none], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known, self.bytes = Numbers(), 0
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that neighbours make; none where they make none or one is missing (-1)."""
        key = left * self.none + right
        at = np.searchsorted(self.pairs, key)
        good = (left >= 0) & (right >= 0) & (self.pairs[np.minimum(at, len(self.pairs) - 1)] == key) if len(self.pairs) else np.zeros(key.shape, bool)
        return self.pair_rank[np.where(good, at, len(self.pairs))]

    def merge(self, leaves: list[bytes]) -> list[list[int]]:
        """For each leaf, neighbours of the lowest rank are merged, leftmost first, until none can be."""
        out: list = [None] * len(leaves)
        order = sorted(range(len(leaves)), key=lambda i: len(leaves[i]))
        for lo in range(0, len(order), 1 << 14):
            who = np.array(order[lo : lo + (1 << 14)])
            size = np.array([len(leaves[i]) for i in who])
            token = np.full((len(who), int(size.max()) + 1), -1, np.int64)
            token[np.arange(token.shape[1]) < size[:, None]] = self.single[np.frombuffer(b"".join(leaves[i] for i in who), np.uint8)]
            rank = self.rank(token[:, :-1], token[:, 1:])
            cols = np.arange(rank.shape[1])
            while len(who):
                best = rank.argmin(1)
                row = np.arange(len(who))
                low = rank[row, best]
                done = low == self.none
                for i, t in zip(who[done].tolist(), token[done].tolist(), strict=True):
                    out[i] = t[: t.index(-1)]
                who, token, rank, best, low = who[~done], token[~done], rank[~done], best[~done], low[~done]
                row = np.arange(len(who))
                token[row, best] = low
                token[:, 1:-1] = np.where(cols[1:] > best[:, None], token[:, 2:], token[:, 1:-1])
                rank[:, :-1] = np.where(cols[:-1] >= best[:, None], rank[:, 1:], rank[:, :-1])
                rank[row, best] = self.rank(low, token[row, best + 1])
                left = np.maximum(best - 1, 0)
                rank[row, left] = np.where(best > 0, self.rank(token[row, left], low), rank[row, left])
        return out

    def split(self, piece: bytes) -> list[bytes]:
        if len(piece) <= LEAF_BYTES:
            return [piece]
        half = len(piece) // 2
        return self.split(piece[:half]) + self.split(piece[half:])

    def join(self, left: list[int], right: list[int]) -> list[int]:
        k = 2
        while True:
            a, b = left[-k:], right[:k]
            [window] = self.merge([b"".join(map(self.by_id.__getitem__, chain(a, b)))])
            if (k >= len(left) or window[0] == a[0]) and (k >= len(right) or window[-1] == b[-1]):
                return left[:-k] + window + right[k:]
            k *= 2

    def tree(self, level: list[list[int]]) -> list[int]:
        """Neighbours joined two by two until one sequence is left."""
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def learn(self, matches: list[str]) -> None:
        """Encode new matches and keep their ids."""
        pieces = [m.encode("utf-8", "surrogatepass") for m in matches]
        whole = [self.ranks.get(p) for p in pieces]
        leaves = [self.split(p) if w is None else [] for p, w in zip(pieces, whole, strict=True)]
        merged = iter(self.merge(list(chain.from_iterable(leaves))))
        ids = [[w] if w is not None else self.tree([next(merged) for _ in own]) for w, own in zip(whole, leaves, strict=True)]
        self.bytes += sum(map(len, pieces))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in ids])])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end."""
        if len(self.known) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.forget()
        # a text's matches are numbers before the next text is looked at
        found = [np.fromiter(map(self.known.__getitem__, self.find(t)), np.int32) if t else np.zeros(0, np.int32) for t in texts]
        number = np.concatenate([np.zeros(0, np.int32), *found])
        if self.known.new:
            self.learn(self.known.new)
            self.known.new = []
        size = self.ends[number + 1] - self.ends[number]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.ends[number] - ends[:-1], size)]
        return ids, ends[np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)]


def _joined(values: pa.Array, ids: np.ndarray) -> bytes:
    """Arrow lays the values taken one after the other."""
    taken = values.take(pa.array(ids))
    return taken.buffers()[2].to_pybytes() if len(ids) else b""


_HELD: dict[tuple, Vocabulary] = {}


def _held(kind: type, file: bytes, *pattern: str) -> Vocabulary:
    key = (kind, hash(file), len(file), *pattern)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = kind(file, *pattern)
    return _HELD[key]


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file is bounded; it is read here and sent to the executors once."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _with(df: DataFrame, *added: tuple[str, T.DataType]) -> tuple[T.StructType, list[str]]:
    """The schema of df with columns added, or replaced, and the names of those that stay."""
    stay = [f for f in df.schema.fields if f.name not in {n for n, _ in added}]
    return T.StructType(stay + [T.StructField(n, t) for n, t in added]), [f.name for f in stay]


def _encoded(bpe: Bpe, column: pa.Array):
    """(first row, row after the last, ids, ends) of each piece of a column of texts."""
    _, offs = C.text_bytes(column)
    for lo, hi in C.pieces(offs, PIECE):
        yield lo, hi, *bpe.encode(column.slice(lo, hi - lo).to_pylist())


def _listed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def _digests(bpe: Bpe, ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """Of each text the digest of its ids, and that of the bytes that they decode to."""
    own = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [pa.array([hashlib.sha256(f(x)).hexdigest() for x in own], pa.string()) for f in (bpe.written, bpe.decode)]


def bpe_encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """df with the token ids of each text (array<int>); every match of the pattern is encoded on its own.

    Null and empty texts have no ids. Repeated rows give repeated rows, an empty table an empty one. A column
    named like out is replaced.
    """
    held = _vocabulary(df, path)
    schema, names = _with(df, (out, T.ArrayType(T.IntegerType(), False)))

    def run(batch):
        for lo, hi, ids, ends in _encoded(_held(Bpe, held.value, pattern), batch.column(text_col)):
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [_listed(ids, ends)], names=schema.names)

    return C.map_batches(df, run, schema)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that each row's ids stand for; null ids give null, no ids give no bytes. A column named like out is replaced."""
    held = _vocabulary(df, path)
    schema, names = _with(df, (out, T.BinaryType()))

    def run(batch):
        bpe = _held(Vocabulary, held.value)
        for lo in range(0, len(batch), 512):
            part = batch.slice(lo, 512)
            texts = [bpe.decode(ids.values.to_numpy()) if ids.is_valid else None for ids in part.column(ids_col)]
            yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(texts, pa.binary())], names=[*names, out])

    return C.map_batches(df, run, schema)


def bpe_round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """df with token_ids, and ids_sha256 and decoded_sha256, digests of the ids and of the bytes that they decode to.

    Encoding and decoding are one pass over the texts. Null and empty texts have no ids. Repeated rows give repeated
    rows, an empty table an empty one. Columns of these names are replaced.
    """
    held = _vocabulary(df, path)
    schema, names = _with(df, ("token_ids", T.ArrayType(T.IntegerType(), False)), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))

    def run(batch):
        bpe = _held(Bpe, held.value, pattern)
        for lo, hi, ids, ends in _encoded(bpe, batch.column(text_col)):
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [_listed(ids, ends), *_digests(bpe, ids, ends)], names=schema.names)

    return C.map_batches(df, run, schema)


def bpe_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_tokens, and digests of its ids and of the bytes they decode to, in one pass over the texts.

    Null and empty texts have no tokens. Repeated rows give repeated rows, an empty table an empty one.
    """
    held = _vocabulary(df, path)
    rows = df.select(id_col, text_col)
    schema, _ = _with(rows.select(id_col), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))

    def run(batch):
        bpe = _held(Bpe, held.value, pattern)
        for lo, hi, ids, ends in _encoded(bpe, batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ends)), *_digests(bpe, ids, ends)], names=schema.names)

    return C.map_batches(rows, run, schema)
