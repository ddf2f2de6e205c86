"""Many phrases found in many texts at once, by an automaton instead of a loop over pairs.

A trie of the phrases' bytes with failure links is built level by level, and runs over all texts of a batch side by
side: texts are cut into strips, and each step moves the state of every strip by one byte. Phrases over
PART_BYTES are dealt over several automata by a hash; each is broadcast in turn, and texts are never shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of phrases of one automaton; bytes of a strip, and of the texts that are looked at together.
PART_BYTES, STRIP, PIECE = 16 << 20, 256, 8 << 20


class Automaton:
    """Phrases (not empty) as a trie: transitions sorted by state and byte, failure links, and the phrase that ends at a state."""

    def __init__(self, phrases: list[bytes]) -> None:
        size = np.array([len(p) for p in phrases], np.int64)
        data, starts = np.frombuffer(b"".join(phrases), np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        self.longest, self.count = int(size.max(initial=0)), len(phrases)
        state, states = np.zeros(len(phrases), np.int64), 1
        levels, self.phrase = [], [np.full(1, -1)]
        for depth in range(self.longest):
            live = np.flatnonzero(size > depth)
            key, which = np.unique(state[live] << 8 | data[starts[live] + depth], return_inverse=True)
            state[live] = states + which
            ends = np.full(len(key), -1)
            done = live[size[live] == depth + 1]
            ends[state[done] - states] = done
            levels.append((key, np.arange(states, states + len(key))))
            self.phrase.append(ends)
            states += len(key)
        self.phrase = np.concatenate(self.phrase)
        key, to = (np.concatenate([level[k] for level in levels]) if levels else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(key)
        self.key, self.to = key[order], to[order]
        # by levels: a state fails to where its parent's failure goes on with the same byte
        self.fail, self.shorter = np.zeros(states, np.int64), np.full(states, -1)
        self.root = np.zeros(256, np.int64)
        if levels:
            self.root[levels[0][0]] = levels[0][1]
        for depth, (level, own) in enumerate(levels):
            if depth:
                self.fail[own] = self._step(self.fail[level >> 8], level & 255)
            back = self.fail[own]
            self.shorter[own] = np.where(self.phrase[back] >= 0, back, self.shorter[back])
        self.tells = (self.phrase >= 0) | (self.shorter >= 0)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte each."""
        out, at, now = self.root[byte], np.flatnonzero(state), state[state > 0]
        while len(at):
            key = now << 8 | byte[at]
            place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            found = self.key[place] == key
            out[at[found]] = self.to[place[found]]
            now, at = self.fail[now[~found]], at[~found]
            at, now = at[now > 0], now[now > 0]
        return out

    def find(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, phrase) that occur in the rows offs of the bytes buf."""
        size, found = np.diff(offs), [np.zeros(0, np.int64)]
        if not self.longest or not len(size):
            return found[0], found[0]
        # a strip begins longest - 1 bytes before its own part, so that no phrase is cut; the longest come first
        parts = np.maximum(1, -(-size // STRIP))
        row = np.repeat(np.arange(len(size)), parts)
        first = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * STRIP
        lo, hi = offs[row] + np.maximum(first - self.longest + 1, 0), np.minimum(offs[row] + first + STRIP, offs[row + 1])
        order = np.argsort(lo - hi, kind="stable")
        row, lo, length = row[order], lo[order], (hi - lo)[order]
        state = np.zeros(len(row), np.int64)
        for step in range(int(length[0])):
            n = int(np.searchsorted(-length, -step, "left"))
            state = self._step(state[:n], buf[lo[:n] + step].astype(np.int64))
            told = np.flatnonzero(self.tells[state])
            if len(told):
                found.append(row[told] * len(self.phrase) + state[told])
            if step % 64 == 63:
                found = [np.unique(np.concatenate(found))]
        rows, states = np.divmod(np.unique(np.concatenate(found)), len(self.phrase))
        hits = [np.zeros(0, np.int64)]
        while len(rows):
            own = self.phrase[states] >= 0
            hits.append(rows[own] * self.count + self.phrase[states[own]])
            rows, states = rows[self.shorter[states] >= 0], self.shorter[states][self.shorter[states] >= 0]
        return np.divmod(np.unique(np.concatenate(hits)), self.count)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]


def find_phrases(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, phrase): every phrase that a text contains, byte for byte, once for each row of texts.

    Null and empty phrases and null texts are left out; both sides are folded to one case by the caller, if at all.
    Repeated phrases count once, repeated rows of texts give repeated rows.
    """
    spark = texts.sparkSession
    names = phrases.select(F.col(phrase).cast("string").alias("phrase")).filter("phrase <> ''").distinct()
    names = names.withColumn("hash", F.pmod(F.xxhash64("phrase"), F.lit(1 << 16)))
    total = names.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    schema = f"key {rows.schema['key'].dataType.simpleString()}, phrase string"
    parts = max(1, -(-total // part_bytes))
    found = []
    for part in range(parts if total else 0):
        own = sorted(r.phrase for r in names.filter(F.col("hash") % parts == part).collect())
        if not own:
            continue
        held = spark.sparkContext.broadcast((Automaton([p.encode() for p in own]), own))

        def run(batches, held=held):
            automaton, own = held.value
            for batch in batches:
                buf, offs = _bytes(batch.column("text"))
                lo = 0
                while lo < len(batch):
                    hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + PIECE, "right")) - 1)
                    at, which = automaton.find(buf, offs[lo : hi + 1])
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at + lo)), pa.array([own[k] for k in which], pa.string())], names=["key", "phrase"])
                    lo = hi

        found.append(rows.mapInArrow(run, schema))
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    return out.withColumnRenamed("key", key)
