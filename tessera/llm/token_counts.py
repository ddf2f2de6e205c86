"""Token counts by a linear longest-match automaton.

The vocabulary is a trie; a failure link leads from a node to the node of what is left of its string after
its longest pieces are taken off, and the number of tokens taken off on the way is precomputed. A word is
read once, character by character, and no piece is built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands before each word, as in the vocabulary; words that a worker remembers.
MARK, REMEMBERED = "▁", 1 << 20


class Automaton:
    """Greedy longest match over pieces. A character without a piece of its own counts a token for each byte."""

    def __init__(self, pieces: list[str]) -> None:
        self.child: dict[int, int] = {}
        text, parent, last = [""], [0], [""]
        whole = set(pieces)
        for piece in pieces:
            at = 0
            for c in piece:
                key = at << 21 | ord(c)
                if (to := self.child.get(key)) is None:
                    to = self.child[key] = len(text)
                    text.append(text[at] + c)
                    parent.append(at)
                    last.append(c)
                at = to
        self.fail, self.popped = [0] * len(text), [0] * len(text)
        for v in sorted(range(1, len(text)), key=lambda v: len(text[v])):
            if text[v] in whole:
                self.popped[v] = 1
            elif not parent[v]:
                self.popped[v] = len(last[v].encode("utf-8", "surrogatepass"))
            else:
                u, c = parent[v], ord(last[v])
                count, z = self.popped[u], self.fail[u]
                while (to := self.child.get(z << 21 | c)) is None and z:
                    count, z = count + self.popped[z], self.fail[z]
                if to is None:  # the character has no node: it is taken off by its bytes
                    count, to = count + len(last[v].encode("utf-8", "surrogatepass")), 0
                self.fail[v], self.popped[v] = to, count

    def count(self, word: str) -> int:
        child, fail, popped = self.child.get, self.fail, self.popped
        at = total = 0
        for c in word:
            while (to := child(at << 21 | ord(c))) is None and at:
                total += popped[at]
                at = fail[at]
            if to is None:
                total += len(c.encode("utf-8", "surrogatepass"))
            else:
                at = to
        while at:
            total += popped[at]
            at = fail[at]
        return total


class Counts(dict):
    """Tokens of the words seen so far."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(MARK + word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def piece_vocabulary(path: str) -> list[str]:
    """The text pieces of a sentencepiece vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in skip)]


def token_counts(df: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) per row; words are separated by white space and matched with MARK before them.

    Null and blank texts have no words and no tokens. The vocabulary is bounded; its automaton is broadcast.
    """
    held = df.sparkSession.sparkContext.broadcast(Automaton(pieces))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        counts = Counts(held.value)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("text").to_pylist():
                split = (text or "").split()
                words.append(len(split))
                tokens.append(sum(map(counts.__getitem__, split)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(words, np.int64)), pa.array(np.array(tokens, np.int64))], names=["id", "n_words", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
