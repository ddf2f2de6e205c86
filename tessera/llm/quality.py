"""Quality scores by Bradley-Terry pairwise ranking.

A document's worth is a linear function of features of its text. It is fitted so that of a good and a bad
document the good one is preferred: the logistic loss of the difference of their features, over pairs drawn
from a bounded sample of labelled rows. The threshold is the quantile of the fitted worths at the share of
bad rows; scores are worths on a logistic scale on which the threshold has the score THRESHOLD.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: Labelled rows that worths are fitted on, about; pairs of a step; steps; the score of the threshold.
FIT_ROWS, PAIRS, STEPS, THRESHOLD = 20_000, 4096, 600, 0.3


def features(text: str | None) -> list[float]:
    """Of the shape of a text: lengths, shares of kinds of characters and words, repetition."""
    t = text or ""
    n, words, lines = max(1, len(t)), t.split(), [x for x in t.split("\n") if x.strip()]
    w = max(1, len(words))
    chars = Counter(t)
    letters = sum(v for c, v in chars.items() if c.isalpha())
    upper = sum(v for c, v in chars.items() if c.isupper())
    digits = sum(v for c, v in chars.items() if c.isdigit())
    marks = {c: chars.get(c, 0) / w for c in "!?|#$%&*@_/=<>{}[]\\~^.,:;'\"-"}
    symbols = sum(v for c, v in chars.items() if not c.isalnum() and not c.isspace())
    kinds = Counter(words)
    shout = sum(1 for x in words if len(x) > 1 and x.isupper())
    tail = sum(1 for x in words if len(x) > 1 and not x[-1].isalnum() and not x[-2].isalnum())
    length = sum(map(len, words)) / w
    p = np.array(list(chars.values()), float) / n
    pairs = Counter(zip(words, words[1:], strict=False))
    return [
        np.log1p(len(t)), np.log1p(len(words)), length, max(map(len, words), default=0) / 20, letters / n, upper / max(1, letters), digits / n, symbols / n,
        shout / w, tail / w, len(kinds) / w, max(kinds.values(), default=0) / w, 1 - len(pairs) / max(1, len(words) - 1), 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(w / max(1, len(lines))), float(-(p * np.log(p)).sum()) if len(t) else 0.0, sum(1 for x in words if len(x) == 1) / w,
        sum(1 for x in words if x[0].isupper()) / w, *marks.values(),
    ]


WIDTH = len(features("a"))


def featured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<float>) per row of df."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                x = np.array([features(t) for t in part.column("text").to_pylist()], np.float32).ravel()
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * WIDTH, pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([part.column("id"), flat], names=["id", "x"])

    return rows.mapInArrow(run, "id long, x array<float>")


class Ranking:
    """Standardised features, clipped, with their squares; weights; the logistic scale."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        z = self.expand(x)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.weights, rng = np.zeros(z.shape[1]), np.random.default_rng(5)
        moment, square = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, STEPS + 1 if len(good) and len(bad) else 0):
            diff = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
            slope = -(diff / (1 + np.exp(np.clip(diff @ self.weights, -30, 30)))[:, None]).mean(0) + 1e-3 * self.weights
            moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            self.weights = self.weights - 0.03 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        worth = z @ self.weights
        self.at = float(np.quantile(worth, (y == 0).mean())) if len(y) else 0.0
        self.scale = float(np.std(worth)) / 2 + 1e-6 if len(y) else 1.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -4, 4)
        return np.concatenate([z, z * z], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        worth = (self.expand(x) @ self.weights - self.at) / self.scale + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(worth, -30, 30)))


def held_out(id_col):
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) per row of df; labels (id, label 0 or 1) of held-out ids aren't used.

    Null texts count as empty and have a score. Null labels are left out; without labels of both kinds all
    scores are THRESHOLD or near. Repeated rows give repeated rows; a null id isn't held out.
    """
    known = C.materialise(featured(df, id_col, text_col))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).filter("y is not null and id is not null").filter(~held_out(F.col("id")))
    every = max(1, marks.count() // fit_rows)
    marks = marks.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    rows = known.join(marks, "id").orderBy("id", "y").collect()
    x = np.array([r.x for r in rows], float).reshape(-1, WIDTH)
    held = df.sparkSession.sparkContext.broadcast(Ranking(x, np.array([r.y for r in rows], int)) if rows else Ranking(np.zeros((1, WIDTH)), np.array([1])))

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, WIDTH).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(held.value.score(x))], names=["id", "score"])

    scored = known.mapInArrow(run, "id long, score double")
    out = F.coalesce(held_out(F.col("id")), F.lit(False))
    return scored.select(F.col("id").alias(id_col), out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

