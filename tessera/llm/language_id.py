"""Language identification by Bayesian fusion of evidence.

For each text and language: the likelihood of its byte trigrams, whether the declared language says it, how
often the address suffix says it, and a prior of the host, smoothed towards its suffix and that towards
all rows. Languages are counted over all rows; the trigram table of each is fitted on a bounded sample of
its distinct texts. Host and suffix counts are grouped aggregations over all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: Distinct texts that the trigram table of each language is fitted on, about, or all that it has; hashed trigrams; trigrams of a text that count as evidence.
FIT_ROWS, GRAMS, EVIDENCE = 5000, 1 << 13, 60
#: Languages that have a table at most, those of most rows; texts that declare another aren't rejected.
LANGUAGES = 256
#: Bytes of a piece of a batch, whose trigrams take some sixty times as many.
PIECE = 1 << 20
#: Parts that the hashes of texts are dealt into to choose a sample.
SHARES = 1 << 30
#: Log likelihood by which a trigram of a text may fall behind noise.
NOISE = -1.0
#: How often a declaration is right; rows that a parent's distribution weighs in a smoothed prior.
DECLARED_RIGHT, SMOOTHING = 0.9, 20.0
#: Salts that rows of one text are dealt over when verdicts are joined.
DEALT = 16


def _gram_sums(buf: np.ndarray, offs: np.ndarray):
    """Hashed trigrams of the letters of a piece, and the number of the row of each; digits and marks are blanks."""
    letters = C.LOWER[buf[offs[0] : offs[-1]]].copy()
    letters[~(((letters >= 0x61) & (letters <= 0x7A)) | (letters >= 0x80))] = 0x20
    own = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    a, b, c = (letters[i : len(letters) - 2 + i].astype(np.uint32) for i in range(3)) if len(letters) > 2 else [np.zeros(0, np.uint32)] * 3
    key = ((a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 13)
    good = (own[:-2] == own[2:]) & (b != 0x20) if len(letters) > 2 else np.zeros(0, bool)
    return own[:-2][good] if len(letters) > 2 else own[:0], key[good]


def fit(df: DataFrame, text_col: str, declared_col: str, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each hashed trigram in each.

    The LANGUAGES declared languages of most rows of df count. A language with up to fit_rows distinct texts is fitted on all of them,
    a larger one on about fit_rows, chosen by hash; copies of a text count once.
    """
    rows = df.select(F.col(declared_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("hash").alias("n"))
    sizes = sizes.orderBy(F.desc("rows"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return [], np.zeros((0, GRAMS))
    # the number of texts is an estimate: a language is thinned out only if it surely has more than enough
    shares = [(r.lang, SHARES if r.n < 1.2 * fit_rows else -(-SHARES * fit_rows // r.n)) for r in sizes]
    shares = F.broadcast(df.sparkSession.createDataFrame(shares, "lang string, share long"))
    rows = rows.join(shares, "lang").filter(F.pmod("hash", F.lit(SHARES)) < F.col("share")).select("lang", "text").distinct()

    def run(batches):
        for batch in batches:
            buf, offs = C.text_bytes(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lo, hi in C.pieces(offs, PIECE):
                own, key = _gram_sums(buf, offs[lo : hi + 1])
                for lang in set(langs[lo:hi]):
                    n = np.bincount(key[(langs[lo:hi] == lang)[own]], minlength=GRAMS)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "gram", "n"])

    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in counts})
    table = np.full((len(langs), GRAMS), 0.5)
    for r in counts:
        table[langs.index(r.lang), r.gram] += r.n
    return langs, np.log(table / table.sum(1, keepdims=True))


def text_evidence(df: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """df (with a column text) with grams, how many trigrams a text has, and their log likelihoods by language."""
    held = df.sparkSession.sparkContext.broadcast(table.T.astype(np.float64).copy())
    names = [c for c in df.columns if c != "text"]

    def run(batches):
        for batch in batches:
            buf, offs = C.text_bytes(batch.column("text"))
            for lo, hi in C.pieces(offs, PIECE):
                own, key = _gram_sums(buf, offs[lo : hi + 1])
                logs = np.zeros((hi - lo, len(langs)))
                for k in range(len(langs)):
                    logs[:, k] = np.bincount(own, weights=held.value[key, k], minlength=hi - lo)
                part = batch.slice(lo, hi - lo)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * len(langs), pa.int32()), pa.array(logs.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(np.bincount(own, minlength=hi - lo)), flat], names=[*names, "grams", "logs"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "text")
    return df.mapInArrow(run, f"{kinds}, grams long, logs array<double>")


def language_code(c):
    """The primary subtag of a declaration: its letters before a - or _, lower-cased; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]{2,8})(?:[-_].*)?\s*$", 1)), F.lit(""))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source", suffix_col: str | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, language, confidence, text_language, accepted) per row.

    A text is accepted if it has letters and, unless it is short, is likelier under its language than noise is, or
    no table could be fitted for the language it declares. Null and empty texts are not accepted; without any evidence the language is that of the priors. Null hosts, suffixes and
    declarations say nothing. Ties go to the first language by name. Repeated rows give repeated rows; an
    empty table gives an empty table.
    """
    suffix = F.col(suffix_col) if suffix_col else F.lit(None)
    rows = df.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), language_code(F.col(declared_col)).alias("declared"), F.col(host_col).cast("string").alias("host"), suffix.cast("string").alias("suffix"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    langs, table = fit(rows, "text", "declared", fit_rows)
    if not langs:
        return rows.select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(n) for n, t in (("language", "string"), ("confidence", "double"), ("text_language", "string"))), F.lit(False).alias("accepted"))
    known = C.materialise(text_evidence(rows, langs, table))
    best = F.array_position("logs", F.array_max("logs")).cast("int")
    said = known.withColumn("best", F.when(F.col("grams") > 0, best))

    def counted(*keys: str) -> DataFrame:
        cols = [F.sum((F.col("best") == k + 1).cast("long")).alias(f"n{k}") for k in range(len(langs))]
        return said.filter("best is not null").groupBy(*keys).agg(F.array(*cols).alias("n_" + "_".join(keys or ("all",))))

    # all rows -> suffix -> host, each smoothed towards the one before
    zero = F.array(*[F.lit(0).cast("long")] * len(langs))

    def smooth(counts: str, parent):
        n = F.coalesce(F.col(counts), zero)
        total = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.zip_with(n, parent, lambda c, p: (c + SMOOTHING * p) / (total + SMOOTHING))

    uniform = F.array(*[F.lit(1.0 / len(langs))] * len(langs))
    joined = C.salted_join(C.salted_join(said, counted("host"), "host", "left"), counted("suffix"), "suffix", "left", said.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))).crossJoin(F.broadcast(counted()))
    joined = joined.withColumn("p_all", smooth("n_all", uniform)).withColumn("p_suffix", smooth("n_suffix", F.col("p_all"))).withColumn("p_host", smooth("n_host", F.col("p_suffix")))
    wrong = (1 - DECLARED_RIGHT) / max(1, len(langs) - 1)
    names = F.array(*map(F.lit, langs))
    told = F.transform(names, lambda x: F.when(~F.array_contains(names, F.coalesce("declared", F.lit(""))), F.lit(1.0)).when(x == F.col("declared"), DECLARED_RIGHT).otherwise(wrong))
    weight = F.least(F.lit(1.0), EVIDENCE / F.greatest("grams", F.lit(1)))
    post = F.zip_with(F.zip_with("logs", "p_host", lambda a, p: a * weight + F.log(p)), told, lambda a, t: a + F.log(t))
    fused = joined.withColumn("post", post).withColumn("top", F.array_max("post"))
    total = F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    at = F.array_position("post", F.col("top")).cast("int")
    untold = F.col("declared").isNotNull() & ~F.array_contains(names, F.col("declared"))
    likely = (F.col("grams") < EVIDENCE) | untold | (F.element_at("logs", at) > F.col("grams") * F.lit(NOISE - float(np.log(GRAMS))))
    return fused.select(
        F.col("id").alias(id_col),
        F.element_at(names, at).alias("language"),
        F.round(1 / total, 6).alias("confidence"),
        F.when(F.col("grams") > 0, F.element_at(names, F.col("best"))).alias("text_language"),
        (F.col("lettered") & likely).alias("accepted"),
    )


def keep_identified(df: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The rows of df that identify() accepts, each judged by its own text, declaration and host, whatever its id.

    Repeated rows share their fate; null and blank texts go. Any column names may stand beside; an empty table
    gives an empty table. Verdicts are joined by a digest of what they were made from, dealt over DEALT salts, as
    one text may be a third of all rows.
    """
    key, salt, drop, dealt = (C.private(df, n) for n in ("key", "salt", "drop", "drop_salt"))
    told = F.array(*[F.coalesce(F.sha2(F.col(f"`{c}`").cast("string"), 256), F.lit("")) for c in (text_col, declared_col, host_col)])
    rows = df.withColumn(key, F.sha2(F.array_join(told, ","), 256))
    judged = identify(rows, key, text_col, declared_col, host_col).filter("not accepted").select(F.col(key).alias(drop)).distinct()
    judged = judged.withColumn(dealt, F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(DEALT)).cast("int"))
    return rows.join(judged, (F.col(key) == F.col(drop)) & (F.col(salt) == F.col(dealt)), "left_anti").drop(key, salt)
