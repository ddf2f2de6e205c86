"""Exact dedup: local, salted and global combination of equal texts, on DataFrame functions alone.

Digests that occur more often than a bound get salts by their count, so that no task holds more than
about SALT_ROWS ids of one group. Each stage groups by the digest and the full normalised text:
Spark's partial aggregation deduplicates within a task, the shuffled aggregation merges each salt, and
the salt winners of the hot digests are merged again. Ids travel with their salt and are exploded at the
end, so the texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: Rows of one salt of a hot digest.
SALT_ROWS = 4096
#: Hot digests are at most this many: a digest is hot with more than rows / MAX_HOT rows.
MAX_HOT = 20_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row per row of df: its id, keep_id (largest id with an equal text), group_size, kept, text_sha256.

    Null text is an empty text. Of repeated rows with the id that stays, one is kept. Null ids are smaller
    than all others; a group of null ids keeps one of its rows. An empty table gives an empty table.
    """
    base = df.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text")).withColumn("_sha", F.sha2("_text", 256))
    # the number of rows comes from the file footers; it bounds the number of hot digests
    bound = max(salt_rows, df.count() // MAX_HOT)
    hot = base.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound)
    hot = hot.select("_sha", F.ceil(F.col("_n") / salt_rows).cast("int").alias("_salts"))
    salted = base.join(F.broadcast(hot), "_sha", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int"))
    winners = salted.groupBy("_sha", "_text", "_salts", "_salt").agg(
        F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"), F.collect_list(F.struct("_id")).alias("_ids")
    )
    whole = winners.filter("_salts = 1").select("_sha", "_keep", F.col("_size").alias("_total"), "_ids")
    parts = winners.filter("_salts > 1")
    merged = parts.groupBy("_sha", "_text", "_salts").agg(F.max("_keep").alias("_best"), F.sum("_size").alias("_total"))
    merged = merged.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    spread = parts.join(merged, ["_sha", "_text", "_salts", "_salt"]).select("_sha", F.col("_best").alias("_keep"), "_total", "_ids")
    rows = whole.unionByName(spread).select("*", F.posexplode("_ids").alias("_pos", "_row"))
    first = F.array_position("_ids", F.struct(F.col("_keep").alias("_id")))
    return rows.select(
        F.col("_row._id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_total").alias("group_size"),
        (F.col("_row._id").eqNullSafe(F.col("_keep")) & (F.col("_pos") + 1 == first)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns; of each group of equal texts the largest id.

    A row is known by its id and its text's digest, so an id that stands for several texts, or no id, keeps
    each of them; of rows that agree in both, one stays. Null texts count as empty. Any column names may stand
    beside; an empty table gives an empty table.
    """
    name, gone, sha = (C.private(df, n) for n in ("drop", "drop_sha", "sha"))
    lost = exact_groups(df, id_col, text_col).filter(~F.col(id_col).eqNullSafe(F.col("keep_id")))
    drop = lost.select(F.col(id_col).alias(name), F.col("text_sha256").alias(gone)).distinct()
    once = df.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256)).dropDuplicates([id_col, sha])
    return once.join(drop, F.col(id_col).eqNullSafe(F.col(name)) & (F.col(sha) == F.col(gone)), "left_anti").drop(sha)


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
