"""Writes as new snapshots: keyed upsert, insert if absent, append-only logs, replacement per owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType


def _ordered(df: DataFrame, first: list[str]) -> Column:
    """The columns of a row as a value that rows can be put in order by: first, then all others that have an order."""
    rest = [f.name for f in df.schema.fields if f.name not in first and not isinstance(f.dataType, MapType | VariantType)]
    return F.struct(*first, *rest)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """target with the rows of updates in place of those with equal keys; the caller writes it to a new folder.

    Of several updates of a key the last by order wins, then the largest by its other columns, so that the same
    updates always give the same rows. An update wins over target whatever its order. Null keys are equal.
    """
    new = "_new"
    while new in target.columns or new in updates.columns:
        new += "_"
    rows = target.withColumn(new, F.lit(0)).unionByName(updates.withColumn(new, F.lit(1)), allowMissingColumns=True)
    columns = [c for c in rows.columns if c != new]
    best = rows.groupBy(*[F.col(k).alias(f"{new}{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*columns), _ordered(rows, [new, *(order or [])])).alias("row"))
    return best.select("row.*")


def insert_absent(target: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The rows to append: one for each key that target doesn't have, the first by order, then the smallest by its other columns."""
    absent = rows.join(target.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)
    best = absent.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*rows.columns), _ordered(absent, order or [])).alias("row"))
    return best.select("row.*")


def logged(df: DataFrame, day_col: str) -> DataFrame:
    """The rows as an append-only log holds them: with the day that they are partitioned by."""
    return df.withColumn("day", F.to_date(day_col))


def append_log(df: DataFrame, path: str, day_col: str) -> None:
    logged(df, day_col).write.mode("append").partitionBy("day").parquet(path)


def replace_owner(target: DataFrame, rows: DataFrame, owner: str, owners: DataFrame) -> DataFrame:
    """target without the rows of owners, and with rows; an owner without new rows ends up with none."""
    return target.join(owners.select(owner).distinct(), owner, "left_anti").unionByName(rows)
