"""Guards that raise: a job stops where its inputs are not what it relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GuardError(ValueError):
    """An input that a job must not go on with."""


def _examples(rows: DataFrame, n: int = 5) -> str:
    return ", ".join(str(tuple(r)) for r in rows.limit(n).collect())


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, if no key is there twice; null keys count as equal."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    if found := _examples(twice):
        raise GuardError(f"keys that are not unique: {found}")
    return df


def joined_exactly(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join of two sides that have the same keys, each of them once."""
    require_unique(left, key)
    require_unique(right, key)
    here, there = left.select(F.col(key).alias("k"), F.lit("right").alias("lacks")), right.select(F.col(key).alias("k"), F.lit("left").alias("lacks"))
    gaps = here.join(there, "k", "left_anti").unionByName(there.join(here, "k", "left_anti"))
    if found := _examples(gaps):
        raise GuardError(f"ids of one side only (id, side that lacks it): {found}")
    return left.join(right, key)


def require_finite(df: DataFrame, column: str) -> DataFrame:
    """``df``, if no value of ``column`` is null, infinite or not a number."""
    fine = F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(F.col(column)) < float("inf"))
    if found := _examples(df.where(~fine).select(column)):
        raise GuardError(f"{column} is not finite: {found}")
    return df


def require_count(df: DataFrame, wanted: int) -> DataFrame:
    """``df``, if it has exactly ``wanted`` rows."""
    if (n := df.count()) != wanted:
        raise GuardError(f"{n} rows instead of {wanted}")
    return df


def concatenated(*parts: tuple[DataFrame, int]) -> DataFrame:
    """The union of parts of a stated size."""
    out = None
    for df, wanted in parts:
        require_count(df, wanted)
        out = df if out is None else out.unionByName(df)
    return out


def first_distinct(df: DataFrame, column: str, order: str, n: int) -> DataFrame:
    """The first ``n`` different values of ``column`` in ``order``; an error if there are fewer."""
    out = df.groupBy(column).agg(F.min(order).alias(order)).orderBy(order, column).limit(n)
    if (found := out.count()) < n:
        raise GuardError(f"{found} different values instead of {n}")
    return out


def held_out(df: DataFrame, group: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """``df`` with ``is_eval``: of each group the first rows by hash, at least one; a group that would be held out whole is an error."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy(group).orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col(key).cast("string")), 256), key))
    sizes = df.groupBy(F.col(group).alias("size_of")).agg(F.count("*").alias("size")).withColumn("take", F.greatest(F.lit(1), F.floor(F.col("size") * share)))
    if found := _examples(sizes.where("take >= size").select("size_of", "size")):
        raise GuardError(f"groups too small to split: {found}")
    joined = df.withColumn("place", rank).join(F.broadcast(sizes), F.col(group).eqNullSafe(F.col("size_of")))
    return joined.select(*df.columns, (F.col("place") <= F.col("take")).alias("is_eval"))
