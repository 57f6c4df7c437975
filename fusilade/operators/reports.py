"""Statistics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as X


def size_stats(df: DataFrame, by: str, value: str, points: tuple[float, ...] = (0.5, 0.9, 0.95)) -> DataFrame:
    """Count, min, upper middle, max, whole mean and the elements at int(f * (n - 1)) of each group's sorted values.

    Values are counted first, so that a group is as many rows as it has different values."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(by).orderBy(value)
    upto = counts.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy(by)))
    at = lambda pos: F.min(F.when(F.col("upto") > pos, F.col(value)))
    picks = [at(F.floor(F.lit(f) * (F.col("n") - 1))).alias(f"p{int(f * 100)}") for f in points]
    return upto.groupBy(by).agg(F.max("n").alias("n"), F.min(value).alias("least"), at(F.floor(F.col("n") / 2)).alias("middle"), F.max(value).alias("most"), F.floor(F.sum(F.col(value) * F.col("k")) / F.max("n")).alias("mean"), *picks)


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same on every run, sorted by key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n).orderBy(key)


def chunk_report(df: DataFrame, columns: list[str], content: str = "content", chars: int = 300) -> DataFrame:
    """Fixed columns as strings, missing ones empty, and a one-line preview."""
    return df.select(*[F.coalesce(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string"), F.lit("")).alias(c) for c in columns], X.preview(content, chars).alias("preview"))


def ordered_counts(df: DataFrame, by: str, untyped: str | None = None) -> DataFrame:
    """(by, n, place, untyped): counts, the most common first, ties by value; ``untyped`` is the number of rows without a kind (null, or
    the kind of that name)."""
    none = F.col(by).isNull() if untyped is None else F.col(by).isNull() | (F.col(by) == untyped)
    counts = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(none).alias("none"))  # a row a kind
    return counts.select(by, "n", F.row_number().over(Window.orderBy(F.desc("n"), by)).alias("place"), F.sum("none").over(Window.partitionBy()).alias("untyped"))


def inspect_chunks(df: DataFrame, by: str, key: str, content: str, value: str, pattern: str | None = None, n: int = 3, chars: int = 500) -> DataFrame:
    """Per document (``by``): size statistics of its chunks and the first ``n`` of those that ``pattern`` finds, cut at ``chars``."""
    shown = df.where(F.col(content).rlike(pattern)) if pattern else df
    w = Window.partitionBy(by).orderBy(key)
    shown = shown.select(by, F.row_number().over(w).alias("r"), F.substring(content, 1, chars).alias("s")).where(F.col("r") <= n)
    samples = shown.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda x: x["s"]).alias("samples"))
    return size_stats(df, by, value).join(samples, by, "left")


def inspect_results(found: DataFrame, content: str = "content", chars: int = 160) -> DataFrame:
    """Adds ``shown``: the text of selected results, a one-line preview of the others."""
    return found.withColumn("shown", F.when(F.col("selected"), F.col(content)).otherwise(X.preview(content, chars)))
