"""Reading of the driver's tables, and how rows are dealt out and columns found once."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, rows: int, each: int, *keys: str) -> DataFrame:
    """df, made of ``rows`` rows, dealt by its keys over tasks of about ``each`` rows; as it is where that makes no more tasks than there are cores.

    Small files give few tasks, and the usual number of partitions doesn't grow with the input; this number does.
    """
    n = -(-rows // each)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def spread(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """df dealt by its keys over so many tasks, for a join or grouping by all of them; as it is if no number is given."""
    return df.repartition(tasks, *keys) if tasks else df


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are found once a row: a filter on them, or another column that asks for them often, doesn't find them again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def exploded(df: DataFrame, key: str, structs: list[Column]) -> DataFrame:
    """key and the fields of each of the structs that isn't NULL, a row each.

    The array is a column of its own and holds NULLs until it is exploded: explode and array_compact would interpret its expressions one by one.
    explode_outer, since for explode the array would be built a second time, to see whether it is empty.
    """
    held = df.select(key, F.array(*structs).alias("__each"))
    return held.select(key, F.explode_outer("__each").alias("__one")).filter(F.col("__one").isNotNull()).select(key, "__one.*")
