"""Publishing tables without contact data: scrub, check, then move one pointer; and the dataset's files with their digests.

A version is a folder of tables. ``publish`` writes a scrubbed copy beside the others, counts what is left of the patterns in every
string of it, nested ones included, and only if nothing is left writes the file CURRENT that names it; otherwise the copy is deleted
and an error raised. Readers open what CURRENT names, so they never see half a version.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from worksight.functions.parsing import LEAKS, publishable
from worksight.storage import commit

#: Keys of JSON whose values are addresses and stay as they are, and those that hold contacts.
URL_KEYS = ("url", "attachment_url", "listing_url", "source_url", "comparative_url", "bid_url", "period_url", "tender_url", "document")
CONTACT_KEYS = ("mobile", "mobileno", "phone", "email", "contactno", "contractormobile")
CURRENT = "CURRENT"


def _walk(value, on_text, skip=()):
    if isinstance(value, dict):
        return {k: v if k in skip else _walk(v, on_text, skip) for k, v in value.items()}
    if isinstance(value, list):
        return [_walk(v, on_text, skip) for v in value]
    return on_text(value) if isinstance(value, str) else value


def masked(text: str) -> str:
    """publishable() of one text, for strings inside of free-form JSON; the patterns are the same."""
    patterns = [(re.compile(p.removeprefix("(?U)")), "[e-mail removed]" if name == "n_mail" else "[phone removed]") for name, p in LEAKS]
    parts = re.split(r"(https?://\S+)", text)
    for i in range(0, len(parts), 2):
        for pattern, mark in patterns:
            parts[i] = pattern.sub(mark, parts[i])
    return "".join(parts)


@F.pandas_udf(StringType())
def scrub_json(c: pd.Series) -> pd.Series:
    """JSON objects and arrays with every string masked but those of URL_KEYS; NULL for other text. Their form is free, so Python takes them apart."""

    def one(text):
        if text is None or text.lstrip()[:1] not in ("[", "{"):
            return None
        try:
            return json.dumps(_walk(json.loads(text), masked, URL_KEYS), ensure_ascii=False)
        except ValueError:
            return None

    return c.map(one)


def scrub_cell(c: Column) -> Column:
    return F.coalesce(scrub_json(c), publishable(c))


def scrub_columns(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """df with the named columns scrubbed, or all of strings if none are named. Arrays of strings are scrubbed element by element."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    chosen = [c for c in (columns if columns is not None else kinds) if c in kinds]
    text = {c: scrub_cell(F.col(c)) for c in chosen if isinstance(kinds[c], StringType)}
    lists = {c: F.transform(c, publishable) for c in chosen if isinstance(kinds[c], ArrayType) and isinstance(kinds[c].elementType, StringType)}
    return df.withColumns(text | lists) if text or lists else df


def redact(df: DataFrame, keys: Iterable[str] = CONTACT_KEYS) -> DataFrame:
    """df without fields of contacts, at any depth of its structs."""
    gone = {k.lower() for k in keys}

    def cut(c: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*(cut(c[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name.lower() not in gone)))
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            return F.transform(c, lambda x: cut(x, kind.elementType))
        if isinstance(kind, MapType):
            return F.map_filter(c, lambda k, _: ~F.lower(k).isin(*gone))
        return c

    return df.select(*(cut(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if f.name.lower() not in gone))


def without_phone(c: Column) -> Column:
    """A grid's contractor cell before anything is stored of it."""
    return F.trim(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?:<br\s*/?>)?\s*(?:\+?91)?[0-9]{10}\s*$", ""), F.lit("<br/>"), F.lit(" ")))


def leaks(df: DataFrame) -> DataFrame:
    """(column, pattern, n): cells of each column that hold each pattern outside addresses; nested columns are read as JSON. Only found ones."""

    def plain(f):
        c = F.col(f.name) if isinstance(f.dataType, StringType) else F.to_json(F.struct(f.name))
        return F.regexp_replace(c, r'https?://[^\s"]+' if not isinstance(f.dataType, StringType) else r"https?://\S+", " ")

    held = [f for f in df.schema.fields if isinstance(f.dataType, (StringType, ArrayType, StructType, MapType))]
    if not held:
        return df.sparkSession.createDataFrame([], "column string, pattern string, n long")
    counts = df.agg(*(F.count_if(plain(f).rlike(p)).alias(f"{i}:{name}") for i, f in enumerate(held) for name, p in LEAKS))
    long = counts.unpivot([], counts.columns, "what", "n").filter("n > 0")
    names = F.array(*(F.lit(f.name) for f in held))
    return long.select(F.element_at(names, F.split_part("what", F.lit(":"), F.lit(1)).cast("int") + 1).alias("column"), F.split_part("what", F.lit(":"), F.lit(2)).alias("pattern"), "n")


class Leak(RuntimeError):
    """Contact data survived."""


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, columns: Mapping[str, Iterable[str] | None] | None = None) -> str:
    """Writes the tables' scrubbed versions and makes them current; returns the version's name.

    columns: which to scrub of each table (None: all); without it all of all. Raises Leak, and changes nothing, if a pattern is left.
    """
    version = uuid.uuid4().hex
    at, found = f"{path}/{version}", []
    for name, df in tables.items():
        chosen = None if columns is None else columns.get(name, ())
        scrub_columns(df, chosen).write.parquet(f"{at}/{name}")
        found += [(name, r["column"], r["pattern"], r["n"]) for r in leaks(spark.read.parquet(f"{at}/{name}")).collect()]  # at most three rows a column
    if found:
        folder, fs = _path(spark, at)
        fs.delete(folder, True)
        raise Leak(f"publishing stopped, contact data is left: {found[:5]}")
    commit(spark, f"{path}/{CURRENT}", version)
    return version


def published(spark: SparkSession, path: str, table: str) -> DataFrame:
    version = spark.read.text(f"{path}/{CURRENT}").first()["value"]
    return spark.read.parquet(f"{path}/{version}/{table}")


def export_dataset(tables: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Writes each table as CSV files with heads, nested columns as JSON, and a manifest (name, file, rows, sha256); returns it.

    Files are hashed where they are read, so nothing of them passes through the driver; path must be new.
    """
    manifest = None
    for name, df in tables.items():
        nested = {f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, (ArrayType, StructType, MapType))}
        (df.withColumns(nested) if nested else df).write.option("header", True).option("escape", '"').csv(f"{path}/{name}")
        spark = df.sparkSession
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{path}/{name}")
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/{name}")
        counted = rows.groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")).agg(F.count("*").alias("rows"))
        own = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256")).join(counted, "file", "left")
        own = own.select(F.lit(name).alias("name"), "file", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "sha256")
        manifest = own if manifest is None else manifest.unionByName(own)
    manifest.coalesce(1).write.json(f"{path}/MANIFEST")
    return manifest
