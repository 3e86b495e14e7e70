"""Size-tiered compaction of immutable shards under a versioned manifest.

An arrival is appended as a run of small shards. Runs whose sizes lie in the same tier (a power of the fan-out above the smallest
size) are merged, once there are as many as the fan-out, into one run of target-sized files; that may fill the next tier, so merging
goes on until no tier is full. Shards are never changed. Each append or merge writes its files first and then commits the next
manifest by creating its file, which only one writer can; who comes second takes its runs to the version after that, and a merge
whose runs have gone meanwhile is given up. A manifest counts once its last line is there, so a reader sees a version whole or not at
all; one left unfinished is passed over after ``lease_seconds``. Files of a run that was cut off belong to no version. ``vacuum``
deletes runs that no kept version names and that are older than an age, so that a writer's new run isn't taken from it.

The manifest lists files, never rows, so what the driver holds grows with the number of files alone. Runs keep their own schemas:
columns that a run lacks are read as null, and an arrival whose column has another type than before is refused. Nulls, repeated rows
and any columns are kept as they are; empty arrivals commit a version that adds no rows.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from worksight.llm.blocks import own_folder

DONE, SHARD = "committed", "shard"


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 256 << 20, smallest_bytes: int = 4 << 20, fan_out: int = 4, lease_seconds: int = 600):
        self.spark, self.path, self.lease_seconds = spark, path, lease_seconds
        self.target_bytes, self.smallest_bytes, self.fan_out = target_bytes, smallest_bytes, fan_out
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[tuple[str, int]]:
        at = self._at(folder)
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return [int(n[1:-5]) for n, _ in self._names("manifest") if n.startswith("v") and n.endswith(".json")]

    def _lines(self, version: int) -> list[str]:
        stream = self._fs.open(self._at(f"manifest/v{version:010d}.json"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()

    def _complete(self, version: int) -> bool:
        return self._lines(version)[-1] == DONE

    def version(self) -> int:
        return next((v for v in sorted(self._numbers(), reverse=True) if self._complete(v)), 0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self._lines(version)[0]) if version else {"version": 0, "runs": []}

    def _age(self, name: str) -> float:
        return time.time() - self._fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def _create(self, version: int) -> bool:
        """Takes the version's file; of several writers one gets it."""
        at = self._at(f"manifest/v{version:010d}.json")
        if at.toUri().getScheme() in (None, "file") and self._fs.getScheme() == "file":
            self._fs.mkdirs(at.getParent())
            try:  # here Hadoop's create looks first and creates then
                os.close(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            self._fs.create(at, False).close()
        except Exception as e:  # the JVM's FileAlreadyExistsException
            if not self._fs.exists(at):
                raise e
            return False
        return True

    def _commit(self, was: dict, runs: list[dict]) -> int:
        last = max(self._numbers(), default=0)
        if last > was["version"] and (self._complete(last) or self._age(f"manifest/v{last:010d}.json") < self.lease_seconds):
            raise Conflict(f"version {last} has been taken by another writer")
        version = last + 1
        if not self._create(version):
            raise Conflict(f"version {version} has been taken by another writer")
        stream = self._fs.create(self._at(f"manifest/v{version:010d}.json"), True)
        stream.write(bytearray(json.dumps({"version": version, "runs": runs}) + "\n" + DONE, "utf-8"))
        stream.close()
        return version

    def _write(self, df: DataFrame) -> dict:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{name}")
        files = [[f"data/{name}/{n}", size] for n, size in self._names(f"data/{name}") if n.endswith(".parquet")]
        return {"name": name, "files": files, "bytes": sum(s for _, s in files), "schema": df.schema.json()}

    @staticmethod
    def _fields(runs: list[dict]) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for r in runs for f in StructType.fromJson(json.loads(r["schema"])).fields}

    def append(self, df: DataFrame, tries: int = 20) -> int:
        new = None
        for k in range(tries):
            was = self.manifest()
            have, own = self._fields(was["runs"]), dict(df.dtypes)
            if clash := {c: (have[c], own[c]) for c in own if have.get(c, own[c]) != own[c]}:
                raise ValueError(f"columns have other types than before: {clash}")
            new = new or self._write(df)
            try:
                return self._commit(was, [*was["runs"], new])
            except Conflict:
                time.sleep(0.05 * k)
        raise Conflict(f"{tries} versions have been taken by other writers")

    def tier(self, n_bytes: int) -> int:
        out, most = 0, self.smallest_bytes
        while n_bytes > most:
            out, most = out + 1, most * self.fan_out
        return out

    def compact(self) -> int:
        """Merges full tiers until there are none; returns the version."""
        while True:
            was = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for r in was["runs"]:
                tiers.setdefault(self.tier(r["bytes"]), []).append(r)
            full = next((rs for _, rs in sorted(tiers.items()) if len(rs) >= self.fan_out), None)
            if not full:
                return was["version"]
            n = max(1, -(-sum(r["bytes"] for r in full) // self.target_bytes))
            merged = self._write(self._read(full).drop(SHARD).coalesce(n))  # files are read through, nothing is shuffled
            gone = {r["name"] for r in full}
            while True:
                try:
                    self._commit(was, [*(r for r in was["runs"] if r["name"] not in gone), merged])
                    break
                except Conflict:
                    time.sleep(0.05)
                    was = self.manifest()
                    if not gone <= {r["name"] for r in was["runs"]}:  # another merge has taken some of them
                        break

    def _read(self, runs: list[dict]) -> DataFrame:
        """All rows of runs with the shard that holds each; runs of one schema are one scan."""
        by_schema: dict[str, list[str]] = {}
        for r in runs:
            by_schema.setdefault(r["schema"], []).extend(f"{self.path}/{f}" for f, _ in r["files"])
        shard = F.regexp_extract(F.col("_metadata.file_path"), r"data/(.*)$", 1).alias(SHARD)
        scans = []
        for schema, files in by_schema.items():
            kind = StructType.fromJson(json.loads(schema))
            scans.append(self.spark.read.schema(kind).parquet(*files).select("*", shard) if files else self.spark.createDataFrame([], kind).withColumn(SHARD, F.lit("")))
        if not scans:
            return self.spark.createDataFrame([], f"{SHARD} string")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with the column shard."""
        return self._read(self.manifest(version)["runs"])

    def vacuum(self, keep: int = 1, older_than_seconds: int = 86_400) -> int:
        """Deletes runs that none of the last versions names and that are older than an age, which must exceed any write's time."""
        last = self.version()
        live = {r["name"] for v in self._numbers() if last - keep < v <= last and self._complete(v) for r in self.manifest(v)["runs"]}
        gone = [n for n, _ in self._names("data") if n not in live and self._age(f"data/{n}") >= older_than_seconds]
        for n in gone:
            self._fs.delete(self._at(f"data/{n}"), True)
        return len(gone)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """documents arrive in four portions by a hash of their id and are compacted; a row for each document with its shard's run size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, own_folder(spark, "shards"), target_bytes=64 << 20)
    arrival = F.shiftrightunsigned(F.xxhash64("doc_id"), 62)
    for k in range(4):
        store.append(docs.filter(arrival == k))
    version = store.compact()
    store.vacuum(older_than_seconds=0)  # nobody else writes here
    return store.read(version).select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.lit(version).alias("version"), F.lit(len(store.manifest(version)["runs"])).alias("n_runs"))


#: Four arrivals make versions 1 to 4; they fill a tier only if their sizes are alike, which they are for a hash of the id.
OP6_SQL = "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256, 5 AS version, 1 AS n_runs FROM documents"
