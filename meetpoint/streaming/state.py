"""Tables that streams keep between micro-batches, in versions, so that a batch may run again.

A table lies in hash buckets of one key.  A batch reads the tables as the batch
before it left them, writes anew only the buckets it touches, and commits with
one small file that names the version of every bucket.  Until that file is there
nothing of the batch is seen, so a batch that is lost at any step leaves no trace
and runs again from the same rows; a committed batch is not run again.

A batch that changes few rows of a bucket may write these alone, as a version on
top of the others; a bucket with VERSIONS of them is written anew.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.dataset import delete_path, list_names, read_file, write_file

BUCKET = "__bucket"
#: The batch id of the tables a stream starts with.
START = -1
VERSION = "__version"
#: Versions that a bucket may consist of before it is written anew.
VERSIONS = 8


class KeptTables:
    """The tables below ``folder``, each in ``buckets`` buckets of the column ``keys`` gives for it.

    Choose as many buckets as make one of the largest table a few hundred MB.  One
    stream writes at a time; others may read committed tables meanwhile.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets

    def bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def touched(self, df: DataFrame, column: str) -> list[int]:
        """The buckets that rows of ``df`` belong to: at most ``buckets`` numbers."""
        return sorted(r[0] for r in df.select(self.bucket(column)).distinct().collect())

    def commits(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in list_names(self.spark, f"{self.folder}/commits") if n.endswith(".json"))

    def manifest(self, batch_id: int) -> dict:
        return json.loads(read_file(self.spark, f"{self.folder}/commits/{batch_id}.json"))

    def open(self, batch_id: int) -> Batch | None:
        """The batch, to read and write; None if it was committed before."""
        done = self.commits()
        if batch_id in done:
            return None
        before = [n for n in done if n < batch_id]
        return Batch(self, batch_id, self.manifest(before[-1]) if before else {"tables": {}, "latest": None})

    def start(self, **tables: DataFrame) -> None:
        """Keep ``tables`` as what the first batch finds; nothing is done if there are any tables yet."""
        if self.commits():
            return
        first = self.open(START)
        for name, df in tables.items():
            first.write(name, df, list(range(self.buckets)))
        first.commit(None)

    def table(self, name: str) -> DataFrame | None:
        """A whole table after the last committed batch."""
        done = self.commits()
        return Batch(self, START, self.manifest(done[-1])).read(name) if done else None

    def forget(self, keep: int = 2) -> None:
        """Delete versions that only commits before the last ``keep`` name, and those commits."""
        done = self.commits()
        for old, new in zip(done[:-keep], done[1 : len(done) - keep + 1], strict=True):
            before, after = self.manifest(old)["tables"], self.manifest(new)["tables"]
            for name, table in before.items():
                for b, versions in table["buckets"].items():
                    for version in set(versions) - set(after.get(name, table)["buckets"].get(b, [])):
                        delete_path(self.spark, self.path(name, version, b))
            delete_path(self.spark, f"{self.folder}/commits/{old}.json")

    def path(self, name: str, batch_id: int, bucket: int | str | None = None) -> str:
        whole = f"{self.folder}/{name}/batch={batch_id}"
        return whole if bucket is None else f"{whole}/{BUCKET}={bucket}"


class Batch:
    """One batch's view: tables as the batch before left them, and what this one writes."""

    def __init__(self, kept: KeptTables, batch_id: int, before: dict):
        self.kept, self.batch_id, self.before = kept, batch_id, before
        self.after: dict[str, dict] = {}

    @property
    def latest(self) -> int | None:
        """The latest event time, in microseconds, that the batches before saw."""
        return self.before["latest"]

    def read(self, name: str, buckets: list[int] | None = None, only: DataFrame | None = None) -> DataFrame | None:
        """The named buckets (all, if none are named) as they were before the batch, of the keys in ``only`` alone if given; None if the table is not there yet."""
        return self._load(name, self.before["tables"].get(name), buckets, only)

    def written(self, name: str, buckets: list[int] | None = None, only: DataFrame | None = None) -> DataFrame:
        """The same with what this batch wrote."""
        return self._load(name, self.after[name], buckets, only)

    def _load(self, name: str, table: dict | None, buckets: list[int] | None, only: DataFrame | None) -> DataFrame | None:
        if table is None:
            return None
        key, schema = self.kept.keys[name], StructType.fromJson(table["schema"])
        paths: dict[int, list[str]] = {}
        for b, versions in table["buckets"].items():
            for v in versions if buckets is None or int(b) in set(buckets) else []:
                paths.setdefault(v, []).append(self.kept.path(name, v, b))
        spark, rows = self.kept.spark, None
        for v, files in paths.items():
            some = spark.read.schema(schema).parquet(*files).withColumn(VERSION, F.lit(v))
            rows = some if rows is None else rows.unionByName(some)
        if rows is None:
            return spark.createDataFrame([], schema)
        if only is not None:
            rows = rows.join(only.select(key).hint("merge"), key, "left_semi").select(*rows.columns)
        if len(paths) > 1:  # a key's rows are those of the last version that has any
            rows = rows.withColumn("__last", F.max(VERSION).over(Window.partitionBy(key))).where(F.col("__last") == F.col(VERSION)).drop("__last")
        return rows.drop(VERSION)

    def write(self, name: str, df: DataFrame, buckets: list[int], amend: bool = False) -> None:
        """``df`` becomes what the named buckets hold; its rows must belong to them.

        With ``amend`` it replaces the rows of the keys that it has, and no others.
        """
        before = self.before["tables"].get(name, {}).get("buckets", {})
        if amend and any(len(before.get(str(b), [])) >= VERSIONS for b in buckets):
            old = self.read(name, buckets)
            df, amend = old.join(df.select(self.kept.keys[name]).distinct(), self.kept.keys[name], "left_anti").select(*old.columns).unionByName(df), False
        path = self.kept.path(name, self.batch_id)
        dealt = df.withColumn(BUCKET, self.kept.bucket(self.kept.keys[name])).hint("rebalance", BUCKET)  # splits a crowded bucket
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(path)
        present = {int(n.removeprefix(f"{BUCKET}=")) for n in list_names(self.kept.spark, path) if n.startswith(BUCKET)}
        if not present <= set(buckets):
            raise ValueError(f"rows of {name} belong to other buckets than those written")
        held = {b: v for b, v in before.items() if amend or int(b) not in set(buckets)}
        held |= {str(b): [*held.get(str(b), []), self.batch_id] for b in present}
        self.after[name] = {"schema": df.schema.jsonValue(), "buckets": held}

    def commit(self, latest: int | None) -> None:
        seen = [x for x in (latest, self.latest) if x is not None]
        manifest = {"tables": self.before["tables"] | self.after, "latest": max(seen) if seen else None}
        write_file(self.kept.spark, f"{self.kept.folder}/commits/{self.batch_id}.json", json.dumps(manifest).encode())
