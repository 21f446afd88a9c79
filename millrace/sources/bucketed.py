"""A stored table hashed into buckets by key: a batch rewrites the buckets that its keys fall into, and nothing else.

Each write puts new files beside the old ones and then names them in a new version, a small file that appears whole or not at
all (a rename).  Readers take the newest version, so they see all of a batch or nothing of it; of two writers that started from
one version the second fails and may try again.  A batch that a version has already taken in is not taken in again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.dedupe import latest

#: Names of batches that a version remembers.
REMEMBERED = 1_000


class ConcurrentWrite(RuntimeError):
    """Another writer has made the version that this one was to make."""


class BucketedTable:
    """keys: the columns that decide a row's bucket.  Null keys are keys like others."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs
        root = self._fs.Path(self.path)
        self._files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._fs.Path(f"{self.path}/versions"))

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64) -> BucketedTable:
        """An empty table.  buckets: as many as let one bucket be rewritten by a task or a few; it can't be changed later."""
        table = cls(spark, path)
        kind = spark.createDataFrame([], schema).schema
        table._switch({"version": 0, "schema": kind.json(), "keys": keys, "buckets": buckets, "parts": {}, "batches": []})
        return table

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[:-5]) for s in self._files.listStatus(self._fs.Path(f"{self.path}/versions")) if s.getPath().getName()[:1].isdigit())

    def state(self, version: int | None = None) -> dict:
        """What a version consists of, by default the newest: its schema, keys, folders by bucket, and names of batches."""
        at = self._fs.Path(f"{self.path}/versions/{self.versions()[-1] if version is None else version:012d}.json")
        stream = self._files.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _switch(self, state: dict) -> None:
        folder = f"{self.path}/versions"
        draft = self._fs.Path(f"{folder}/_{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self._fs.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        kinds = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            context.rename(draft, self._fs.Path(f"{folder}/{state['version']:012d}.json"), kinds)
        except Exception as e:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise ConcurrentWrite(f"version {state['version']} exists") from e
            raise

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        state = self.state(version)
        kind = T.StructType.fromJson(json.loads(state["schema"]))
        parts = [f"{self.path}/{p}" for b, p in state["parts"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(kind).parquet(*parts) if parts else self.spark.createDataFrame([], kind)

    def has(self, batch: str | None) -> bool:
        """Whether the newest version has taken in a batch of this name."""
        return batch is not None and batch in self.state()["batches"]

    def _rewrite(self, state: dict, incoming: DataFrame, make: Callable[[DataFrame, DataFrame], DataFrame], batch: str | None) -> bool:
        """Replace the buckets that incoming's keys fall into by make(their rows, incoming)."""
        if batch is not None and batch in state["batches"]:
            return False
        bucket = F.pmod(F.xxhash64(*state["keys"]), F.lit(state["buckets"])).cast("int")
        touched = sorted(r[0] for r in incoming.select(bucket.alias("b")).distinct().collect())  # the number of buckets at most
        name = f"data/{state['version'] + 1:012d}-{uuid.uuid4().hex}"
        parts = dict(state["parts"])
        if touched:
            columns = [f.name for f in T.StructType.fromJson(json.loads(state["schema"])).fields]
            rows = make(self.read(touched, state["version"]), incoming).select(*columns)
            rows.withColumn("_bucket", bucket).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
            made = {int(s.getPath().getName().split("=")[1]) for s in self._files.listStatus(self._fs.Path(f"{self.path}/{name}")) if s.isDirectory()}
            for b in touched:
                parts.pop(str(b), None)
                if b in made:
                    parts[str(b)] = f"{name}/_bucket={b}"
        batches = [*state["batches"], *([batch] if batch is not None else [])][-REMEMBERED:]
        self._switch({**state, "version": state["version"] + 1, "parts": parts, "batches": batches})
        return True

    def merge(self, incoming: DataFrame, order: list[str], batch: str | None = None) -> bool:
        """Upsert: of the rows of a key the one with the largest `order` stays, incoming's on a tie.  False if the batch is in already.

        incoming is worked out once and lies beside the table meanwhile; columns that it lacks become null.
        """
        state = self.state()
        if batch is not None and batch in state["batches"]:
            return False
        aside = f"{self.path}/incoming/{uuid.uuid4().hex}"
        incoming.write.parquet(aside)
        incoming = self.spark.read.schema(incoming.schema).parquet(aside)
        made = lambda old, new: latest(old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True), state["keys"], [*order, "_new"])
        try:
            return self._rewrite(state, incoming, made, batch)
        finally:
            self._files.delete(self._fs.Path(aside), True)

    def replace(self, parents: DataFrame, children: DataFrame, batch: str | None = None) -> bool:
        """Delete all rows of the parents' keys, then insert their children; a parent may have none.

        Children of keys that aren't among the parents are not inserted.
        """
        state = self.state()
        keys = parents.select(*state["keys"]).distinct()
        same = lambda df, how: df.alias("l").join(keys.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in state["keys"]], how)
        return self._rewrite(state, keys, lambda old, _: same(old, "left_anti").unionByName(same(children, "left_semi"), allowMissingColumns=True), batch)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the files that none of the last `keep` versions names, and older versions; readers of those fail from then on."""
        versions = self.versions()
        named = {p.split("/")[1] for v in versions[-keep:] for p in self.state(v)["parts"].values()}
        data, n = self._fs.Path(f"{self.path}/data"), 0
        if self._files.exists(data):
            for s in self._files.listStatus(data):
                if s.getPath().getName() not in named:
                    n += self._files.delete(s.getPath(), True)
        for v in versions[:-keep]:
            self._files.delete(self._fs.Path(f"{self.path}/versions/{v:012d}.json"), False)
        return n
