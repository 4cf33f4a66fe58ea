"""The log-structured store: an append-only log of operations, newest wins by (tenant, id), tombstones, compaction."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("tenant_id", "capsule_id")
#: So many log batches are sealed into a run, and so many runs merged into one.
SEAL_AT, MERGE_AT = 16, 16


def newest(ops: DataFrame, key=KEY, order: str = "seq") -> DataFrame:
    """The last operation of each key; of equal seq the one that sorts last."""
    last = Window.partitionBy(*key).orderBy(F.desc(order), F.desc("op"))
    return ops.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def live(ops: DataFrame, key=KEY, order: str = "seq") -> DataFrame:
    """The fold of the log: a delete hides a key until it is inserted again."""
    return newest(ops, key, order).filter("op = 'insert'").drop("op")


def without_tombstones(rows: DataFrame, tombstones: DataFrame, key=KEY) -> DataFrame:
    return rows.join(tombstones.select(*key), list(key), "left_anti")


def merged(runs: DataFrame, whole: bool, key=KEY) -> DataFrame:
    """Compaction of runs: the last operation of each key. Tombstones stay unless the merge is of everything."""
    return newest(runs, key).filter("op = 'insert'") if whole else newest(runs, key)


def merged_top_k(frames: DataFrame, k: int) -> DataFrame:
    """Rows of several tiers (probe_id, capsule_id, score, trust_level, valid_from) to one ranking."""
    order = Window.partitionBy("probe_id").orderBy(F.desc("score"), F.desc("trust_level"), F.desc("valid_from"), "capsule_id")
    return frames.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def tier_stats(ops: DataFrame, tier_rows: int = 1024) -> DataFrame:
    """Rows, inserts and deletes of the sealed runs of tier_rows operations each."""
    return ops.groupBy(F.floor(F.col("seq") / tier_rows).alias("tier")).agg(F.count("*").alias("rows"), F.count_if(F.col("op") == "insert").alias("inserts"), F.count_if(F.col("op") == "delete").alias("deletes"))


class MemoryStore:
    """A store in a folder: `log/` of batches, `runs/` sealed from them, `base/`, and `state/<version>`.

    A version names what is read: a base, runs, and log batches already folded into them. The highest version holds; it is
    written aside and renamed to a name of its own, so a crash at any point leaves the last one whole. One writer seals and
    compacts at a time: of two that make the same version one fails. Every call names its tenant; a tenant can neither
    replace nor delete what another owns."""

    def __init__(self, spark: SparkSession, path: str, schema: str, seal_at: int = SEAL_AT, merge_at: int = MERGE_AT):
        self.spark, self.path, self.seal_at, self.merge_at = spark, path.rstrip("/"), seal_at, merge_at
        self.schema = T.StructType.fromDDL(schema)
        self.ops_schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), *self.schema.fields])

    # ---- files

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._at(folder)
        return sorted(n for s in (fs.listStatus(at) if fs.exists(at) else []) if not (n := s.getPath().getName()).startswith(("_", ".")))

    def _publish(self, write, name: str) -> None:
        """Write a folder aside, then rename it; the name must be new."""
        fs, aside = self._fs(), f"{name.split('/')[0]}/_{uuid.uuid4().hex}"
        write(f"{self.path}/{aside}")
        if fs.exists(self._at(name)) or not fs.rename(self._at(aside), self._at(name)):
            fs.delete(self._at(aside), True)
            raise RuntimeError(f"{name} exists: another writer came first")

    def _drop(self, name: str) -> None:
        self._fs().delete(self._at(name), True)

    def _read(self, names: list[str]) -> DataFrame | None:
        return self.spark.read.schema(self.ops_schema).parquet(*(f"{self.path}/{n}" for n in names)) if names else None

    # ---- versions

    def current(self) -> dict:
        versions = self._names("state")
        if not versions:
            return {"version": 0, "base": None, "runs": [], "folded": [], "sealed": 0}
        return json.loads(self.spark.read.text(f"{self.path}/state/{versions[-1]}").first()[0])

    def _advance(self, state: dict, **changes) -> dict:
        new = state | changes | {"version": state["version"] + 1}
        frame = self.spark.createDataFrame([(json.dumps(new),)], "value string").coalesce(1)
        self._publish(lambda p: frame.write.text(p), f"state/{new['version']:012d}")
        return new

    def _pending(self, state: dict) -> list[str]:
        return [n for n in (f"log/{x}" for x in self._names("log")) if n not in set(state["folded"])]

    # ---- operations

    def append(self, ops: DataFrame) -> None:
        rows = ops.select(*self.ops_schema.names)
        self._publish(lambda p: rows.write.parquet(p), f"log/{uuid.uuid4().hex}")
        if len(self._pending(self.current())) >= self.seal_at:
            self.seal()

    def insert(self, rows: DataFrame, seq: int) -> None:
        self.append(rows.withColumns({"seq": F.lit(seq).cast("long"), "op": F.lit("insert")}))

    def delete(self, tenant_id: int, ids: DataFrame, seq: int) -> None:
        own = ids.select(F.lit(tenant_id).cast("long").alias("tenant_id"), "capsule_id", F.lit(seq).cast("long").alias("seq"), F.lit("delete").alias("op"))
        self.append(own.withColumns({f.name: F.lit(None).cast(f.dataType) for f in self.schema.fields if f.name not in own.columns}))

    def ops(self) -> DataFrame:
        state = self.current()
        parts = [self._read(x) for x in ([state["base"]] if state["base"] else [], state["runs"], self._pending(state))]
        parts = [p for p in parts if p is not None]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.ops_schema)

    def rows(self) -> DataFrame:
        return live(self.ops())

    def seal(self) -> None:
        """Fold the pending log batches into a run, then drop their files; at merge_at runs, merge those."""
        state = self.current()
        own = self._pending(state)
        if own:
            run = f"runs/{uuid.uuid4().hex}"
            frame = newest(self._read(own)).select(*self.ops_schema.names).sortWithinPartitions(*KEY)
            self._publish(lambda p: frame.write.parquet(p), run)
            state = self._advance(state, runs=state["runs"] + [run], folded=state["folded"] + own, sealed=state["sealed"] + 1)
        self.truncate()
        if len(state["runs"]) >= self.merge_at:
            self.minor_compact()

    def truncate(self) -> None:
        """Drop log batches that the current version has folded in; after a crash, those of earlier calls too."""
        state = self.current()
        for name in state["folded"]:
            self._drop(name)

    def minor_compact(self) -> None:
        """Merge the runs into one; the base is untouched and tombstones stay, as they may hide rows of it."""
        state = self.current()
        if len(state["runs"]) < 2:
            return
        run = f"runs/{uuid.uuid4().hex}"
        frame = merged(self._read(state["runs"]), whole=False).select(*self.ops_schema.names).sortWithinPartitions(*KEY)
        self._publish(lambda p: frame.write.parquet(p), run)
        self._advance(state, runs=[run])
        for name in state["runs"]:
            self._drop(name)

    def checkpoint(self) -> None:
        """Full compaction: a new base of live rows, which is written and pointed to before anything it replaces is dropped."""
        state, pending = self.current(), None
        pending = self._pending(state)
        if not (pending or state["runs"]):
            return
        base = f"base/{uuid.uuid4().hex}"
        frame = merged(self.ops(), whole=True).select(*self.ops_schema.names).sortWithinPartitions(*KEY)
        self._publish(lambda p: frame.write.parquet(p), base)
        self._advance(state, base=base, runs=[], folded=state["folded"] + pending)
        self.truncate()
        for name in ([state["base"]] if state["base"] else []) + state["runs"]:
            self._drop(name)

    def stats(self) -> DataFrame:
        """tier, files and rows of base, runs and log."""
        state = self.current()
        parts = {"base": [state["base"]] if state["base"] else [], "runs": state["runs"], "log": self._pending(state)}
        rows = [self._read(n).agg(F.count("*").alias("rows")).select(F.lit(t).alias("tier"), F.lit(len(n)).alias("parts"), "rows") for t, n in parts.items() if n]
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], "tier string, parts int, rows long")
