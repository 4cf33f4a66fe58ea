"""Readers and writers: record JSON, product JSON lines, segments with a manifest, sealed columns, request and evaluation files."""

from __future__ import annotations

import json
import re
import time
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "capsule_id string, tenant_id long, claim string, evidence string, source_id long, source_uri string, anchors array<string>, entities array<string>, valid_from long, valid_until long, observed_at long, last_verified_at long, context_mask string, policy_mask string, trust_level int, classification int, poison_risk int, relation_edges array<struct<from: string, to: string, kind: string, weight: int>>"
PRODUCT = "memory_id string, session_id string, tenant_id long, turns array<struct<turn_id: long, role: string, text: string>>"
REQUEST = "probe_id long, tenant_id long, query string, as_of long, context_mask string, policy_mask string, trust_floor int, max_capsules int, max_tokens int, mode string"
RUN = "query_id string, benchmark string, mode string, category string, returned array<string>, truth array<string>, recall_1 double, recall_5 double, recall_10 double, build_ns long, retrieval_ns long, violations int, config_hash string, dataset_hash string, split_hash string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of raw records; malformed input fails."""
    return spark.read.schema(RAW).option("multiLine", True).option("mode", "FAILFAST").json(path)


def record_from_json(rows: DataFrame, column: str = "value") -> DataFrame:
    """One record from each JSON text; malformed texts fail."""
    return rows.select(F.from_json(column, RAW, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def record_to_json(records: DataFrame) -> DataFrame:
    """Records as JSON texts; derived columns (fingerprints) are left out, as they are worked out anew."""
    names = [c.split()[0] for c in RAW.split(", ") if ":" not in c.split()[0]]
    own = [c for c in names if c in records.columns]
    return records.select(F.to_json(F.struct(*own)).alias("value"))


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with file and line (from 1); a malformed line is kept in _corrupt, blank lines are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    own = lines.filter(F.trim("value") != "").withColumn("r", F.from_json("value", PRODUCT + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return own.select("file", (F.col("line") + 1).alias("line"), "r.*")


def halves(text: Column) -> Column:
    """struct(hi, lo) of an unsigned number of up to 128 bits, '0x...' or decimal; other text is an error, null stays null."""

    @F.pandas_udf("struct<hi: long, lo: long>")
    def parse(values: pd.Series) -> pd.DataFrame:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        out = []
        for v in values:
            if v is None:
                out.append((None, None))
                continue
            t = v.strip()
            hexa = re.fullmatch("0[xX]([0-9a-fA-F]+)", t)
            n = int(hexa[1], 16) if hexa else int(t) if re.fullmatch("[0-9]+", t) else -1
            if not 0 <= n < 1 << 128:
                raise ValueError(f"not a number of 128 bits: {v!r}")
            out.append((signed(n >> 64), signed(n & (1 << 64) - 1)))
        return pd.DataFrame(out, columns=["hi", "lo"], dtype="Int64")

    return parse(text)


parse_mask = halves


def masks_meet(a: Column, b: Column) -> Column:
    return (a["hi"].bitwiseAND(b["hi"]) != 0) | (a["lo"].bitwiseAND(b["lo"]) != 0)


def source_fold(id_: Column) -> Column:
    """A 128-bit id (halves) as a 64-bit source: itself if it fits, else both halves XOR-ed."""
    return F.when(id_["hi"] == 0, id_["lo"]).otherwise(id_["hi"].bitwiseXOR(id_["lo"]))


def stable_hash64(text: Column) -> Column:
    """The first eight bytes of the hash, little-endian, as a signed number."""
    h = F.sha2(text, 256)
    return F.conv(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1))), 16, -10).cast("long")


def content_hash() -> Column:
    return F.sha2(F.concat_ws("\n", "claim", "evidence"), 256)


def source_hash(records: DataFrame) -> Column:
    return F.sha2(F.coalesce("source_uri", "evidence") if "source_uri" in records.columns else F.col("evidence"), 256)


def manifest(segment: DataFrame) -> DataFrame:
    """tenant_id, epoch, capsule_count and a hash that does not depend on the order of rows: sums of the halves of their hashes."""
    part = lambda i: F.sum(F.conv(F.substring("content_hash", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    return segment.groupBy("tenant_id", "epoch").agg(F.count("*").alias("capsule_count"), F.sha2(F.concat_ws("|", *(part(i).cast("string") for i in range(4))), 256).alias("segment_hash"))


def write_segment(records: DataFrame, path: str, epoch: int) -> DataFrame:
    """Parquet by tenant, sorted by id, and its manifest beside it (<path>.manifest), which is returned: one row for each tenant."""
    spark = records.sparkSession
    own = records.withColumns({"epoch": F.lit(epoch), "content_hash": content_hash(), "source_hash": source_hash(records)})
    own.sortWithinPartitions("tenant_id", "capsule_id").write.mode("overwrite").partitionBy("tenant_id").parquet(path)
    made = manifest(spark.read.parquet(path)).withColumn("build_time_unix", F.lit(int(time.time())))
    made.write.mode("overwrite").json(path.rstrip("/") + ".manifest")
    return spark.read.schema("tenant_id long, epoch int, capsule_count long, segment_hash string, build_time_unix long").json(path.rstrip("/") + ".manifest")


def integrity(records: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """tenant_id, capsule_id and problem: repeated ids, content or source hashes that do not hold, edges that start elsewhere."""
    again = records.groupBy("tenant_id", "capsule_id").count().filter("count > 1").select("tenant_id", "capsule_id", F.lit("repeated id").alias("problem"))
    wrong = [again, records.filter(content_hash() != F.col("content_hash")).select("tenant_id", "capsule_id", F.lit("content hash").alias("problem"))]
    if "source_hash" in records.columns:
        wrong.append(records.filter(source_hash(records) != F.col("source_hash")).select("tenant_id", "capsule_id", F.lit("source hash").alias("problem")))
    if "relation_edges" in records.columns:
        wrong.append(records.filter(F.exists("relation_edges", lambda e: e["from"] != F.col("capsule_id").cast("string"))).select("tenant_id", "capsule_id", F.lit("edge source").alias("problem")))
    if edges is not None:
        loose = edges.join(records.select(F.col("capsule_id").alias("from")), "from", "left_anti")
        wrong.append(loose.select("tenant_id", F.col("from").alias("capsule_id"), F.lit("edge source").alias("problem")))
    return reduce(DataFrame.unionByName, wrong)


def open_segment(spark: SparkSession, path: str, trusted: bool = False) -> DataFrame:
    """A segment's records. Unless trusted, its manifest and every row's hashes are checked first; what fails is an error."""
    rows = spark.read.parquet(path)
    if not trusted:
        known = spark.read.schema("tenant_id long, epoch int, capsule_count long, segment_hash string, build_time_unix long").json(path.rstrip("/") + ".manifest").drop("build_time_unix")
        now = manifest(rows).select(F.col("tenant_id").cast("long").alias("tenant_id"), F.col("epoch").cast("int").alias("epoch"), "capsule_count", "segment_hash")
        if not (known.exceptAll(now).isEmpty() and now.exceptAll(known).isEmpty()):
            raise ValueError(f"{path} is not what its manifest says")
        if (bad := integrity(rows).first()) is not None:
            raise ValueError(f"{path}: {bad['problem']} of {bad['capsule_id']}")
    return rows


def open_segments(spark: SparkSession, paths: list[str], trusted: bool = False) -> DataFrame:
    """Several segments as one table with `tier`, the place in the list; later ones are newer."""
    return reduce(lambda a, b: a.unionByName(b, True), [open_segment(spark, p, trusted).withColumn("tier", F.lit(k)) for k, p in enumerate(paths)])


def segment_paths(spark: SparkSession, folder: str) -> list[str]:
    """Segments of a folder (those with a manifest), the oldest epoch first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().toString() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    own = [n.removesuffix(".manifest") for n in names if n.endswith(".manifest")]
    return sorted(own, key=lambda p: spark.read.schema("epoch int").json(p + ".manifest").agg(F.max("epoch")).first()[0] or 0)


class StaticKey:
    def __init__(self, key: bytes):
        if len(key) not in (16, 24, 32):
            raise ValueError("a key has 16, 24 or 32 bytes")
        self._key = key

    def column(self) -> Column:
        return F.lit(self._key)


class EnvKey(StaticKey):
    """A key in hexadecimal from an environment variable."""

    def __init__(self, name: str):
        import os

        super().__init__(bytes.fromhex(os.environ[name]))


def _key(key) -> Column:
    return key.column() if isinstance(key, StaticKey) else key


def seal(records: DataFrame, key, *columns: str) -> DataFrame:
    """Text columns (evidence, if none is named) encrypted and authenticated with AES-GCM."""
    return records.withColumns({c: F.base64(F.aes_encrypt(F.col(c).cast("binary"), _key(key), F.lit("GCM"))) for c in columns or ("evidence",)})


def unseal(records: DataFrame, key, *columns: str) -> DataFrame:
    """The texts again; null where key or text is wrong."""
    return records.withColumns({c: F.try_aes_decrypt(F.unbase64(c), _key(key), F.lit("GCM")).cast("string") for c in columns or ("evidence",)})


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Query requests as JSON lines."""
    return spark.read.schema(REQUEST).option("mode", "FAILFAST").json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """Evaluated queries as JSON lines."""
    return spark.read.schema(RUN).json(path)


def write_run(run: DataFrame, path: str) -> None:
    run.write.mode("error").json(path)


def export_items(items: DataFrame, path: str) -> None:
    """Items with their documents as JSON lines, for rankers outside."""
    items.write.mode("error").json(path)


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    """query_id, ranked ids, and the line they stand on, so that the last of repeated queries can count."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")).filter(F.trim("value") != "")
    return lines.select("line", F.from_json("value", "query_id string, ranked array<string>").alias("r")).select("line", "r.*")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query_embedding and a map from document to vector."""
    return spark.read.schema("query_id string, query_embedding array<float>, doc_embeddings map<string, array<float>>").json(path)


def write_split(split: DataFrame, path: str) -> None:
    split.write.mode("error").json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id string, split string").json(path)


def synthetic(spark: SparkSession, n: int, tenants: int = 100, words: int = 12, seed: int = 7) -> DataFrame:
    """n records of invented words whose gates follow from their number; every 13th is embargoed in one of four ways."""
    i = F.col("id")
    word = lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(5000)).cast("string"))
    kind = F.when(i % 13 == 0, (i / 13).cast("long") % 4)
    return spark.range(n).select(
        i.alias("capsule_id"), (i % tenants + 1).alias("tenant_id"), F.concat_ws(" ", *(word(k) for k in range(words // 2))).alias("claim"), F.concat_ws(" ", *(word(k) for k in range(words))).alias("evidence"), (i % 50).alias("source_id"),
        F.lit(65535).cast("long").alias("context_mask"), F.when(kind == 3, 8).otherwise(65535).cast("long").alias("policy_mask"), F.when(kind == 0, 1).otherwise(6).alias("trust_level"), F.lit(0).alias("poison_risk"),
        F.when(kind == 1, 1_900_000_000).otherwise(1_700_000_000).cast("long").alias("valid_from"), F.when(kind == 2, 1_710_000_000).cast("long").alias("valid_until"), F.lit(1_750_000_000).cast("long").alias("last_verified_at"), kind.isNotNull().alias("embargoed"),
    )


def audit_export(chain: DataFrame, path: str) -> None:
    """The audit log as JSON lines, in order within each file."""
    chain.repartitionByRange("tenant_id", "seq").sortWithinPartitions("tenant_id", "seq").write.mode("error").json(path)


def dumps(row) -> str:
    return json.dumps(row.asDict(recursive=True), sort_keys=True)


def write_indexes(records: DataFrame, path: str) -> None:
    """The derived tables of a segment beside it: postings of terms, and bands of fingerprints where records have them."""
    root = path.rstrip("/")
    terms = records.select("tenant_id", "capsule_id", F.explode(F.array_union("anchors", "entities")).alias("term"))
    terms.sortWithinPartitions("term", "capsule_id").write.mode("overwrite").partitionBy("tenant_id").parquet(root + ".terms")
    if "fp" in records.columns:
        records.select("tenant_id", "capsule_id", F.posexplode("fp").alias("band", "key")).write.mode("overwrite").partitionBy("tenant_id").parquet(root + ".bands")


def compile_products(products: DataFrame, folder: str, epoch: int, at: int) -> DataFrame:
    """Product conversations to one segment for each view; returns the views' manifests with their paths."""
    from memgate.operators import views

    turns = products.select(F.col("memory_id").alias("conv_id"), "tenant_id", F.explode("turns").alias("t")).select("conv_id", "tenant_id", F.col("t.turn_id").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))
    tenants = turns.select("conv_id", "tenant_id").distinct()
    every = views.five_views(turns).join(tenants, "conv_id")
    out = []
    for view in ("session", "user-turn", "assistant-turn", "turn", "native-capsule"):
        own = views.view_records(every.filter(F.col("view") == view), F.col("tenant_id"), F.lit(at).cast("long"))
        out.append(write_segment(own, f"{folder.rstrip('/')}/{view}", epoch).withColumns({"view": F.lit(view), "path": F.lit(f"{folder.rstrip('/')}/{view}")}))
    return reduce(DataFrame.unionByName, out)


def frozen_problems(frozen: dict, now: dict) -> list[str]:
    """Settings of a run that differ from the frozen ones."""
    return sorted(k for k in frozen.keys() | now.keys() if frozen.get(k) != now.get(k))


def embed(rows: DataFrame, model, column: str = "text") -> DataFrame:
    """rows with `embedding` by a model (a list of texts to a list of vectors), asked for a batch at a time."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in model([t or "" for t in texts])])

    return rows.withColumn("embedding", vectors(F.col(column)))


def seeded_words(seed: int, n: int, vocabulary: int = 5000) -> list[str]:
    """n invented words by a linear congruential generator that wraps at 64 bits."""
    out, x = [], seed
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(f"w{(x >> 33) % vocabulary}")
    return out
