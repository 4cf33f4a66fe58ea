"""Records and probes derived from the plain tables, so that every engine can derive the same."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memgate.functions import fingerprint, text

AS_OF, FLOOR, K = 1_770_000_000, 4, 8
#: Fingerprints see the terms of so many characters of evidence, as whole long texts set nearly every bit. All else sees whole texts.
PRINT_CHARS = 120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, on every core: a small table in fewer files than cores, such as one row group, is dealt out first."""
    path = f"{sf_dir}/documents.parquet"
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return rows.repartition(cores) if len(rows.inputFiles()) < cores and size < cores << 27 else rows


def records(docs: DataFrame) -> DataFrame:
    """Memory records of documents: the whole text is the evidence, its first line the claim, whose terms are the entities."""
    i = F.col("doc_id")
    claim = F.coalesce(text.first_line(F.col("text")), F.lit(""))
    return docs.select(
        (i + 1).alias("capsule_id"), (i % 5 + 1).alias("tenant_id"), claim.alias("claim"), F.col("text").alias("evidence"), F.col("source").alias("source_id"),
        F.element_at(F.array(*map(F.lit, (1, 2, 4, 65535))), (i % 4 + 1).cast("int")).alias("context_mask"),
        F.when(i % 17 == 0, 8).otherwise(65535).alias("policy_mask"), F.when(i % 19 == 0, F.lit(2)).otherwise(5 + i % 5).cast("int").alias("trust_level"),
        F.when(i % 19 == 0, 2).when(i % 7 == 3, 1).otherwise(0).alias("poison_risk"), F.when(i % 23 == 0, F.lit(1780000000)).otherwise(1760000000 - i).cast("long").alias("valid_from"),
        F.when(i % 31 == 0, 1761000000).cast("long").alias("valid_until"), (1768000000 + i % 5000).alias("last_verified_at"), (1760000000 + i).alias("observed_at"),
        text.extract_terms(F.concat_ws(" ", claim, "text")).alias("anchors"), text.extract_terms(claim).alias("entities"),
    )


def edges(docs: DataFrame) -> DataFrame:
    """(from, tenant_id, to, kind, weight): within a tenant to the record five before; every 37th contradicts its neighbour in another tenant."""
    i = F.col("doc_id")
    kinds = F.array(
        F.when((i >= 5) & (i % 9 == 0), F.struct((i - 4).alias("to"), F.lit("Supports").alias("kind"))),
        F.when((i >= 10) & (i % 18 == 0), F.struct((i - 9).alias("to"), F.lit("Supports").alias("kind"))),
        F.when((i >= 5) & (i % 37 == 0), F.struct((i - 4).alias("to"), F.lit("Contradicts").alias("kind"))),
        F.when((i >= 5) & (i % 41 == 0), F.struct((i - 4).alias("to"), F.lit("Supersedes").alias("kind"))),
        F.when((i >= 2) & (i % 37 == 1), F.struct(i.alias("to"), F.lit("Contradicts").alias("kind"))),
    )
    return docs.select((i + 1).alias("from"), (i % 5 + 1).alias("tenant_id"), (i % 3 + 1).cast("int").alias("weight"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("e")).select("from", "tenant_id", "e.to", "e.kind", "weight")


def probes(benchmark: DataFrame) -> DataFrame:
    """A probe for each benchmark text; masks differ from probe to probe."""
    i = F.col("item_id")
    return benchmark.select(
        i.alias("probe_id"), (i % 5 + 1).alias("tenant_id"), F.col("text").alias("probe_text"), F.lit(AS_OF).cast("long").alias("as_of"),
        F.element_at(F.array(*map(F.lit, (65535, 1, 6, 65528))), (i % 4 + 1).cast("int")).alias("probe_context"), F.when(i % 2 == 0, 65535).otherwise(1).alias("probe_policy"),
        (i % 3 + FLOOR).cast("int").alias("trust_floor"), text.extract_terms(F.col("text")).alias("terms"),
    )


def fingerprinted(frame: DataFrame, source: str, prefix: str = "", chars: int = PRINT_CHARS) -> DataFrame:
    """frame with `fp` (16 lanes) and `residual` of the terms of the first `chars` characters of a text column."""
    hashed = frame.withColumn("_h", fingerprint.hashes(text.features(text.extract_terms(F.substring(source, 1, chars)))))
    bits = hashed.withColumn("_b", fingerprint.bits(F.col("_h")))
    return bits.withColumns({f"{prefix}fp": fingerprint.lanes(F.col("_b")), f"{prefix}residual": fingerprint.residual(F.col("_h"))}).drop("_h", "_b")
