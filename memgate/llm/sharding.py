"""Sharding by extendible hashing, in DataFrame functions only.

A row's key is 60 bits of MD5 over id and text. The directory is indexed by prefixes of the key; it starts with one
bucket, and only a bucket whose texts exceed the byte limit, and whose keys are not all one, splits on the next bit. The
directory is worked out on byte sums of prefixes, never on rows: first down to `fine` bits, then, for cells that are
still too large, `fine` bits further, until the bits end.

Defined cases: a null text has 0 bytes; rows equal in id and text share a key and cannot part, nor can a text above the
limit: their shard is flagged `oversize`; an empty table has no shards; other columns, whatever their names, pass
through write_shards(). Shards have no order, so ties need no rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memgate.llm._shared import free_name, materialize

BITS = 60
#: A broadcast directory takes at most so many cells (below 10 MB).
BROADCAST_CELLS = 100_000


def key(id_col: str, text_col: str) -> Column:
    name = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def prefix(k, depth) -> Column:
    return F.call_function("shiftright", F.col(k) if isinstance(k, str) else k, (F.lit(BITS) - depth).cast("int"))


def leaves(cells: DataFrame, above: int, fine: int, limit: int) -> DataFrame:
    """Buckets (depth, prefix, bytes, lo, hi: the least and greatest key) over cells of above + fine bits: the largest
    prefixes below `above` bits that fit or hold one key only, and cells that are still to split."""
    bottom = above + fine
    depths = F.explode(F.sequence(F.lit(above), F.lit(bottom)))
    nodes = cells.withColumn("depth", depths).withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(bottom) - F.col("depth")))
    nodes = nodes.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    splits = (F.col("bytes") > limit) & (F.col("lo") < F.col("hi"))
    full = nodes.filter(splits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    child = nodes.withColumn("up", F.call_function("shiftright", "prefix", F.lit(1)))
    # a bucket exists below every one that splits, and at the top
    exists = child.join(full, ["depth", "up"], "left_semi").unionByName(child.filter(F.col("depth") == above))
    return exists.filter(~splits | (F.col("depth") == bottom)).select("depth", "prefix", "bytes", "lo", "hi")


def assign(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, bytes, shard (the bits of its prefix), depth, shard_bytes and oversize for every row."""
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), key(id_col, text_col).alias("key"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes")))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    fine = min(BITS, max(4, math.ceil(math.log2(max(1, total / limit))) + 3))
    above, todo, out = 0, rows, []
    while True:
        depth = min(BITS, above + fine)
        cells = materialize(todo.groupBy(prefix("key", F.lit(depth)).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi")))
        found = materialize(leaves(cells, above, depth - above, limit))
        again = (F.col("bytes") > limit) & (F.col("lo") < F.col("hi")) & F.lit(depth < BITS)
        deeper = found.filter(again)
        # the directory at this depth: the bucket of each cell that holds rows
        at = F.explode(F.sequence(F.lit(above), F.lit(depth)))
        span = cells.select("cell", at.alias("depth")).withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("depth")))
        directory = materialize(span.join(found.filter(~again), ["depth", "prefix"]).select("cell", "depth", "prefix", F.col("bytes").alias("shard_bytes")))
        small = directory.count() <= BROADCAST_CELLS
        keyed = todo.withColumn("cell", prefix("key", F.lit(depth)))
        out.append(keyed.join(F.broadcast(directory) if small else directory, "cell").drop("cell"))
        if deeper.isEmpty():
            break
        heavy = deeper.select(F.col("prefix").alias("cell"))
        todo = materialize(keyed.join(heavy, "cell", "left_semi").drop("cell"))
        above = depth
    placed = out[0]
    for more in out[1:]:
        placed = placed.unionByName(more)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return placed.select("doc_id", "key", "bytes", bits.alias("shard"), F.col("depth").cast("int"), "shard_bytes", (F.col("shard_bytes") > limit).alias("oversize"))


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as Parquet, one folder `shard=b<bits>` for each shard (`_shard` where docs has a column of that name); returns the assignment."""
    placed = materialize(assign(docs, limit, id_col, text_col))
    shard, name = free_name(docs, "shard"), free_name(docs, "key")
    where = placed.select(F.col("key").alias(name), F.concat(F.lit("b"), "shard").alias(shard)).distinct()
    docs.withColumn(name, key(id_col, text_col)).join(where, name).drop(name).repartition(F.col(shard)).write.partitionBy(shard).parquet(path)
    return placed
