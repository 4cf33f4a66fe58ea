"""WARC fixity audit with Merkle trees.

Records are ordered by id and digest and laid out one behind the other; each has an ordinal, an offset and a length.
A tree stands over them: a leaf is a record, a node covers a range of records that begins where a record's digest ends
in enough zero bits, and hashes its children's digests with their offset ranges, relative to its own start. As ranges
are cut by content, a record that is lost or added changes the nodes above it and no other. Two replicas are compared
from the root down, and only the ranges of differing nodes are read; a node has FAN children on average.

Equal records are laid out together as one entry with a number of copies. Offsets and ranges come from sums per range
partition, so no task sees all records.

Defined cases: null ids, urls and pages are empty; equal records stand side by side, and of copies that only one replica
has the last ones differ; an empty archive has no root and equals another empty one; an id that repeats with several
contents is compared as a multiset, in the order of digests; pages of any length are hashed whole; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memgate.llm._shared import discard, materialize

FAN = 16


def record_text(id_col: str, url_col: str, body_col: str) -> Column:
    """A WARC response record as text."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    head = [F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")]
    return F.concat(*head, body, F.lit("\r\n\r\n"))


def levels_of(records: int, fan: int = FAN) -> int:
    """Levels of nodes between the leaves and the root."""
    return max(0, math.ceil(math.log(max(records, 1), fan)) - 1)


def layout(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", fan: int = FAN) -> DataFrame:
    """id, digest, length, copies, ordinal and start (offset of the first copy) of every distinct record, and `path`: for
    each level of the tree the digest of the record its range begins with. Written once."""
    record = record_text(id_col, url_col, body_col)
    rows = pages.select(F.col(id_col).alias("id"), F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("long").alias("length"))
    rows = rows.groupBy("id", "digest", "length").agg(F.count("*").alias("copies"))
    ranged = materialize(rows.repartitionByRange("id", "digest").withColumn("part", F.spark_partition_id()))
    levels = levels_of(ranged.count(), fan)
    # ranges of level k begin at digests of which the first k * log2(fan) bits are zero
    head = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    cut = lambda k: F.when(head < F.lit(1 << 60) / F.lit(float(fan**k)), F.col("digest"))
    names = [f"cut{k}" for k in range(1, levels + 1)]
    ranged = ranged.withColumns({n: cut(k + 1) for k, n in enumerate(names)})
    order = ("id", "digest")
    sums = ranged.groupBy("part").agg(F.sum(F.col("length") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"), *(F.max_by(n, F.when(F.col(n).isNotNull(), F.struct(*order))).alias(n) for n in names))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    base = sums.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("r0"), *(F.last(n, True).over(before).alias(f"{n}_0") for n in names))
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumns({"r": F.sum("copies").over(own), "b": F.sum(F.col("length") * F.col("copies")).over(own), **{n: F.last(n, True).over(own) for n in names}})
    path = F.array(*(F.coalesce(n, f"{n}_0", F.lit("")) for n in names)).cast("array<string>")
    start = F.col("b0") + F.col("b") - F.col("length") * F.col("copies")
    out = materialize(placed.join(F.broadcast(base), "part").select("id", "digest", "length", "copies", (F.col("r0") + F.col("r") - F.col("copies")).alias("ordinal"), start.alias("start"), path.alias("path")))
    discard(ranged)
    return out


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels of nodes from the lowest to the root: key (the digest their range begins with), up (that of the node above), digest, start and stop."""
    first = records.select("path").first()
    levels = len(first[0]) if first else 0
    stop = F.col("start") + F.col("length") * F.col("copies")
    node = records.select(F.concat_ws("*", "digest", "copies").alias("digest"), "start", stop.alias("stop"), "path")
    out = []
    for k in range(1, levels + 2):  # the last is the root
        key = F.get("path", F.lit(k - 1)) if k <= levels else F.lit("")
        kids = F.array_sort(F.collect_list(F.struct("start", "stop", "digest")))
        at = F.get(kids, F.lit(0))["start"]
        ranges = F.transform(kids, lambda c: F.concat_ws(":", c["digest"], (c["start"] - at).cast("string"), (c["stop"] - at).cast("string")))
        node = materialize(node.groupBy(key.alias("key")).agg(F.sha2(F.array_join(ranges, ","), 256).alias("digest"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("path").alias("path")), few=True)
        out.append(node)
    return out


def root(levels: list[DataFrame]) -> str | None:
    top = levels[-1].select("digest").take(1)
    return top[0][0] if top else None


def differing(a: list[DataFrame], b: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Keys of the lowest nodes whose digests differ or that one side lacks, of either side, by descent through differing nodes."""
    wrong = None
    for k in range(max(len(a), len(b)) - 1, -1, -1):
        sides = []
        for own, other in ((0, b), (1, a)):
            levels = (a, b)[own]
            if k >= len(levels):  # a lower tree has nothing here: what lies below counts as differing
                sides.append(None)
                continue
            nodes = levels[k]
            if wrong is not None and wrong[own] is not None:
                up = F.get("path", F.lit(k + 1)) if k + 2 < len(levels) else F.lit("")
                nodes = nodes.withColumn("up", up).join(wrong[own].select(F.col("key").alias("up")), "up", "left_semi").drop("up")
            if k < len(other):
                same = other[k].select("key", F.col("digest").alias("there"))
                nodes = nodes.join(same, (nodes["key"] == same["key"]) & (nodes["digest"] == same["there"]), "left_anti")
            sides.append(materialize(nodes.select("key"), few=True))
        wrong = sides
    return wrong[0], wrong[1]


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """id, ordinal, start, length, digest and state of every record: 'same', 'changed' (the replica holds the id with another
    content), 'lost' (the replica lacks it), or 'added' (only the replica has it; ordinal and start are the replica's)."""
    a, b = tree(first), tree(second)
    if root(a) == root(b):
        found = None
    else:
        found = [suspects(own, keys) for own, keys in zip((first, second), differing(a, b))]
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    every = first.select("id", "digest", "length", "ordinal", "start", copy)
    every = every.withColumns({"ordinal": F.col("ordinal") + F.col("copy"), "start": F.col("start") + F.col("length") * F.col("copy")})
    if found is None:
        return every.select("id", "ordinal", "start", "length", "digest", F.lit("same").alias("state"))
    mine, theirs = (materialize(x, few=True) for x in found)
    discard(*a, *b)
    gone, new = excess(mine, theirs), excess(theirs, mine)
    turn = Window.partitionBy("id").orderBy("digest", "copy")
    gone, new = (materialize(x.withColumn("n", F.row_number().over(turn)), few=True) for x in (gone, new))
    null_safe = lambda x, y: x["id"].eqNullSafe(y["id"]) & (x["n"] == y["n"])
    changed = gone.join(new.select("id", "n"), null_safe(gone, new), "left_semi")
    state = materialize(gone.join(changed.select(F.col("digest").alias("d"), F.col("copy").alias("c"), F.lit("changed").alias("is")), (F.col("digest") == F.col("d")) & (F.col("copy") == F.col("c")), "left").select("digest", "copy", F.coalesce("is", F.lit("lost")).alias("state")))
    out = every.join(state, ["digest", "copy"], "left").select("id", "ordinal", "start", "length", "digest", F.coalesce("state", F.lit("same")).alias("state"))
    more = new.join(gone.select("id", "n"), null_safe(new, gone), "left_anti")
    return out.union(more.select("id", F.col("ordinal") + F.col("copy"), F.col("start") + F.col("length") * F.col("copy"), "length", "digest", F.lit("added")))


def suspects(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Records in the ranges of these lowest nodes."""
    low = F.coalesce(F.get("path", F.lit(0)), F.lit(""))
    return records.withColumn("key", low).join(keys, "key", "left_semi").drop("key", "path")


def excess(own: DataFrame, other: DataFrame) -> DataFrame:
    """A row for each copy of own that other does not hold, with `copy` counted from 0."""
    held = other.select("digest", F.col("copies").alias("there"))
    rows = own.join(held, "digest", "left").withColumn("there", F.coalesce("there", F.lit(0))).filter(F.col("copies") > F.col("there"))
    return rows.select("id", "digest", "length", "ordinal", "start", F.explode(F.sequence("there", F.col("copies") - 1)).alias("copy"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write pages as WARC records, one gzip file for each partition, a member for each record, as the format has it."""
    import gzip

    def members(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"member": pa.array([gzip.compress(t.encode()) for t in b.column(0).to_pylist()], pa.binary())})

    # members may stand one behind the other in a file, so rows of binary Parquet keep them apart and in order
    pages.select(record_text(id_col, url_col, body_col).alias("record")).mapInArrow(members, "member binary").write.parquet(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id (text), url, html of the records that write_warc() wrote, or of .warc and .warc.gz files in a folder."""
    import gzip
    import re

    head = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)

    def parse(data: bytes):
        at = 0
        while (m := head.match(data, at)) is not None:
            fields = dict(line.split(b": ", 1) for line in m[1].split(b"\r\n") if b": " in line)
            end = m.end() + int(fields[b"Content-Length"])
            name = fields.get(b"WARC-Record-ID", b"").decode().strip("<>").removeprefix("urn:page:")
            yield name, fields.get(b"WARC-Target-URI", b"").decode(), data[m.end() : end].decode("utf-8", "replace")
            at = end + 4

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            for data in b.column(0).to_pylist():
                got = list(parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                if got:
                    yield pa.RecordBatch.from_pydict({n: pa.array([g[i] for g in got], pa.string()) for i, n in enumerate(("page_id", "url", "html"))})

    def has(suffix: str) -> bool:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return any(s.getPath().getName().endswith(suffix) for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at))

    data = spark.read.parquet(path).select("member") if has(".parquet") else spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("content")
    return data.mapInArrow(rows, "page_id string, url string, html string")
