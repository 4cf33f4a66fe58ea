"""python -m memgate.cli: compile, query, inspect and validate segments, evaluate benchmark files, and compare runs."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memgate.functions import text
from memgate.operators import evaluation, harness, retrieve
from memgate.plans.corpus import fingerprinted
from memgate.sources import adapters, records


def prepared(raw: DataFrame) -> DataFrame:
    """Raw records as retrieval takes them: given anchors and entities are tokenised again, missing ones derived, masks read."""
    every = text.extract_terms(F.concat_ws(" ", "claim", "evidence"))
    again = lambda c: text.extract_terms(F.array_join(c, " "))
    anchors = F.when(F.size("anchors") > 0, again("anchors")).otherwise(every)
    out = raw.withColumn("anchors", anchors)
    out = out.withColumn("entities", F.when(F.size("entities") > 0, again("entities")).otherwise(F.col("anchors")))
    masks = {c: records.parse_mask(F.col(c))["lo"] for c in ("context_mask", "policy_mask")}
    return fingerprinted(out.withColumns(masks), "evidence")


def edges_of(raw: DataFrame) -> DataFrame:
    return raw.select("tenant_id", F.explode("relation_edges").alias("e")).select(F.col("e.from").alias("from"), "tenant_id", F.col("e.to").alias("to"), F.col("e.kind").alias("kind"), F.col("e.weight").alias("weight"))


def probes_of(requests: DataFrame) -> DataFrame:
    masks = {f"probe_{k}": records.parse_mask(F.coalesce(F.col(f"{k}_mask"), F.lit("0xffff")))["lo"] for k in ("context", "policy")}
    asked = requests.withColumns(masks).withColumns({"as_of": F.coalesce("as_of", F.unix_timestamp()), "trust_floor": F.coalesce("trust_floor", F.lit(0)), "terms": text.extract_terms(F.col("query"))})
    return fingerprinted(asked.withColumnRenamed("query", "probe_text"), "probe_text", "probe_").drop("context_mask", "policy_mask")


def compile_(spark, a) -> None:
    raw = records.read_records(spark, a.input)
    print(json.dumps([r.asDict() for r in records.write_segment(raw, a.segment, a.epoch).collect()]))


def query(spark, a) -> None:
    raw = records.open_segments(spark, a.segments)
    found = retrieve.retrieve(prepared(raw), probes_of(records.read_requests(spark, a.requests)), edges_of(raw), mode=a.mode, k=a.k)
    for row in found.select("probe_id", "rank", "capsule_id", "score").orderBy("probe_id", "rank").toLocalIterator():
        print(records.dumps(row))


def inspect(spark, a) -> None:
    for row in records.open_segments(spark, a.segments, trusted=True).groupBy("tier", "tenant_id", "epoch").count().orderBy("tier", "tenant_id").toLocalIterator():
        print(records.dumps(row))


def validate(spark, a) -> None:
    bad = [records.dumps(r) for p in a.segments for r in records.integrity(records.open_segment(spark, p, trusted=True)).limit(100).collect()]
    print("\n".join(bad) or "ok")
    if bad:
        raise SystemExit(1)


def evaluate(spark, a) -> None:
    items = harness.of_categories(adapters.read_benchmark(spark, a.input, a.benchmark), a.categories, a.limit)
    docs = adapters.item_docs(items).withColumn("terms", text.harness_terms(F.col("text")))
    asked = items.select("query_id", text.harness_terms(F.col("question")).alias("terms"))
    both = docs.join(asked.withColumnRenamed("terms", "asked"), "query_id")
    own = both.select("query_id", "parent", F.size(F.array_intersect("terms", "asked")).cast("double").alias("score"))
    best = own.groupBy("query_id", "parent").agg(F.max("score").alias("score")).withColumnRenamed("parent", "doc_id")
    truth = items.select("query_id", F.explode("truth").alias("doc_id"))
    rows = evaluation.metrics(evaluation.ranked(best, a.k), truth).join(items.select("query_id", "category"), "query_id")
    print(harness.markdown(evaluation.summary(rows, "category").orderBy("category"), f"{a.benchmark}: overlap"))


def runs_of(spark, a) -> list[DataFrame]:
    return [records.read_run(spark, p) for p in a.runs]


def compare(spark, a) -> None:
    """Means of each run, and of each category of it."""
    for path, run in zip(a.runs, runs_of(spark, a)):
        means = [F.round(F.avg(f"recall_{k}"), 4).alias(f"recall_{k}") for k in evaluation.RECALLS]
        print(harness.markdown(run.groupBy("category").agg(F.count("*").alias("n"), *means).orderBy("category"), path))


def prove(spark, a) -> None:
    candidate, baseline = runs_of(spark, a)
    print(json.dumps(harness.proof(candidate, baseline).first().asDict()))


def diagnose(spark, a) -> None:
    """Missed ids of each query, and how many queries miss some."""
    for run in runs_of(spark, a):
        missed = run.select("query_id", F.array_except("truth", "returned").alias("missed")).filter(F.size("missed") > 0)
        print(json.dumps({"queries": run.count(), "with misses": missed.count()}))
        for row in missed.orderBy("query_id").toLocalIterator():
            print(records.dumps(row))


def safety(spark, a) -> None:
    for run in runs_of(spark, a):
        print(json.dumps({"violations": run.agg(F.sum("violations")).first()[0] or 0}))


def fuse(spark, a) -> None:
    """Runs fused by reciprocal ranks; the first decides which queries there are."""
    lists = [r.select("query_id", F.posexplode("returned").alias("pos", "item")).withColumn("rank", F.col("pos") + 1) for r in runs_of(spark, a)]
    for row in retrieve.fused_runs(*lists).orderBy("query_id", F.desc("rrf"), "item").toLocalIterator():
        print(records.dumps(row))


def split(spark, a) -> None:
    records.write_split(harness.split(runs_of(spark, a)[0].select("query_id"), a.dev, a.seed), a.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser("memgate")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, run in (("compile", compile_), ("query", query), ("inspect", inspect), ("validate", validate), ("eval", evaluate), ("compare", compare), ("prove", prove), ("diagnose", diagnose), ("safety", safety), ("fuse", fuse), ("split", split)):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        if name == "compile":
            p.add_argument("input")
            p.add_argument("segment")
            p.add_argument("--epoch", type=int, default=1)
        elif name == "eval":
            p.add_argument("benchmark", choices=sorted(adapters.PARSERS))
            p.add_argument("input")
            p.add_argument("--categories", nargs="*", default=[])
            p.add_argument("--limit", type=int)
            p.add_argument("--k", type=int, default=10)
        elif name in ("compare", "prove", "diagnose", "safety", "fuse", "split"):
            if name == "split":
                p.add_argument("out")
                p.add_argument("--dev", type=int, default=50)
                p.add_argument("--seed", type=int, default=42)
            p.add_argument("runs", nargs=2 if name == "prove" else "+")
        else:
            if name == "query":
                p.add_argument("requests")
                p.add_argument("--mode", default="native", choices=retrieve.MODES)
                p.add_argument("--k", type=int, default=8)
            p.add_argument("segments", nargs="+")
    a = parser.parse_args(argv)
    a.run(spark or SparkSession.builder.appName("memgate").getOrCreate(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
