"""The security boundary: every gate is a filter or an anti join, and nothing downstream sees a row that fails one."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Probes are broadcast up to so many rows; beyond it they are dealt to SALTS tasks a tenant.
BROADCAST_PROBES, SALTS = 10_000, 64
#: Superseded (probe, record) pairs are broadcast up to so many.
BROADCAST_PAIRS = 1_000_000


def context(mask=None) -> Column:
    return F.col("context_mask").bitwiseAND(F.col("probe_context") if mask is None else F.lit(mask)) != 0


def policy(mask=None) -> Column:
    return F.col("policy_mask").bitwiseAND(F.col("probe_policy") if mask is None else F.lit(mask)) != 0


def validity(as_of=None) -> Column:
    at = F.col("as_of") if as_of is None else F.lit(as_of)
    return (F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") >= at))


def trust(floor=None) -> Column:
    return F.col("trust_level") >= (F.col("trust_floor") if floor is None else F.lit(floor))


def hard() -> Column:
    return context() & policy() & validity() & trust()


def authorization() -> Column:
    return context() & policy() & trust()


def by_tenant(records: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, record) pairs of one tenant. Records do not move: few probes are broadcast; many are copied to the SALTS
    parts of their tenant's records, so that a large tenant is no single task."""
    if probes.limit(BROADCAST_PROBES + 1).count() <= BROADCAST_PROBES:
        return records.join(F.broadcast(probes), "tenant_id")
    own = records.withColumn("_salt", F.pmod(F.xxhash64("capsule_id"), F.lit(SALTS)).cast("int"))
    ask = probes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return own.join(ask, ["tenant_id", "_salt"]).drop("_salt")


def admitted(records: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, record) pairs of one tenant that pass the hard gates. The tenant is part of the join key."""
    return by_tenant(records, probes).filter(hard())


GATED = ("capsule_id", "tenant_id", "context_mask", "policy_mask", "trust_level", "valid_from", "valid_until")
ASKED = ("probe_id", "tenant_id", "as_of", "probe_context", "probe_policy", "trust_floor")


def superseded(records: DataFrame, probes: DataFrame, edges: DataFrame) -> DataFrame:
    """(probe_id, capsule_id) of records that a record admitted for the same probe supersedes (one level). Only records with such an edge are paired."""
    up = edges.filter("kind = 'Supersedes'").select(F.col("from").alias("capsule_id"), "to")
    return admitted(records.select(*GATED).join(up, "capsule_id"), probes.select(*ASKED)).select("probe_id", F.col("to").alias("capsule_id")).distinct()


def not_superseded(gated: DataFrame, records: DataFrame, probes: DataFrame, edges: DataFrame) -> DataFrame:
    return gated.join(superseded(records, probes, edges), ["probe_id", "capsule_id"], "left_anti")


def coverage(records: DataFrame, probes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per probe, counts over its tenant of the rows that pass each gate alone; a superseded row fails the temporal one.
    exact_entity_match and anchor_matches are of admitted rows.

    Pairs are counted where they are made: a record carries the probes that it is superseded for, so no pair travels."""
    own, gone = records.select(*GATED, "anchors", "entities"), superseded(records, probes, edges)
    few = gone.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    gone = gone.groupBy("capsule_id").agg(F.collect_set("probe_id").alias("gone"))
    both = by_tenant(own.join(F.broadcast(gone) if few else gone, "capsule_id", "left"), probes.select(*ASKED, "terms"))
    current = validity() & ~F.coalesce(F.array_contains("gone", F.col("probe_id")), F.lit(False))
    passes = context() & policy() & current & trust()
    hits = F.when(passes, F.size(F.array_intersect("anchors", "terms"))).otherwise(0)
    return both.groupBy("probe_id").agg(
        F.count("*").alias("considered"), F.count_if(context()).alias("context_ok"), F.count_if(policy()).alias("policy_ok"), F.count_if(current).alias("temporal_ok"), F.count_if(trust()).alias("trust_ok"),
        F.count_if(passes).alias("admitted"), F.bool_or(passes & F.arrays_overlap("entities", "terms")).alias("exact_entity_match"), F.sum(hits).alias("anchor_matches"),
    )


def violations(returned: DataFrame, records: DataFrame, probes: DataFrame) -> DataFrame:
    """Per gate how many returned (probe_id, capsule_id) rows break it, recomputed from the records: the safety report of a run."""
    rows = returned.select("probe_id", "capsule_id").join(records.withColumnRenamed("tenant_id", "owner"), "capsule_id").join(probes, "probe_id")
    broken = {"tenant": F.col("owner") != F.col("tenant_id"), "context": ~context(), "policy": ~policy(), "trust": ~trust(), "temporal": ~validity(), "poison": F.col("poison_risk") >= 10}
    any_ = F.lit(False)
    for b in broken.values():
        any_ = any_ | b
    return rows.agg(*(F.count_if(b).alias(k) for k, b in broken.items()), F.count_if(any_).alias("total"), F.count("*").alias("rows"))
