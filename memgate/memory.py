"""The facade: remember, recall and forget for a principal that is fixed at start."""

from __future__ import annotations

import hmac
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memgate.functions import text
from memgate.operators import gates, retrieve
from memgate.operators.store import MemoryStore
from memgate.plans.corpus import fingerprinted

SCHEMA = "tenant_id bigint, capsule_id string, claim string, evidence string, source_id string, context_mask bigint, policy_mask bigint, trust_level int, poison_risk int, valid_from bigint, valid_until bigint, last_verified_at bigint, anchors array<string>, entities array<string>"
SCOPES = ("read", "write", "admin")


def principal_of(keys: str, secret: str) -> Principal:
    """The principal of a secret in a list of "secret:scope[:tenant]" keys; an unknown secret is an error."""
    for key in filter(None, (k.strip() for k in keys.split(","))):
        own, scope, *tenant = key.split(":")
        if scope not in SCOPES:
            raise ValueError(f"unknown scope {scope}")
        if hmac.compare_digest(own, secret):
            return Principal(int(tenant[0]) if tenant else 0, scope)
    raise PermissionError("unknown key")


@dataclass(frozen=True)
class Principal:
    tenant_id: int
    scope: str = "read"
    context_mask: int = 0xFFFF
    policy_mask: int = 0xFFFF

    def need(self, scope: str) -> None:
        if SCOPES.index(self.scope) < SCOPES.index(scope):
            raise PermissionError(f"{scope} scope needed")


class Memory:
    def __init__(self, spark: SparkSession, path: str, principal: Principal):
        self.spark, self.principal, self.store = spark, principal, MemoryStore(spark, path, SCHEMA)

    def remember(self, claims: list[tuple[str, str]], trust: int = 5, now: int | None = None) -> list[str]:
        """Store (claim, evidence) pairs under the principal's tenant and masks; returns their ids."""
        self.principal.need("write")
        now = int(time.time()) if now is None else now
        p = self.principal
        rows = self.spark.createDataFrame(claims, "claim string, evidence string")
        rows = rows.select(F.lit(p.tenant_id).cast("long").alias("tenant_id"), F.substring(F.sha2(F.concat_ws("\0", F.lit(str(p.tenant_id)), "claim", "evidence"), 256), 1, 32).alias("capsule_id"), "claim", "evidence", F.lit("memory").alias("source_id"), F.lit(p.context_mask).cast("long").alias("context_mask"), F.lit(p.policy_mask).cast("long").alias("policy_mask"), F.lit(trust).alias("trust_level"), F.lit(0).alias("poison_risk"), F.lit(now).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_until"), F.lit(now).cast("long").alias("last_verified_at"), text.extract_terms(F.concat_ws(" ", "claim", "evidence")).alias("anchors"), text.extract_terms(F.concat_ws(" ", "claim", "evidence")).alias("entities"))
        ids = [r[0] for r in rows.select("capsule_id").collect()]  # of the caller's own list
        self.store.insert(rows, time.time_ns())
        return ids

    def forget(self, ids: list[str]) -> None:
        self.principal.need("write")
        self.store.delete(self.principal.tenant_id, self.spark.createDataFrame([(i,) for i in ids], "capsule_id string"), time.time_ns())

    def recall(self, query: str, k: int = 8, as_of: int | None = None, trust_floor: int = 0, mode: str = "native") -> DataFrame:
        """Ranked records of the principal's tenant that pass its gates."""
        p = self.principal
        probe = self.spark.createDataFrame([(0, p.tenant_id, query, int(time.time()) if as_of is None else as_of, p.context_mask, p.policy_mask, trust_floor)], "probe_id long, tenant_id long, probe_text string, as_of long, probe_context long, probe_policy long, trust_floor int")
        probe = fingerprinted(probe.withColumn("terms", text.extract_terms(F.col("probe_text"))), "probe_text", "probe_")
        rows = fingerprinted(self.store.rows().filter(F.col("tenant_id") == p.tenant_id), "evidence")
        none = self.spark.createDataFrame([], "from string, tenant_id long, to string, kind string, weight int")
        found = retrieve.retrieve(rows, probe, none, mode=mode, k=k)
        return found.select("rank", "capsule_id", "score").join(rows.select("capsule_id", "claim", "evidence"), "capsule_id").select("rank", "capsule_id", "claim", "evidence", "score").orderBy("rank")

    def insert_many(self, batches: list[list[tuple[str, str]]], trust: int = 5) -> list[str]:
        return self.remember([c for b in batches for c in b], trust)

    def stats(self) -> DataFrame:
        self.principal.need("admin")
        return self.store.stats()

    def compact(self) -> None:
        self.principal.need("admin")
        self.store.checkpoint()

    def healthz(self) -> str:
        return "ok"

    def usage(self) -> DataFrame:
        self.principal.need("admin")
        return self.store.ops().filter(F.col("tenant_id") == self.principal.tenant_id).groupBy("op").count()
