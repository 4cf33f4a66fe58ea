"""The service's routes as functions: a request (method, path, body, secret) to (status, answer). Serving HTTP is left to the caller.

Rights come from the secret alone, a scoped key or a signed token; no request can name another tenant or wider masks."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from memgate.memory import SCHEMA, SCOPES, Memory, Principal, principal_of
from memgate.operators import usage

LOG = "seq long, tenant_id long, op string, ms double, returned long"


def signed(claims: dict, secret: bytes) -> str:
    """A JSON web token, HS256."""
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x, separators=(",", ":")).encode()).rstrip(b"=")
    head = part({"alg": "HS256", "typ": "JWT"}) + b"." + part(claims)
    return (head + b"." + base64.urlsafe_b64encode(hmac.digest(secret, head, hashlib.sha256)).rstrip(b"=")).decode()


def principal_of_token(token: str, secret: bytes, now: float | None = None) -> Principal:
    """The principal of a token: tenant, scope and masks are its claims. Other algorithms, wrong signatures and expired tokens are errors."""
    try:
        head, claims, mark = token.encode().split(b".")
        unpack = lambda x: base64.urlsafe_b64decode(x + b"=" * (-len(x) % 4))
        if json.loads(unpack(head))["alg"] != "HS256" or not hmac.compare_digest(unpack(mark), hmac.digest(secret, head + b"." + claims, hashlib.sha256)):
            raise PermissionError("bad token")
        c = json.loads(unpack(claims))
        if c.get("exp") is not None and c["exp"] <= (time.time() if now is None else now) or c.get("scope", "read") not in SCOPES:
            raise PermissionError("bad token")
        return Principal(int(c["tenant"]), c.get("scope", "read"), int(c.get("context_mask", 0xFFFF)), int(c.get("policy_mask", 0xFFFF)))
    except (ValueError, KeyError, TypeError) as e:
        raise PermissionError("bad token") from e


class Service:
    def __init__(self, spark: SparkSession, path: str, keys: str = "", token_secret: bytes | None = None):
        self.spark, self.path, self.keys, self.token_secret = spark, path.rstrip("/"), keys, token_secret

    def principal(self, secret: str) -> Principal:
        return principal_of_token(secret, self.token_secret) if self.token_secret and secret.count(".") == 2 else principal_of(self.keys, secret)

    def log(self):
        """The requests so far; a folder of its own, so that writers never meet."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/requests")
        except Exception as e:  # no request yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LOG)

    def _note(self, tenant: int, op: str, began: float, returned: int) -> None:
        row = (time.time_ns(), tenant, op, 1000 * (time.time() - began), returned)
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/requests")

    def handle(self, method: str, path: str, body: dict | None = None, secret: str = "") -> tuple[int, object]:
        body, began = body or {}, time.time()
        if (method, path) in (("GET", "/healthz"), ("GET", "/readyz")):
            return 200, {"status": "ok"}
        try:
            me = self.principal(secret)
            memory = Memory(self.spark, f"{self.path}/store", me)
            if (method, path) == ("POST", "/v1/query"):
                me.need("read")
                found = memory.recall(body["query"], int(body.get("max_capsules", 8)), body.get("as_of"), int(body.get("trust_floor", 0)), body.get("mode", "native")).collect()  # k rows
                self._note(me.tenant_id, "query", began, len(found))
                return 200, {"capsules": [r.asDict() for r in found]}
            if (method, path) == ("POST", "/v1/memories"):
                ids = memory.remember([(m["claim"], m.get("evidence", "")) for m in body["memories"]], int(body.get("trust", 5)))
                self._note(me.tenant_id, "insert", began, 0)
                return 201, {"ids": ids}
            if method == "DELETE" and path.startswith("/v1/memories/"):
                memory.forget([path.removeprefix("/v1/memories/")])
                self._note(me.tenant_id, "delete", began, 0)
                return 204, None
            me.need("admin")
            own = self.log().filter(F.col("tenant_id") == me.tenant_id)
            if (method, path) == ("GET", "/metrics"):
                return 200, "\n".join(r.line for r in usage.prometheus(self.log()).collect())  # some twenty lines
            if (method, path) == ("GET", "/v1/usage"):
                return 200, [r.asDict() for r in usage.tenant_usage(own).collect()]  # one row
            if (method, path) == ("GET", "/v1/audit/verify"):
                bad = usage.audit_verify(usage.audit_chain(own), own, usage.BLOCK).filter(~F.col("valid")).count()
                return 200, {"valid": bad == 0}
            if (method, path) == ("GET", "/v1/admin/stats"):
                return 200, [r.asDict() for r in memory.stats().collect()]  # three rows
            if (method, path) in (("POST", "/v1/admin/compact"), ("POST", "/v1/admin/checkpoint")):
                memory.compact()
                return 200, {"status": "ok"}
            if (method, path) == ("GET", "/v1/admin/audit/export"):
                return 200, usage.audit_chain(own)
            return 404, {"error": "no such route"}
        except PermissionError as e:
            return 403, {"error": str(e)}
        except (KeyError, ValueError) as e:
            return 400, {"error": str(e)}
