"""Access: hashed tokens, scopes, namespaces, and the order of checks before an operation."""

from __future__ import annotations

import hashlib
import re
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import AGENT_BYTES, EngineError

SCOPES = ("ro", "rw", "admin")
#: Operations with what they need: (writes, admin only, phase).
OPERATIONS = {
    "ping": (False, False, 1), "stats": (False, True, 0), "token_list": (False, True, 0), "token_add": (True, True, 0), "token_revoke": (True, True, 0), "snapshot": (True, True, 0),
    "insert": (True, False, 1), "get": (False, False, 1), "history": (False, False, 1), "update": (True, False, 2), "delete": (True, False, 1), "export": (False, False, 1),
    "purge": (True, False, 1), "search": (False, False, 2), "count": (False, False, 2), "consolidate": (True, False, 3), "forget": (True, False, 1), "promote": (True, False, 4),
    "relate": (True, False, 4), "traverse": (False, False, 4),
}


def hashed(secret: str) -> str:
    return hashlib.sha256(secret.encode()).hexdigest()


def token_table(spark: SparkSession, tokens: list[tuple[str, str | None, str]]) -> DataFrame:
    """(token, namespace, scope, fingerprint): secrets are kept as hashes only; one in the form sha256$hex is one already."""
    rows = [(s[7:] if s.startswith("sha256$") else hashed(s), ns, scope) for s, ns, scope in tokens]
    return spark.createDataFrame(rows, "token string, namespace string, scope string").withColumn("fingerprint", F.substring("token", 1, 12))


def listed(tokens: DataFrame) -> DataFrame:
    """What may be shown of tokens: no secret, no hash."""
    return tokens.select("fingerprint", "namespace", "scope")


def added(tokens: DataFrame, secret: str | None = None, namespace: str | None = None, scope: str | None = None) -> tuple[DataFrame, str | None]:
    """(the table with a new token, its secret if it was made here). The scope is rw with a namespace and admin without, if
    none is given; admin tokens have no namespace, others need one without white space and control characters."""
    scope = scope or ("rw" if namespace else "admin")
    if scope not in SCOPES or scope != "admin" and (not namespace or len(namespace.encode()) > AGENT_BYTES or any(c <= " " or c == "\x7f" for c in namespace)):
        raise EngineError("INVALID_REQUEST", "token")
    made = None if secret else secrets.token_hex(32)
    new = token_table(tokens.sparkSession, [(secret or made, None if scope == "admin" else namespace, scope)])
    return tokens.unionByName(new), made


def revoked(tokens: DataFrame, fingerprint: str) -> DataFrame:
    """The table without the token of a fingerprint."""
    if tokens.where(F.col("fingerprint") == fingerprint).isEmpty():
        raise EngineError("NOT_FOUND", fingerprint)
    return tokens.where(F.col("fingerprint") != fingerprint)


def resolve(tokens: DataFrame, secret: str | None):
    """(namespace, scope) of a secret, None if it is unknown; without any token all is open."""
    rows = tokens.collect()  # a table of tokens, as configured
    if not rows:
        return None, "admin"
    return next(((r.namespace, r.scope) for r in rows if secret is not None and r.token == hashed(secret)), None)


def scoped(records: DataFrame, tokens: DataFrame) -> DataFrame:
    """Records with each token that may read them."""
    t = tokens.select("token", "namespace", "scope")
    own = records.join(F.broadcast(t.where("namespace is not null")), F.col("agent_id") == F.col("namespace"))
    every = records.join(F.broadcast(t.where("namespace is null")))  # a row for each unrestricted token
    return own.unionByName(every)


def refused(op: str, identity, replica: bool = False, rate_ok: bool = True, phase: int = 4) -> str | None:
    """The first reason to refuse: unknown, unauthorized, read-only token or replica, rate, admin, phase."""
    if op not in OPERATIONS:
        return "INVALID_REQUEST"
    writes, admin, needs = OPERATIONS[op]
    if op != "ping":
        if identity is None:
            return "UNAUTHORIZED"
        if writes and identity[1] == "ro":
            return "FORBIDDEN"
        if writes and replica:
            return "READ_ONLY"
        if not rate_ok and identity[1] != "admin":
            return "RATE_LIMITED"
        if admin and identity[1] != "admin":
            return "FORBIDDEN"
    return "NOT_READY" if needs > phase else None


def namespace_of(path: str, explicit: str | None = None) -> str:
    """A namespace from a folder: its name and eight digits of its hash."""
    if explicit:
        return explicit
    name = re.sub(r"[^A-Za-z0-9_-]", "-", path.rstrip("/").rsplit("/", 1)[-1]) or "root"
    return f"{name}-{hashlib.sha256(path.encode()).hexdigest()[:8]}"
