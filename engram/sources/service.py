"""Requests against a store: the order of checks, the operations, and a loop over JSON lines. `python -m engram.sources.service`
has health, gen-token, gen-key and request."""

from __future__ import annotations

import json
import secrets
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..operators.search import SearchParams
from ..schema import EngineError
from . import access
from .store import MemoryStore

#: The longest line of a request, in bytes.
LINE_MAX = 16 << 20


class Service:
    """Operations of a store under tokens. tokens: rows of (secret or sha256$hash, namespace, scope)."""

    def __init__(self, store: MemoryStore, tokens: list[tuple[str, str | None, str]] = (), phase: int = 4, replica: bool = False):
        self.store, self.phase, self.replica = store, phase, replica
        self.tokens: DataFrame = access.token_table(store.spark, list(tokens)) if tokens else store.spark.createDataFrame([], "token string, namespace string, scope string, fingerprint string")
        self.log: list[tuple[str, bool]] = []  # (operation, failed) of this service's requests

    def handle(self, request: dict, now: int) -> dict:
        """The answer to a request: ok and what the operation gives, or the error's code."""
        op = request.get("operation")
        try:
            identity = access.resolve(self.tokens, request.get("token"))
            if reason := access.refused(op, identity, self.replica, phase=self.phase):
                raise EngineError(reason, str(op))
            answer = {"ok": True} | getattr(self, f"_{op}")(request, identity[0] if identity else None, now)
        except EngineError as e:
            answer = {"ok": False, "error": e.code}
        except (KeyError, TypeError, ValueError):
            answer = {"ok": False, "error": "INVALID_REQUEST"}
        self.log.append((str(op), not answer["ok"]))
        return answer | ({"request_id": request["request_id"]} if "request_id" in request else {})

    def lines(self, requests: Iterable[str], now: int) -> Iterator[str]:
        """An answer for each line; what is no JSON object, or is too long, is an invalid request."""
        for line in requests:
            try:
                request = json.loads(line) if len(line.encode()) <= LINE_MAX else None
            except ValueError:
                request = None
            yield json.dumps(self.handle(request, now) if isinstance(request, dict) else {"ok": False, "error": "INVALID_REQUEST"})

    def _ping(self, r: dict, ns: str | None, now: int) -> dict:
        return {"pong": True}

    def _stats(self, r: dict, ns: str | None, now: int) -> dict:
        s = self.store
        requests = s.spark.createDataFrame([(op, 0.0) for op, _ in self.log], "op string, us double")
        row = stats.rollup(s.versions(), s.usage(), requests).first().asDict()
        terms = s.lexicon()
        return row | {"lexical_docs": terms.sums().first().n, "lexical_terms": terms.postings().select("term").distinct().count(), "working": s.working(now).count(), "errors": sum(bad for _, bad in self.log)}

    def _token_list(self, r: dict, ns: str | None, now: int) -> dict:
        return {"tokens": [{"id": t.fingerprint, "namespace": t.namespace, "scope": t.scope} for t in access.listed(self.tokens).collect()]}

    def _token_add(self, r: dict, ns: str | None, now: int) -> dict:
        before = {t.fingerprint for t in self.tokens.collect()}
        self.tokens, made = access.added(self.tokens, r.get("new_token"), r.get("namespace"), r.get("scope"))
        new = [t.fingerprint for t in self.tokens.collect() if t.fingerprint not in before]
        return {"id": new[0] if new else None} | ({"token": made} if made else {})

    def _token_revoke(self, r: dict, ns: str | None, now: int) -> dict:
        self.tokens = access.revoked(self.tokens, r["id"])
        return {"revoked": True}

    def _snapshot(self, r: dict, ns: str | None, now: int) -> dict:
        return self.store.snapshot(r["name"])

    def _insert(self, r: dict, ns: str | None, now: int) -> dict:
        rows = r["records"] if "records" in r else [r]
        n, bad = self.store.insert(rows, now, ns if ns is not None else r.get("agent_id"), r.get("ttl_ms", 0))
        if not n and len(rows) == 1:
            raise EngineError(bad.first().reason)
        return {"inserted": n}

    def _get(self, r: dict, ns: str | None, now: int) -> dict:
        return {"record": self.store.get(r["id"], now, ns, r.get("as_of")).asDict(True)}

    def _history(self, r: dict, ns: str | None, now: int) -> dict:
        return {"versions": [x.asDict(True) for x in self.store.history(r["id"], ns).collect()]}

    def _update(self, r: dict, ns: str | None, now: int) -> dict:
        self.store.update(r["id"], now, ns, **{k: r[k] for k in ("data", "importance", "confidence", "tags") if k in r})
        return {}

    def _delete(self, r: dict, ns: str | None, now: int) -> dict:
        if "id" in r:
            self.store.delete(r["id"], now, ns)
            return {"deleted": 1}
        return {"deleted": self.store.delete_by_query(self._params(r, ns, now))}

    def _export(self, r: dict, ns: str | None, now: int) -> dict:
        return {"records": [x.asDict(True) for x in self.store.export(ns or r.get("namespace"), r.get("after", 0), r.get("limit", 100)).collect()]}

    def _purge(self, r: dict, ns: str | None, now: int) -> dict:
        return {"purged": self.store.purge(ns or r["namespace"], bool(r.get("dry_run")))}

    @staticmethod
    def _params(r: dict, ns: str | None, now: int) -> SearchParams:
        same = ("query", "type", "match", "max_importance", "min_score", "top_k", "offset", "order")
        return SearchParams(**{k: r[k] for k in same if k in r}, tags=tuple(r.get("tags") or ()), embedding=tuple(r["embedding"]) if r.get("embedding") else None, start=r.get("start_time"), end=r.get("end_time"), half_life=r.get("half_life_ms"), namespace=ns, now=now)

    def _search(self, r: dict, ns: str | None, now: int) -> dict:
        return {"hits": [x.asDict(True) for x in self.store.search(self._params(r, ns, now)).collect()]}

    def _count(self, r: dict, ns: str | None, now: int) -> dict:
        return self.store.count(self._params(r, ns, now)).first().asDict()

    def _consolidate(self, r: dict, ns: str | None, now: int) -> dict:
        return dict(zip(("clusters", "merged"), self.store.consolidate(now, r.get("similarity", 0.95)), strict=True))

    def _forget(self, r: dict, ns: str | None, now: int) -> dict:
        return {"forgotten": self.store.forget(now, bool(r.get("dry_run")), namespace=ns)}

    def _promote(self, r: dict, ns: str | None, now: int) -> dict:
        return {"id": self.store.promote(r["session_id"], r["working_id"], now, r.get("to_type", "episodic"), ns)}

    def _relate(self, r: dict, ns: str | None, now: int) -> dict:
        self.store.relate(r["id"], r["to_id"], r.get("kind"), now, ns)
        return {}

    def _traverse(self, r: dict, ns: str | None, now: int) -> dict:
        return {"nodes": [x.asDict() for x in self.store.traverse(r["id"], r.get("depth"), ns, now).orderBy("level", "id").collect()]}


def swept(clock: DataFrame, store: MemoryStore, every: str = "1 minute"):
    """A periodic sweep: a stream (of a rate source, say) whose trigger buries what has expired by the batch's latest time."""

    def sweep(batch: DataFrame, _: int) -> None:
        if (now := batch.agg(F.unix_millis(F.max("timestamp"))).first()[0]) is not None:
            store.sweep(now)

    return clock.writeStream.foreachBatch(sweep).trigger(processingTime=every).start()


def main(arguments: list[str]) -> int:
    """health PATH; gen-token; gen-key; request PATH NOW, with requests as lines of the standard input."""
    command, *rest = arguments or ["help"]
    if command in ("gen-token", "gen-key"):
        print(secrets.token_hex(32))
        return 0
    if command not in ("health", "request") or not rest:
        print(main.__doc__)
        return 2
    service = Service(MemoryStore(SparkSession.builder.getOrCreate(), rest[0]))
    if command == "health":
        answer = service.handle({"operation": "ping"}, 0)
        print(json.dumps(answer))
        return 0 if answer["ok"] else 1
    for line in service.lines(sys.stdin, int(rest[1])):
        print(line, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
