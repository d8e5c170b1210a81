"""Store, binary log, lines, access, streams."""

import functools
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions.embed import hashes, hashing, subword
from engram.operators import capture
from engram.operators.search import SearchParams
from engram.schema import EngineError
from engram.sources import access, binlog, lines, service
from engram.sources.store import MemoryStore
from engram.streaming import follow, working


def test_store(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path / "store"))
    n, bad = s.insert([{"data": "one", "tags": ["a"], "type": "semantic", "embedding": [1.0, 0.0]}, {"data": "", "tags": []}, {"data": "two", "tags": ["bad tag"]}, {"data": "three"}], now=100, namespace="x")
    assert n == 2 and bad.count() == 2
    s.update(1, 200, "x", data="uno")
    assert s.get(1, 300).data == "uno" and s.get(1, 300, as_of=150).data == "one" and s.history(1).count() == 2
    with pytest.raises(EngineError, match="IMMUTABLE"):
        s.update(2, 200, data="no")
    with pytest.raises(EngineError, match="NOT_FOUND"):
        s.get(1, 300, namespace="y")
    assert [r.id for r in s.search(SearchParams(embedding=(1.0, 0.0), now=300)).collect()] == [1]
    assert s.usage().first().recall_count == 1
    s.relate(1, 2, "k", 310)
    assert s.traverse(1, now=320).count() == 2
    m = s.snapshot("first")
    s.delete(2, 400)
    with pytest.raises(EngineError, match="NOT_FOUND"):
        s.delete(2, 500)
    assert s.compact(force=True) and s.versions().count() == 1
    assert s.insert([{"data": "four"}], 600)[0] == 1 and s.current().agg(F.max("id")).first()[0] == 3
    r = MemoryStore.restore(spark, str(tmp_path / "store/snapshots/first"), str(tmp_path / "copy"))
    assert r.current().count() == 2 and m["covered"] == 4
    assert s.purge("x") == 1 and s.current().count() == 1


def test_store_operations(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path / "store"))
    day = 86_400_000
    s.insert([{"data": f"{w} fact of the day {i}", "tags": ["x", "y"] if i % 2 else ["x"], "importance": 0.1 * i} for i, w in enumerate("ab cd ef gh".split())] + [{"data": "alone", "tags": ["z"]}], now=0, namespace="n")
    q = SearchParams(query="fact", now=1)
    assert len(s.search(q, False).collect()) == 4 and s.lexicon().sums().first()[:] == (5, 25)
    s.delete(2, 1)
    s.insert([{"data": "late fact"}], now=1, namespace="n")
    assert sorted(r.id for r in s.search(q, False).collect()) == [1, 3, 4, 6]
    small = s.lexicon().compact(str(tmp_path / "small"))
    assert sorted(r.id for r in small.search("fact").collect()) == [1, 3, 4, 6] and small.sums().first()[:] == s.lexicon().sums().first()[:]
    assert s.summarise(8 * day) == (1, 3)
    r = s.get(7, 8 * day)
    assert r.data == "[distilled 3 memories] ab fact of the day 0; ef fact of the day 2; gh fact of the day 3" and r.tags == ["summary", "x", "y"] and abs(r.importance - 0.3) < 1e-9
    assert [(e.to_id, e.kind) for e in r.relationships] == [(1, "summarizes"), (3, "summarizes"), (4, "summarizes")]
    assert sorted(x.id for x in s.visible(8 * day).collect()) == [5, 6, 7] and s.summarise(8 * day) == (0, 0)


def test_working_memory(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path / "store"))
    assert s.remember("s", ["one", "two"], 10, "n") == [1, 2] and s.remember("s", [""], 20, "n") == [3] and s.remember("t", ["other"], 20) == [1]
    assert s.promote("s", 1, 30, "semantic", "n") == 1 and s.get(1, 31).data == "one" and s.get(1, 31).type == "semantic"
    assert sorted((r.session_id, r.local_id) for r in s.working(31).collect()) == [("s", 2), ("s", 3), ("t", 1)]
    with pytest.raises(EngineError, match="NOT_FOUND"):
        s.promote("s", 1, 32)
    with pytest.raises(EngineError, match="INVALID_REQUEST"):  # empty text: refused, and consumed all the same
        s.promote("s", 3, 32, namespace="n")
    with pytest.raises(EngineError, match="NOT_FOUND"):
        s.promote("s", 2, 10 + 3_600_000)
    assert [r.local_id for r in s.working(33).where("session_id = 's'").collect()] == [2]


def test_tokens(spark):
    t, made = access.added(access.token_table(spark, [("s1", "ns", "ro")]), scope="admin", namespace="ignored")
    assert len(made) == 64 and access.resolve(t, made) == (None, "admin") and access.resolve(t, "s1") == ("ns", "ro")
    t = access.revoked(t, access.hashed("s1")[:12])
    assert [tuple(r) for r in access.listed(t).collect()] == [(access.hashed(made)[:12], None, "admin")]
    for bad in ({"scope": "rw"}, {"namespace": "a b"}, {"namespace": "a", "scope": "all"}):
        with pytest.raises(EngineError, match="INVALID_REQUEST"):
            access.added(t, "x", **bad)
    with pytest.raises(EngineError, match="NOT_FOUND"):
        access.revoked(t, "nothing")


def test_follower_resets(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path / "store"))
    s.insert([{"data": "one"}, {"data": "two"}], now=1)
    kind, target = s.versions().schema, str(tmp_path / "replica")
    for _ in range(2):
        follow.follow(spark, s._log(), target, str(tmp_path / "cursor"), kind, s.generation).awaitTermination()
    assert sorted(r.data for r in follow.followed(spark, target, kind, 0).collect()) == ["one", "two"]
    s.delete(1, 2)
    s.compact(force=True)
    follow.follow(spark, s._log(), target, str(tmp_path / "cursor"), kind, s.generation).awaitTermination()
    assert [r.data for r in follow.followed(spark, target, kind, s.generation).collect()] == ["two"] and s.generation == 1


def test_binary_log(spark, tmp_path):
    r = {"id": 7, "type": "semantic", "created": 1, "updated": 2, "importance": 0.5, "tags": ["a", "b"], "vectors": [[1.0, 2.0]], "relationships": [(7, 8, None)], "data": "hé", "agent_id": None}
    frames = [binlog.frame(binlog.encode(r | {"id": i})) for i in range(3)]
    got = list(binlog.scan(b"".join(frames)))
    assert [s for _, s, _ in got] == ["good"] * 3 and got[1][2]["data"] == "hé" and got[1][2]["relationships"] == [[7, 8, None]]
    hurt = bytearray(b"".join(frames))
    hurt[len(frames[0]) + 2] ^= 255
    assert [s for _, s, _ in binlog.scan(bytes(hurt))] == ["good", "hole", "good"]
    hurt = bytearray(b"".join(frames))
    hurt[len(frames[0]) + 20] ^= 255
    assert [s for _, s, _ in binlog.scan(bytes(hurt[:-3]))] == ["good", "corrupt", "torn"]
    (tmp_path / "a.log").write_bytes(b"".join(frames))
    spark.dataSource.register(binlog.BinaryLog)
    assert [x.id for x in spark.read.format("memlog").load(str(tmp_path / "a.log")).orderBy("offset").collect()] == [0, 1, 2]


def test_logs_anywhere_and_of_the_first_version(spark, tmp_path):
    r = {"id": 1, "type": "semantic", "data": "x", "tags": ["t"]}
    payloads = [binlog.encode(r | {"id": i}) for i in range(3)]
    (tmp_path / "a.log").write_bytes(b"".join(map(binlog.frame, payloads)))
    old = b"".join(struct.pack("<II", zlib.crc32(p), len(p)) + p for p in payloads)
    (tmp_path / "b.old").write_bytes(old + struct.pack("<II", 5, 3) + b"bad" + old)
    (tmp_path / "c.log").write_bytes(b"")
    assert [(x.id, x.status, x.tags) for x in binlog.logs(spark, str(tmp_path / "*.log")).orderBy("offset").collect()] == [(i, "good", ["t"]) for i in range(3)]
    assert [x.id for x in binlog.logs(spark, str(tmp_path / "b.old"), first_version=True).orderBy("offset").collect()] == [0, 1, 2]


def test_service(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "store"))
    s = service.Service(store, [("boss", None, "admin"), ("me", "n", "rw"), ("eyes", "n", "ro")])
    do = lambda op, token="me", **k: s.handle({"operation": op, "token": token} | k, 100)
    assert do("ping", None) == {"ok": True, "pong": True} and do("insert", "eyes", data="x")["error"] == "FORBIDDEN" and do("insert", "who", data="x")["error"] == "UNAUTHORIZED"
    assert do("insert", data="a fact of mine", type="semantic", embedding=[1.0, 0.0], request_id="7") == {"ok": True, "inserted": 1, "request_id": "7"}
    assert do("insert", data="")["error"] == "INVALID_REQUEST" and do("insert", records=[{"data": "another fact"}, {"data": ""}])["inserted"] == 1
    assert do("get", id=1)["record"]["data"] == "a fact of mine" and do("get", id=9)["error"] == "NOT_FOUND" and do("get")["error"] == "INVALID_REQUEST"
    assert [h["id"] for h in do("search", query="fact", top_k=5)["hits"]] == [2, 1] and do("count", type="semantic")["n"] == 1
    assert do("relate", id=1, to_id=2, kind="k")["ok"] and [n["id"] for n in do("traverse", id=1)["nodes"]] == [1, 2]
    assert do("token_list")["error"] == "FORBIDDEN" and len(do("token_list", "boss")["tokens"]) == 3
    new = do("token_add", "boss", namespace="n")
    assert do("get", new["token"], id=1)["ok"] and do("token_revoke", "boss", id=new["id"])["revoked"] and do("get", new["token"], id=1)["error"] == "UNAUTHORIZED"
    got = do("stats", "boss")
    assert (got["records"], got["tombstones"], got["lexical_docs"], got["working"]) == (2, 0, 2, 0) and got["errors"] >= 5 and got["requests"] > 10
    assert [json.loads(x)["ok"] for x in s.lines(['{"operation": "ping"}', "no", "[1]", '{"operation": "nope"}'], 1)] == [True, False, False, False]
    assert store.recall(SearchParams(query="fact", now=100)).split("\n")[1:] == ["- [#2] another fact", "- [#1] a fact of mine"] and store.recall(SearchParams(query="zzz", now=100)) == ""
    assert service.main(["gen-token"]) == 0 and service.main([]) == 2


def test_lines(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('"plain"\n{"text": "t"}\n{"message": {"content": [{"text": "deep"}, "s"]}}\nnot json\n')
    assert [r.text for r in lines.transcripts(spark, str(tmp_path / "t.jsonl")).orderBy("line", "pos").collect()] == ["plain", "t", "deep", "s", "not json"]
    (tmp_path / "r.json").write_text('{"operation": "get", "id": 3, "more": 1}\r\nnope\n')
    r = lines.requests(spark, str(tmp_path / "r.json")).collect()
    assert r[0].id == 3 and r[1]._bad == "nope"
    m = spark.createDataFrame([("up", "gauge", "is it up", None, {"a": 'x"y'}, 1.0, 0)], "name string, kind string, help string, suffix string, labels map<string,string>, value double, pos int")
    assert [x.line for x in lines.exposition(m).orderBy("family", "line_no").collect()] == ["# HELP up is it up", "# TYPE up gauge", 'up{a="x\\"y"} 1']


def test_access(spark):
    t = access.token_table(spark, [("s1", "ns", "ro"), ("sha256$" + access.hashed("s2"), None, "admin")])
    assert access.resolve(t, "s1") == ("ns", "ro") and access.resolve(t, "s2") == (None, "admin") and access.resolve(t, "zz") is None
    assert access.refused("insert", ("ns", "ro")) == "FORBIDDEN" and access.refused("stats", ("ns", "rw")) == "FORBIDDEN" and access.refused("nope", None) == "INVALID_REQUEST"
    assert access.refused("search", ("ns", "rw"), rate_ok=False) == "RATE_LIMITED" and access.refused("ping", None) is None and access.refused("traverse", (None, "admin"), phase=2) == "NOT_READY"


def test_embedders():
    assert abs(sum(x * x for x in hashing("deploy the service", 16)) - 1) < 1e-9 and hashing("", 4) == [1.0, 0, 0, 0] == subword("a", 4)
    h = lambda text, salt: functools.reduce(lambda a, c: (a ^ c) * 1099511628211 & (1 << 64) - 1, f"{salt}\0{text}".encode(), 1469598103934665603)
    names = ["deploy", "x", "straße", "^de"]
    assert hashes([n.encode() for n in names], b"tb").tolist() == [h(n, "tb") for n in names]
    v = np.zeros(32)
    v[h("deploys", "b") % 32] += 1 if h("deploys", "s") & 1 else -1
    assert np.allclose(hashing("Deploys!", 32), v)
    for i in range(7):
        g = "^deploys$"[i : i + 3]
        v[h(g, "tb") % 32] += 0.5 if h(g, "ts") & 1 else -0.5
    assert np.allclose(subword("deploys", 32), v / np.linalg.norm(v))


def test_model_replies():
    assert capture.parsed_reply('```json\n["one ", "One", {"text": "two", "tags": ["t"]}, 3, {"fact": "no"}]\n```') == [{"text": "one"}, {"text": "two", "tags": ["t"]}]
    assert capture.parsed_reply('Here: ["a"] as asked') == [{"text": "a"}] == capture.parsed_reply('{"facts": ["a"]}')
    assert capture.parsed_reply("none") == [] == capture.parsed_reply(None) == capture.parsed_reply("[1") and len(capture.parsed_reply(json.dumps([str(i) for i in range(30)]))) == 12
