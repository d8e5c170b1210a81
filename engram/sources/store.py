"""The store: an append-only log of versions in Parquet, with generations, snapshots, and the client's operations."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import cut
from ..operators import capture, filters, graph, maintain, recall, search, temporal
from ..operators.lexicon import Lexicon
from ..operators.search import SearchParams
from ..schema import BATCH_MAX, PAGE, PAGE_MAX, RING, RING_TTL, VERSIONS, EngineError, rejection
from ..streaming.working import live_at


class Files:
    """Small text files through Hadoop's file systems, so that a store can lie wherever Spark reads."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._fs(path)
        with_ = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(with_)).decode()
        finally:
            with_.close()

    def write(self, path: str, text: str) -> None:
        """Replaces a file: written beside it, then renamed."""
        fs, p = self._fs(path)
        _, beside = self._fs(path + ".new")
        out = fs.create(beside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        fs.delete(p, False)
        fs.rename(beside, p)


def numbered(rows: DataFrame, order: str, name: str, after: int = 0) -> DataFrame:
    """rows with consecutive numbers in an order. They are sorted in ranges; a range's first number follows from how many
    rows stand before it, so that no task sees all rows."""
    part, at = "__part", "__at"
    rows = cut(rows.orderBy(order).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}))
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first")).orderBy(part).collect()  # a row for each task
    begin, n = [], after
    for r in sizes:
        begin.append((r[part], n + 1 - r["first"]))
        n += r["n"]
    offsets = rows.sparkSession.createDataFrame(begin, f"{part} int, __offset long")
    return rows.join(F.broadcast(offsets), part).withColumn(name, F.col(at) + F.col("__offset")).drop(part, at, "__offset")


class MemoryStore:
    """A single writer's store at a path. Every write appends images; reads derive views from the log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    # the log
    @property
    def generation(self) -> int:
        pointer = f"{self.path}/CURRENT"
        return int(self.files.read(pointer)) if self.files.exists(pointer) else 0

    def _log(self, generation: int | None = None) -> str:
        return f"{self.path}/versions-{self.generation if generation is None else generation}"

    def versions(self) -> DataFrame:
        path = self._log()
        return self.spark.read.schema(VERSIONS).parquet(path) if self.files.exists(path) else self.spark.createDataFrame([], VERSIONS)

    def _top(self) -> tuple[int, int]:
        row = self.versions().agg(F.max("seq"), F.max("id")).first()
        floor = int(self.files.read(f"{self.path}/NEXT_ID")) if self.files.exists(f"{self.path}/NEXT_ID") else 1
        return (row[0] or 0), max(row[1] or 0, floor - 1)

    def append(self, images: DataFrame) -> int:
        """Appends record images (all columns but seq) in order of ids; returns how many."""
        seq, _ = self._top()
        cols = [f.name for f in VERSIONS.fields]
        out = cut(numbered(images, "id", "seq", seq).select(*[F.col(c).cast(VERSIONS[c].dataType).alias(c) for c in cols]))
        n = out.count()
        if n:
            out.write.mode("append").parquet(self._log())
        return n

    # reads
    def current(self) -> DataFrame:
        return temporal.current(self.versions())

    def visible(self, now: int, namespace: str | None = None) -> DataFrame:
        return temporal.visible(self.versions(), now, namespace)

    def get(self, id: int, now: int, namespace: str | None = None, as_of: int | None = None):
        v = self.versions().where(F.col("id") == id)
        v = temporal.as_of(v, as_of) if as_of is not None else temporal.visible(v, now)
        row = (v if namespace is None else v.where(F.col("agent_id") == namespace)).first()
        if row is None:
            raise EngineError("NOT_FOUND", str(id))
        return row

    def history(self, id: int, namespace: str | None = None) -> DataFrame:
        h = temporal.history(self.versions().where(F.col("id") == id))
        last = h.orderBy(F.desc("seq")).first()
        if last is None or namespace is not None and last.agent_id != namespace:
            raise EngineError("NOT_FOUND", str(id))
        return h.orderBy("seq")

    def vectors(self) -> DataFrame:
        return self.current().where(F.size("embedding") > 0).select("id", F.posexplode("embedding").alias("slot", "vec"))

    def search(self, params: SearchParams, track_usage: bool = True) -> DataFrame:
        hits = search.search(self.current(), params, self.vectors(), self.lexicon() if params.query else None)
        if track_usage:
            self.record_recall(hits, params.now)
        return hits

    def recall(self, params: SearchParams, similar: float = 0.0, per_memory: int = 500, budget: int = 2000) -> str:
        """The context of a query: its hits, without those close to a better one, as lines within a budget; empty without hits."""
        hits = cut(numbered(self.search(params).withColumn("__order", F.struct((-F.col("score")).alias("s"), "id")), "__order", "rank").withColumns({"query_id": F.lit(0), "vec": F.get("embedding", F.lit(0))}))
        kept = recall.suppressed(hits.select("query_id", "rank", "id", "vec"), similar).select("id")
        row = recall.context(hits.join(kept, "id"), per_memory=per_memory, budget=budget).first()
        return row.context if row else ""

    def count(self, params: SearchParams) -> DataFrame:
        return search.count(self.current(), params)

    def export(self, namespace: str, after: int = 0, limit: int = PAGE) -> DataFrame:
        if not namespace:
            raise EngineError("INVALID_REQUEST", "namespace")
        return filters.export_page(self.current(), namespace, after, max(1, min(limit, PAGE_MAX)))

    def traverse(self, start: int, depth: int | None = None, namespace: str | None = None, now: int = 0) -> DataFrame:
        live = self.visible(now)
        return graph.traverse(live, graph.exploded(live), start, graph.checked_depth(depth), namespace)

    # usage
    def record_recall(self, hits: DataFrame, now: int) -> None:
        hits.select("id", F.lit(now).cast("long").alias("ts_ms")).write.mode("append").parquet(f"{self.path}/recalls")

    def usage(self) -> DataFrame:
        path = f"{self.path}/recalls"
        kind = "id long, ts_ms long"
        r = self.spark.read.schema(kind).parquet(path) if self.files.exists(path) else self.spark.createDataFrame([], kind)
        return r.groupBy("id").agg(F.count(F.lit(1)).alias("recall_count"), F.max("ts_ms").alias("last_recalled"))

    # writes
    def insert(self, rows: list[dict], now: int, namespace: str | None = None, ttl_ms: int = 0) -> tuple[int, DataFrame]:
        """(stored, rejected rows with a reason). Ids follow the largest; created = updated = now; expiry saturates."""
        if not 1 <= len(rows) <= BATCH_MAX:
            raise EngineError("INVALID_REQUEST", "1 to 1000 records")
        plain = T.StructType([f for f in VERSIONS.fields if f.name not in ("seq", "id")])
        fill = {"type": "episodic", "importance": 0.0, "confidence": 1.0, "tags": [], "embedding": [], "relationships": [], "deleted": False}
        given = [fill | {k: v for k, v in r.items() if k in plain.names} for r in rows]
        for g in given:
            g["embedding"] = [g["embedding"]] if g["embedding"] and not isinstance(g["embedding"][0], (list, tuple)) else g["embedding"]
            g |= {"created": now, "updated": now, "expires_at": min(2**63 - 1, now + ttl_ms) if ttl_ms else 0, "agent_id": namespace if namespace is not None else g.get("agent_id")}
        df = self.spark.createDataFrame([tuple(g.get(n) for n in plain.names) for g in given], T.StructType([T.StructField(f.name, f.dataType) for f in plain.fields])).withColumn("reason", rejection())
        df = df.withColumn("at", F.monotonically_increasing_id())
        _, top = self._top()
        good = numbered(df.where("reason is null"), "at", "id", top).drop("reason", "at")
        return self.append(good), df.where("reason is not null").drop("at")

    def update(self, id: int, now: int, namespace: str | None = None, **patch) -> None:
        """Patches data, importance, confidence and tags of a semantic record; the vector stays."""
        v = temporal.current(self.versions().where(F.col("id") == id))
        row = (v if namespace is None else v.where(F.col("agent_id") == namespace)).first()
        if row is None:
            raise EngineError("NOT_FOUND", str(id))
        if row.type == "episodic":
            raise EngineError("IMMUTABLE", str(id))
        new = v
        for k in ("data", "importance", "confidence", "tags"):
            if patch.get(k) is not None:
                new = new.withColumn(k, F.array(*map(F.lit, patch[k])).cast("array<string>") if k == "tags" else F.lit(patch[k]))
        new = new.withColumn("updated", F.lit(now).cast("long"))
        reason = new.select(rejection().alias("r")).first().r
        if reason:
            raise EngineError(reason)
        self.append(new)

    def _bury(self, rows: DataFrame, now: int) -> int:
        return self.append(rows.withColumns({"deleted": F.lit(True), "updated": F.lit(now).cast("long")}).select(*[f.name for f in VERSIONS.fields if f.name != "seq"]))

    def delete(self, id: int, now: int, namespace: str | None = None) -> None:
        v = temporal.current(self.versions().where(F.col("id") == id))
        if not self._bury(v if namespace is None else v.where(F.col("agent_id") == namespace), now):
            raise EngineError("NOT_FOUND", str(id))

    def delete_by_query(self, params: SearchParams) -> int:
        if params.type is None and not params.tags and (params.start is None or params.end is None):
            raise EngineError("INVALID_REQUEST", "type, tags or a time range is needed")
        return self._bury(self.current().where(params.predicate()), params.now)

    def relate(self, from_id: int, to_id: int, kind: str | None, now: int, namespace: str | None = None) -> None:
        links = self.spark.createDataFrame([(from_id, to_id, kind)], "from_id long, to_id long, kind string")
        new, bad = graph.relate(self.visible(now), links, namespace)
        if (row := bad.first()) is not None:
            raise EngineError(row.reason)
        self.append(new.withColumn("updated", F.lit(now).cast("long")))

    def forget(self, now: int, dry_run: bool = False, **kw) -> int:
        gone = maintain.forget(self.current(), self.usage(), now, **kw)
        return gone.count() if dry_run else self._bury(gone.select(*[f.name for f in VERSIONS.fields if f.name != "seq"]), now)

    def sweep(self, now: int) -> int:
        return self._bury(temporal.expired(self.current(), now), now)

    def consolidate(self, now: int, similarity: float = 0.95, by: tuple[str, ...] = ("agent_id",)) -> tuple[int, int]:
        """(clusters, merged records): survivors get the union of tags and links, the others tombstones."""
        live = self.visible(now).where("type = 'semantic'")
        first = live.where(F.size("embedding") > 0).select("id", F.col("embedding")[0].alias("vec"), *by)
        merged = cut(maintain.merged(live, maintain.clusters(first, similarity, by)))
        if merged.isEmpty():
            return 0, 0
        links = merged.select(F.col("survivor").alias("id"), F.col("tags").alias("t"), F.col("importance").alias("i"), F.col("confidence").alias("c"), F.transform("supersedes", lambda x: F.struct(F.col("survivor").alias("from_id"), x.alias("to_id"), F.lit("supersedes").alias("kind"))).alias("new"))
        old = live.join(merged.select(F.explode("supersedes").alias("id"), "survivor"), "id")
        theirs = old.select("survivor", F.explode("relationships").alias("e")).groupBy("survivor").agg(F.collect_set(F.struct(F.col("survivor").alias("from_id"), F.col("e.to_id").alias("to_id"), F.col("e.kind").alias("kind"))).alias("own")).withColumnRenamed("survivor", "id")
        none = F.expr("cast(array() as array<struct<from_id:bigint,to_id:bigint,kind:string>>)")
        out = live.join(links, "id").join(theirs, "id", "left").withColumns({"tags": F.col("t"), "importance": F.col("i"), "confidence": F.col("c"), "updated": F.lit(now).cast("long"), "relationships": F.array_union(F.array_union(F.coalesce("relationships", none), F.coalesce("own", none)), "new")})
        cols = [f.name for f in VERSIONS.fields if f.name != "seq"]
        buried = cut(old.drop("survivor").select(*cols))
        clusters = self.append(out.select(*cols))
        return clusters, self._bury(buried, now)

    # working memory
    def remember(self, session_id: str, texts: list[str], now: int, namespace: str | None = None) -> list[int]:
        """Adds rows to a session's ring; their ids within the session follow the largest."""
        kind = "session_id string, local_id long, data string, created long, agent_id string"
        top = self._ring_log().where(F.col("session_id") == session_id).agg(F.max("local_id")).first()[0] or 0
        ids = [top + 1 + i for i in range(len(texts))]
        self.spark.createDataFrame([(session_id, i, t, now, namespace) for i, t in zip(ids, texts, strict=True)], kind).write.mode("append").parquet(f"{self.path}/working/added")
        return ids

    def _ring_log(self, name: str = "added") -> DataFrame:
        kind = "session_id string, local_id long, data string, created long, agent_id string" if name == "added" else "session_id string, local_id long"
        path = f"{self.path}/working/{name}"
        return self.spark.read.schema(kind).parquet(path) if self.files.exists(path) else self.spark.createDataFrame([], kind)

    def working(self, now: int, capacity: int = RING, ttl: int = RING_TTL) -> DataFrame:
        """What the rings hold: the last rows of each session, not too old, not taken."""
        return live_at(self._ring_log(), now, capacity, ttl).join(self._ring_log("taken"), ["session_id", "local_id"], "left_anti")

    def take(self, session_id: str, local_id: int, now: int, namespace: str | None = None):
        """Removes a row from its ring and gives it."""
        row = self.working(now).where((F.col("session_id") == session_id) & (F.col("local_id") == local_id)).first()
        if row is None or namespace is not None and row.agent_id not in (None, namespace):
            raise EngineError("NOT_FOUND", f"{session_id}/{local_id}")
        self.spark.createDataFrame([(session_id, local_id)], "session_id string, local_id long").write.mode("append").parquet(f"{self.path}/working/taken")
        return row

    def promote(self, session_id: str, local_id: int, now: int, to_type: str = "episodic", namespace: str | None = None) -> int:
        """Takes a row of working memory and inserts it as a record; it is consumed even if the insert is refused."""
        if not session_id or to_type not in ("episodic", "semantic"):
            raise EngineError("INVALID_REQUEST", "promote")
        row = self.take(session_id, local_id, now, namespace)
        stored, bad = self.insert([{"data": row.data, "type": to_type}], now, namespace if namespace is not None else row.agent_id)
        if not stored:
            raise EngineError(bad.first().reason)
        return self._top()[1]

    def summarise(self, now: int, **kw) -> tuple[int, int]:
        """(summaries, records that they replace): each cluster of old episodic records becomes one semantic record with an
        edge to each source, and the sources tombstones."""
        live = self.visible(now)
        made = cut(capture.distilled(capture.summary_clusters(live, now, **kw), live))
        if made.isEmpty():
            return 0, 0
        _, top = self._top()
        made = cut(numbered(made.withColumn("first", F.col("ids")[0]), "first", "id", top))
        none = {"type": F.lit("semantic"), "created": F.lit(now).cast("long"), "updated": F.lit(now).cast("long"), "confidence": F.lit(1.0), "agent_id": F.col("grp"), "data": F.col("text"), "expires_at": F.lit(0).cast("long"), "deleted": F.lit(False)}
        edges = F.transform("ids", lambda i: F.struct(F.col("id").alias("from_id"), i.alias("to_id"), F.lit("summarizes").alias("kind")))
        images = made.withColumns(none | {"relationships": edges, "embedding": F.array().cast(VERSIONS["embedding"].dataType)})
        sources = cut(live.join(made.select(F.explode("ids").alias("id")), "id").select(*[f.name for f in VERSIONS.fields if f.name != "seq"]))
        n = self.append(images.select(*[f.name for f in VERSIONS.fields if f.name != "seq"]))
        return n, self._bury(sources, now)

    # the lexical index
    def lexicon(self) -> Lexicon:
        """The stored index of the current records, brought up to the log's end."""
        path, seq = f"{self.path}/lexicon-{self.generation}", self._top()[0]
        done = int(self.files.read(f"{path}/SEQ")) if self.files.exists(f"{path}/SEQ") else None
        index = Lexicon(self.spark, path)
        if done is None:
            index = Lexicon.build(self.current().select("id", "data"), path)
        elif done < seq:
            new = cut(temporal.latest(self.versions().where(F.col("seq") > done)).select("id", "data", "deleted"))
            index.apply(new.where("not deleted").select("id", "data"), new.where("deleted").select("id"))
        self.files.write(f"{path}/SEQ", str(seq))
        return index

    def purge(self, namespace: str, dry_run: bool = False) -> int:
        if not namespace:
            raise EngineError("INVALID_REQUEST", "namespace")
        n = self.current().where(F.col("agent_id") == namespace).count()
        if not dry_run:
            self._rewrite(maintain.purge(self.versions(), namespace))
        return n

    def compact(self, force: bool = False) -> bool:
        v = self.versions()
        if not force and not maintain.compaction_worthwhile(v).first().worthwhile:
            return False
        self.files.write(f"{self.path}/NEXT_ID", str(self._top()[1] + 1))
        self._rewrite(maintain.compacted(v))
        return True

    def _rewrite(self, versions: DataFrame) -> None:
        """A new generation beside the old one, then the pointer."""
        new = self.generation + 1
        versions.select(*[f.name for f in VERSIONS.fields]).write.mode("overwrite").parquet(self._log(new))
        self.files.write(f"{self.path}/CURRENT", str(new))

    # snapshots
    def snapshot(self, name: str) -> dict:
        if not name or not all(c.isalnum() or c in "_-." for c in name) or name.startswith("."):
            raise EngineError("INVALID_REQUEST", "name")
        seq, top = self._top()
        self.versions().where(F.col("seq") <= seq).write.mode("errorifexists").parquet(f"{self.path}/snapshots/{name}/versions")
        manifest = {"format": 1, "covered": seq, "next_id": top + 1, "generation": self.generation, "rows": self.spark.read.schema(VERSIONS).parquet(f"{self.path}/snapshots/{name}/versions").count(), "dim": self._dim()}
        self.files.write(f"{self.path}/snapshots/{name}/manifest.json", json.dumps(manifest))
        return manifest

    def _dim(self) -> int:
        """The length of the store's vectors, 0 without any."""
        return self.current().where(F.size("embedding") > 0).agg(F.max(F.size(F.col("embedding")[0]))).first()[0] or 0

    @classmethod
    def restore(cls, spark: SparkSession, snapshot: str, path: str, dim: int | None = None) -> MemoryStore:
        """A new store from a snapshot; an existing one is not overwritten. What does not agree with the manifest is refused:
        the last number, how many rows, and the length of vectors, if one is asked for."""
        files = Files(spark)
        manifest = json.loads(files.read(f"{snapshot}/manifest.json"))
        if manifest.get("format") != 1:
            raise EngineError("INVALID_REQUEST", "format")
        store = cls(spark, path)
        if files.exists(store._log(0)) or files.exists(f"{path}/CURRENT"):
            raise EngineError("INVALID_REQUEST", "the target holds a store")
        v = spark.read.schema(VERSIONS).parquet(f"{snapshot}/versions")
        if dim is not None and manifest["dim"] not in (0, dim):
            raise EngineError("INVALID_REQUEST", "dim")
        last, rows = v.agg(F.max("seq"), F.count(F.lit(1))).first()
        if ((last or 0), rows) != (manifest["covered"], manifest["rows"]):
            raise EngineError("INTERNAL", "the snapshot is not whole")
        v.write.mode("errorifexists").parquet(store._log(0))
        files.write(f"{path}/NEXT_ID", str(manifest["next_id"]))
        return store


def page_of(params: SearchParams, offset: int) -> SearchParams:
    return replace(params, offset=offset)
