"""Capture of salient sentences, extraction and supersession of facts, summaries."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import text as X
from ..schema import TAGS_MAX

#: Of superseded(): facts of each side of a cell, characters of a prefix that is a key, pairs and cells of a task.
SIDE, PREFIX, PAIRS, CELLS = 512, 64, 4_000_000, 200_000


def sentence_rows(texts: DataFrame, *keys: str) -> DataFrame:
    """A row for each sentence unit with its place."""
    return texts.select(*keys, F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


def candidates(texts: DataFrame, key: str, order: str, min_salience: float = 0.5) -> DataFrame:
    """(key, text, salience, tags) to be stored: prose with a salient phrase, the first of equal ones within a key, none
    that is marked as not to be kept."""
    s = sentence_rows(texts, key, order).where(~X.looks_like_code(F.col("sentence"))).withColumn("salience", X.salience(F.col("sentence"))).where("salience > 0")
    first = s.groupBy(key, F.lower("sentence").alias("low")).agg(F.min(F.struct(order, "pos", "sentence", "salience")).alias("s"))
    out = first.select(key, F.col("s.sentence").alias("text"), F.col("s.salience").alias("salience"))
    return out.where(~X.ephemeral(F.col("text")) & (F.col("salience") >= min_salience)).withColumn("tags", X.inferred_tags(F.col("text")))


def facts(texts: DataFrame, key: str, order: str, limit: int = 12) -> DataFrame:
    """(key, n, fact): lines of four words or more, their first 24 words, the first of equal ones, `limit` for each key."""
    lines = texts.select(key, order, F.posexplode(F.split("text", r"\n")).alias("pos", "line"))
    words = F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+")
    gist = lines.withColumn("w", words).where(F.size("w") >= 4).select(key, order, "pos", F.concat_ws(" ", F.slice("w", 1, 24)).alias("fact"))
    first = gist.groupBy(key, F.lower("fact").alias("low")).agg(F.min(F.struct(order, "pos", "fact")).alias("s"))
    w = Window.partitionBy(key).orderBy(f"s.{order}", "s.pos")
    return first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select(key, "n", F.col("s.fact").alias("fact"))


def superseded(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new_id, old_id): old facts that begin with the first two words of a new one and differ from it.

    new, old: (id, text). Different subjects of new facts meet different heads of old ones, by all their words but the last
    and a prefix of that. What is then listed are pairs by their meaning, as many as a subject's new facts times its old ones:
    they are dealt out in cells of about SIDE by SIDE. Facts are held as digests, texts leave the first stage as these."""
    low, digest = F.lower(F.trim("text")), lambda c: F.unhex(F.sha2(c, 256))
    n = new.select(F.col("id").alias("new_id"), low.alias("nf")).select("new_id", F.concat_ws(" ", F.slice(F.split("nf", r"\s+", 3), 1, 2)).alias("subject"), digest("nf").alias("nd"))
    o = old.select(F.col("id").alias("old_id"), low.alias("cl")).select("old_id", F.regexp_extract("cl", r"^\S* ?\S*", 0).alias("head"), digest("cl").alias("od"))
    n, o = cut(n.where("subject != ''")), cut(o.where("head != ''"))
    blocks = F.ceil(F.col("count") / SIDE).cast("int")
    subjects, heads = n.groupBy("subject").count().withColumn("bn", blocks).withColumnRenamed("count", "cn"), o.groupBy("head").count().withColumn("bo", blocks).withColumnRenamed("count", "co")

    # a subject of two words has its first one whole in a head, one of a single word is the beginning of a head's first word
    two = lambda c: F.contains(c, F.lit(" "))
    first = lambda c: F.substring_index(c, " ", 1)
    rest = lambda c: F.substring(c, F.length(first(c)) + 2, F.length(c))
    begun = lambda c, least: F.transform(F.sequence(F.lit(least), F.least(F.length(c), F.lit(PREFIX))), lambda i: F.substring(c, F.lit(1), i))
    word = F.col("head")
    asked = subjects.select("*", F.when(two(F.col("subject")), F.xxhash64(first(F.col("subject")))).otherwise(0).alias("k1"), two(F.col("subject")).alias("k2"), F.substring(F.when(two(F.col("subject")), rest(F.col("subject"))).otherwise(F.col("subject")), 1, PREFIX).alias("k3"))
    with_two = heads.where(two(word)).select("*", F.xxhash64(first(word)).alias("k1"), F.lit(True).alias("k2"), F.explode(begun(rest(word), 0)).alias("k3"))
    with_one = heads.where(first(word) != "").select("*", F.lit(0).cast("long").alias("k1"), F.lit(False).alias("k2"), F.explode(begun(first(word), 1)).alias("k3"))
    met = with_two.unionAll(with_one).join(asked, ["k1", "k2", "k3"]).where(F.startswith("head", F.col("subject")))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cells = met.select("subject", "head", "bo", (F.col("cn") * F.col("co") / F.col("bn") / F.col("bo")).alias("pairs"), each("bn").alias("i")).select("subject", "head", "i", "pairs", each("bo").alias("j"))
    cells = cut(cells.withColumn("cell", F.monotonically_increasing_id()))

    size = cells.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("pairs")).first()
    parts = min(max(new.sparkSession.sparkContext.defaultParallelism, int(size.pairs) // PAIRS + size.n // CELLS + 1), 10_000)
    news = n.join(subjects, "subject").select("subject", F.pmod(F.xxhash64("new_id"), "bn").cast("int").alias("i"), "new_id", "nd")
    olds = o.join(heads, "head").select("head", F.pmod(F.xxhash64("old_id"), "bo").cast("int").alias("j"), "old_id", "od")
    left = cells.select("cell", "subject", "i").join(news, ["subject", "i"]).select("cell", "new_id", "nd").repartition(parts, "cell")
    right = cells.select("cell", "head", "j").join(olds, ["head", "j"]).select("cell", "old_id", "od").repartition(parts, "cell")
    return left.join(right, "cell").where("nd != od").select("new_id", "old_id")


def summary_clusters(records: DataFrame, now: int, group: str = "agent_id", max_importance: float = 0.6, min_age: int = 604_800_000, least: int = 3, most: int = 20, runs: int = 20) -> DataFrame:
    """(grp, tag, ids) of disjoint clusters: tags in order, each takes the oldest records that no earlier tag took.

    Only runs * most records of a namespace can be taken, so of each tag its oldest (runs + 1) * most decide, and of the
    tags with enough records the first runs + TAGS_MAX * runs * most: a tag is passed over only where a record of it was
    taken. What a namespace brings together is bounded by these two, whatever its size."""
    r = records.where((F.col("type") == "episodic") & (F.col("importance") <= max_importance) & (F.lit(now) - F.col("created") >= min_age) & ~F.array_contains("tags", "summary"))
    t = r.select(F.col(group).alias("grp"), "id", "created", F.explode(F.array_distinct("tags")).alias("tag"))
    oldest = Window.partitionBy("grp", "tag").orderBy("created", "id")
    t = t.withColumn("n", F.row_number().over(oldest)).where(F.col("n") <= (runs + 1) * most)
    tags = t.groupBy("grp", "tag").agg(F.array_sort(F.collect_list(F.struct("created", "id"))).alias("m")).where(F.size("m") >= least)
    tags = tags.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("tag"))).where(F.col("k") <= runs + TAGS_MAX * runs * most)
    listed = tags.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("tag", F.col("m.id").alias("ids")))).alias("tags"))
    none = F.expr("cast(array() as array<struct<tag:string,ids:array<bigint>>>)")

    def next_tag(done, tag):
        free = F.slice(F.array_except(tag["ids"], F.flatten(F.transform(done, lambda d: d["ids"]))), 1, most)
        good = (F.size(free) >= least) & (F.size(done) < runs)
        return F.when(good, F.concat(done, F.array(F.struct(tag["tag"].alias("tag"), free.alias("ids"))))).otherwise(done)

    return listed.select("grp", F.inline(F.aggregate("tags", none, next_tag)))


def summaries(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """(grp, tag, text, ids): the first six words of each member in order, with a count in front, 400 characters."""
    x = clusters.select("grp", "tag", F.posexplode("ids").alias("pos", "id")).join(records.select("id", "data"), "id").where("data is not null and data != ''")
    gist = F.concat_ws(" ", F.slice(F.split(F.regexp_replace("data", r"^\s+|\s+$", ""), r"\s+"), 1, 6))
    g = x.select("grp", "tag", "pos", "id", gist.alias("g")).groupBy("grp", "tag").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "g"))).alias("m"))  # at most a cluster
    text = F.substring(F.concat(F.lit("[distilled "), F.size("m").cast("string"), F.lit(" memories] "), F.concat_ws("; ", F.col("m.g"))), 1, 400)
    return g.select("grp", "tag", text.alias("text"), F.col("m.id").alias("ids"))


def distilled(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """(grp, tag, text, ids, tags, importance): the record that a cluster becomes. Its tags are those of its sources and
    `summary` (the first TAGS_MAX in order), its importance their largest."""
    x = clusters.select("grp", "tag", F.explode("ids").alias("id")).join(records.select("id", "tags", "importance"), "id")
    tags = F.slice(F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list("tags")), F.array(F.lit("summary"))))), 1, TAGS_MAX)  # at most a cluster
    fields = x.groupBy("grp", "tag").agg(tags.alias("tags"), F.max("importance").alias("importance"))
    return summaries(clusters, records).join(fields, ["grp", "tag"])


#: What a model's reply may hold besides its list.
_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")


def parsed_reply(reply: str | None, limit: int = 12) -> list[dict]:
    """Facts of a model's reply: a JSON list of texts or of objects with a text, alone, in a fence, or amid other words; else
    nothing. Texts are trimmed, the first of equal ones is kept."""
    body = _FENCE.sub("", reply or "")
    for start, end in ((0, len(body)), (body.find("["), body.rfind("]") + 1)):
        try:
            found = json.loads(body[start:end]) if 0 <= start < end else None
        except ValueError:
            found = None
        if isinstance(found, dict):
            found = next((v for v in found.values() if isinstance(v, list)), None)
        if isinstance(found, list):
            break
    out: dict[str, dict] = {}
    for x in found if isinstance(found, list) else []:
        fact = {"text": x} if isinstance(x, str) else x if isinstance(x, dict) else {}
        if isinstance(fact.get("text"), str) and (text := fact["text"].strip()):
            out.setdefault(text.lower(), fact | {"text": text})
    return list(out.values())[:limit]
