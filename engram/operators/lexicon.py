"""A stored lexical index: postings by term, kept beside the records and changed by generations.

Postings (term, id, tf, dl) lie in folders by a hash of the term, sorted by term within a file, so that a query reads the
folders of its own terms and, by the files' statistics, little more than these terms' rows. A change writes a generation:
the postings of new images, the ids whose earlier postings are dead, and the difference in the number and the length of
documents. Nothing is rewritten until compact()."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Folders of terms, and the folder of the rows that hold documents' lengths.
BUCKETS, LENGTHS = 64, -1
_KINDS = {"postings": "id long, term string, tf long, dl long, gen int, bucket int", "dead": "id long, gen int", "lengths": "id long, dl long, gen int", "sums": "n long, total long, gen int"}


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def counted(documents: DataFrame, text: str = "data", lengths: bool = False) -> DataFrame:
    """(id, term, tf, dl): each document's terms, counted within a piece of an Arrow batch. With lengths, a row of no term too
    for each document that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.pieces(batches):
            ids, names, times, size = [], [], [], []
            for i, t in zip(*part, strict=True):
                c = X.term_counts(t)
                dl = sum(c.values())
                if lengths and dl:
                    names.append(None)
                    times.append(0)
                names += c.keys()
                times += c.values()
                ids += [i] * (len(names) - len(ids))
                size += [dl] * (len(names) - len(size))
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "term": pa.array(names, pa.string()), "tf": pa.array(times, pa.int64()), "dl": pa.array(size, pa.int64())})

    return X.bounded(documents).select(F.col("id").cast("long").alias("id"), F.col(text).cast("string").alias("data")).mapInArrow(run, "id long, term string, tf long, dl long")


class Lexicon:
    """The index at a path. A single writer, as for the records."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, documents: DataFrame, path: str, text: str = "data") -> Lexicon:
        """An index of documents (id, text)."""
        new = cls(documents.sparkSession, path)
        new._write(documents, 0, text)
        new._sum(0, None)
        return new

    def _read(self, name: str) -> DataFrame:
        kind = _KINDS[name]
        return self.spark.read.schema(kind).parquet(f"{self.path}/{name}") if self._has(name) else self.spark.createDataFrame([], kind)

    def _has(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _write(self, documents: DataFrame, gen: int, text: str) -> None:
        rows = counted(documents, text, lengths=True).withColumn("bucket", F.when(F.col("term").isNull(), LENGTHS).otherwise(bucket_of(F.col("term"))))
        self._sorted(rows, gen, self.path)
        self._read("postings").where((F.col("bucket") == LENGTHS) & (F.col("gen") == gen)).select("id", "dl", "gen").write.mode("append").parquet(f"{self.path}/lengths")

    @staticmethod
    def _sorted(rows: DataFrame, gen: int, path: str) -> None:
        """Appends (id, term, tf, dl, bucket). A folder gets as many files as it has parts of Spark's advisory size, each sorted:
        what a task sorts does not grow with the table."""
        rows.select("id", "term", "tf", "dl", "bucket").hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "id").withColumn("gen", F.lit(gen)).write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")

    def _sum(self, gen: int, gone: DataFrame | None) -> None:
        more = self._read("lengths").where(F.col("gen") == gen).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
        if gone is not None:
            less = gone.agg((-F.count(F.lit(1))).alias("n"), F.coalesce(-F.sum("dl"), F.lit(0)).alias("total"))
            more = more.unionAll(less).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        more.withColumn("gen", F.lit(gen)).write.mode("append").parquet(f"{self.path}/sums")

    def generation(self) -> int:
        return self._read("sums").agg(F.max("gen")).first()[0] or 0

    def apply(self, changed: DataFrame, gone: DataFrame, text: str = "data") -> None:
        """Images that are new or changed (id, text), and ids that are gone, as the next generation."""
        gen = self.generation() + 1
        ids = changed.select("id").unionAll(gone.select("id")).distinct()
        was = self._live(self._read("lengths")).join(ids, "id", "left_semi").select("dl").checkpoint(True)
        ids.withColumn("gen", F.lit(gen)).write.mode("append").parquet(f"{self.path}/dead")
        self._write(changed, gen, text)
        self._sum(gen, was)

    def compact(self, path: str) -> Lexicon:
        """The live rows alone, as a new index at another path."""
        new = Lexicon(self.spark, path)
        self._sorted(self._live(self._read("postings")), 0, path)
        self._live(self._read("lengths")).withColumn("gen", F.lit(0)).write.parquet(f"{path}/lengths")
        new._sum(0, None)
        return new

    def _live(self, rows: DataFrame) -> DataFrame:
        if not self._has("dead"):
            return rows
        dead = self._read("dead").groupBy("id").agg(F.max("gen").alias("died"))
        return rows.join(dead, "id", "left").where(F.col("died").isNull() | (F.col("gen") >= F.col("died"))).drop("died")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(id, term, tf, dl, gen, bucket) of live images: all, or of some terms, for which only their folders are read."""
        rows = self._read("postings").where(F.col("bucket") != LENGTHS)
        if terms is not None:
            buckets = [r.b for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t")).alias("b")).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return self._live(rows)

    def sums(self) -> DataFrame:
        """(n, total) of documents with a term and of their lengths: a row for each generation is read."""
        return self._read("sums").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))

    def search(self, query: str) -> DataFrame:
        """(id, bm25) of documents with a term of the query."""
        terms = X.query_terms(query)
        if not terms:
            return self.spark.createDataFrame([], "id long, bm25 double")
        place = F.array_position(F.array(*map(F.lit, terms)), F.col("term"))
        rows = self.postings(terms).select("id", place.alias("pos"), "tf", "dl")
        df = rows.groupBy("pos").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(self.sums()))  # a row for each term of the query
        part = X.bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("total") / F.col("n"))
        scored = rows.join(F.broadcast(df), "pos").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts"))
        return scored.select("id", F.round(F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]), 9).alias("bm25"))
