"""Line sources and sinks: requests and records as JSON lines, transcripts, metrics as text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "operation string, request_id string, token string, id long, agent_id string, type string, data string, tags array<string>, importance double, confidence double, embedding array<float>, query string, top_k int, offset int, start_time long, end_time long, match string, ttl_ms long, as_of long, depth int, to_id long, kind string, _bad string"


def requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A row for each line; what is not JSON is in _bad. CRLF is tolerated, unknown fields are left out."""
    reader = (spark.readStream if stream else spark.read).schema(REQUEST).option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE")
    return reader.json(path)


def record_json(df: DataFrame, embeddings: bool = True) -> Column:
    """A record as JSON: one vector is `embedding`, several are `embeddings`; nulls are left out."""
    cols = [c for c in df.columns if c not in ("embedding", "seq")]
    fields = [F.col(c) for c in cols]
    if embeddings and "embedding" in df.columns:
        fields += [F.when(F.size("embedding") == 1, F.col("embedding")[0]).alias("embedding"), F.when(F.size("embedding") > 1, F.col("embedding")).alias("embeddings")]
    return F.to_json(F.struct(*fields))


def texts_of(entry) -> list[str]:
    """Texts of a transcript entry in order: strings, and what lies under text, content and message, at any depth."""
    todo, out = [entry], []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        inner = x if isinstance(x, list) else []
        if isinstance(x, dict):
            inner = [x[k] for k in ("text", "content", "message") if k in x and (k != "text" or isinstance(x[k], str))]
        todo += inner[::-1]
    return out


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, pos, text) of a folder of transcripts; a line that is not JSON is a text."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value").where("trim(value) != ''")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for file, line, value in f.itertuples(index=False):
                try:
                    found = texts_of(json.loads(value))
                except ValueError:
                    found = [value]
                rows += [(file, line, i, t) for i, t in enumerate(found) if t.strip()]
            yield pd.DataFrame(rows, columns=["file", "line", "pos", "text"])

    return raw.mapInPandas(run, "file string, line long, pos long, text string")


def exposition(metrics: DataFrame) -> DataFrame:
    """Text lines (family, line_no, line) from (name, kind, help, suffix, labels map, value): a head for each family, then
    its samples in order of `pos`."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.concat_ws(",", F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))))
    value = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    sample = F.concat(F.col("name"), F.coalesce("suffix", F.lit("")), F.when(pairs != "", F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(""), F.lit(" "), value)
    body = metrics.select(F.col("name").alias("family"), (F.col("pos") + 2).alias("line_no"), sample.alias("line"))
    heads = metrics.select("name", "kind", "help").distinct()
    help_ = heads.select(F.col("name").alias("family"), F.lit(0).alias("line_no"), F.concat(F.lit("# HELP "), "name", F.lit(" "), "help").alias("line"))
    type_ = heads.select(F.col("name").alias("family"), F.lit(1).alias("line_no"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind").alias("line"))
    return help_.unionAll(type_).unionAll(body)
