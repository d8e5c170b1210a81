"""Derived views over the driver's tables: one SQL text for both engines, apart from the tokens below.

ARR(...) makes an array, MS(ts) gives milliseconds, STR is the type of strings. The clock is fixed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

NOW, BASE = 1706745600000, 1704067200000

VIEWS = {
    "mem": """SELECT d.doc_id + 1 AS id, CASE WHEN d.doc_id % 3 = 0 THEN 'episodic' ELSE 'semantic' END AS type,
  1704067200000 + d.doc_id * 60000 AS created, 1704067200000 + d.doc_id * 60000 + (d.doc_id % 7) * 3600000 AS updated,
  CAST(d.doc_id % 11 AS DOUBLE) / 10 AS importance,
  CAST(CASE WHEN l.quality = 1 THEN 1.0 WHEN l.quality = 0 THEN 0.5 ELSE 0.8 END AS DOUBLE) AS confidence,
  d.source AS agent_id, ARR(d.lang, CASE WHEN d.n_chars < 500 THEN 'short' ELSE 'long' END, CASE WHEN d.doc_id % 2 = 0 THEN 'even' ELSE 'odd' END) AS tags,
  d.text AS data, CASE WHEN d.doc_id % 17 = 0 THEN 1704067200000 + d.doc_id * 60000 + 86400000 ELSE CAST(0 AS BIGINT) END AS expires_at,
  FALSE AS deleted
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "mem_vec": "SELECT vec_id + 1 AS id, embedding AS vec FROM embeddings",
    "multi_vec": "SELECT CAST(floor(vec_id / 4.0) AS BIGINT) + 1 AS id, vec_id % 4 AS slot, embedding AS vec FROM embeddings",
    "dup_vec": "SELECT d.doc_id + 1 AS id, e.embedding AS vec FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % 100",
    "versions": """SELECT user_id + 1 AS id, event_id AS seq, MS(ts) AS updated, concat('ns', CAST(user_id % 5 AS STR)) AS agent_id,
  concat(event_type, ':', CAST(event_id AS STR)) AS data, least(value / 1000, 1.0e0) AS importance,
  (row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type = 'error') AS deleted
FROM events""",
    "usage_counts": """SELECT user_id + 1 AS id, count(*) AS recall_count, max(MS(ts)) AS last_recalled
FROM events WHERE event_type IN ('view','click') GROUP BY user_id + 1""",
    "edges": """WITH n AS (SELECT count(*) AS c FROM documents), m AS (SELECT doc_id + 1 AS id, c FROM documents CROSS JOIN n)
SELECT id AS from_id, id * 2 AS to_id, 'child' AS kind FROM m WHERE id * 2 <= c
UNION ALL SELECT id, id * 2 + 1, 'child' FROM m WHERE id * 2 + 1 <= c
UNION ALL SELECT id, (id * 7) % c + 1, 'link' FROM m WHERE id <> (id * 7) % c + 1""",
    "sessions": """SELECT concat('s', CAST(conv_id AS STR)) AS session_id, turn + 1 AS local_id, role, text AS data,
  1704067200000 + conv_id * 1000000 + turn * 60000 AS created FROM conversations""",
    "transcripts": """SELECT conv_id, turn, concat(text, CASE (conv_id + turn) % 6
  WHEN 0 THEN ' We decided to deploy via make ship going forward.' WHEN 1 THEN ' Note that the build is green.'
  WHEN 2 THEN ' Ignore this scratch note we will use later.' WHEN 3 THEN ' const x = () => foo.bar; position: fixed;' ELSE '' END) AS text FROM conversations""",
    "eval_queries": """SELECT b.item_id AS query_id, substr(b.text, 1, 40) AS query, d.doc_id + 1 AS relevant_id
FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 40))""",
}
TABLES = ("documents", "embeddings", "labels", "events", "conversations", "benchmark")


def _dialect(sql: str, spark: bool) -> str:
    out, at = "", 0
    for token, text in (("ARR(", ("array(", "list_value(")), (" STR)", (" STRING)", " VARCHAR)"))):
        sql = sql.replace(token, text[0 if spark else 1])
    while (i := sql.find("MS(", at)) >= 0:
        j = sql.index(")", i)
        arg = sql[i + 3 : j]
        out += sql[at:i] + (f"unix_millis(CAST({arg} AS TIMESTAMP))" if spark else f"(epoch_us({arg}) // 1000)")
        at = j + 1
    return out + sql[at:]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _dialect(VIEWS[name], True)
    used = [t for t in TABLES if reduce(lambda a, b: a or b, [f"{w} {t}" in sql for w in ("FROM", "JOIN")])]
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def ctes(*names: str) -> str:
    """CTEs of views for DuckDB, without WITH."""
    return ",\n".join(f"{n} AS ({_dialect(VIEWS[n], False)})" for n in names)
