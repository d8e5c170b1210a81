"""DuckDB SQL for the queries of the catalogue that SQL can express, written apart from their plans."""

from __future__ import annotations

import hashlib

from ..functions.text import CODE, EPHEMERAL, SALIENCE, TAGS
from . import queries as Q
from .views import BASE, NOW, ctes

ORACLES: dict[str, str] = {}
LN2 = 0.6931471805599453
WEEK = 604800000


def sql(name: str, body: str, *views: str, more: str = "") -> None:
    """body after the CTEs of views and further ones."""
    with_ = ",\n".join(x for x in (ctes(*views), more) if x)
    ORACLES[name] = f"WITH RECURSIVE {with_}\n{body}" if with_ else body


def _mem(name: str, where: str, cols: str = "id, created") -> None:
    sql(name, f"SELECT {cols} FROM mem WHERE {where}", "mem")


LIVE = f"(expires_at = 0 OR expires_at > {NOW})"
_mem("mem_current", "NOT deleted", "id, type, created, updated, importance, confidence, agent_id, expires_at")
_mem("filter_type", "type = 'episodic'")
_mem("filter_tags_all", "list_contains(tags, 'en') AND list_contains(tags, 'long')")
_mem("filter_tags_any", "list_contains(tags, 'de') OR list_contains(tags, 'short')")
_mem("filter_time_range", f"created BETWEEN {Q.T1} AND {Q.T2}")
_mem("filter_max_importance", "CAST(importance AS FLOAT) <= CAST(0.5 AS FLOAT)")
_mem("filter_namespace", f"agent_id = '{Q.LN}'")
_mem("filter_combined", f"type = 'semantic' AND (list_contains(tags, 'en') OR list_contains(tags, 'short')) AND CAST(importance AS FLOAT) <= CAST(0.7 AS FLOAT) AND created BETWEEN {BASE} AND {BASE + 30_000_000} AND {LIVE}")
_mem("get_by_id", f"id = 42 AND {LIVE}", "id, type, agent_id, length(data) AS n")
_mem("visible_not_expired", LIVE)
_mem("project_memory_shape", "TRUE", "id, data AS text, type AS kind, array_to_string(tags, ',') AS tags, importance, confidence, created, updated")

sql("count_filtered", f"SELECT count(*) AS n, (SELECT count(*) > 100000 FROM mem) AS capped FROM mem WHERE type = 'semantic' AND {LIVE}", "mem")
NEWEST = "newest AS (SELECT * FROM mem ORDER BY created DESC, id DESC LIMIT 100)"
sql("count_capped", f"SELECT count(*) AS n, (SELECT count(*) > 100 FROM mem) AS capped FROM newest WHERE type = 'semantic' AND {LIVE}", "mem", more=NEWEST)
sql("scan_recent_cap", "SELECT id, created FROM newest", "mem", more=NEWEST)
sql("scan_oldest_cap", "SELECT id, created FROM mem ORDER BY created, id LIMIT 100", "mem")
sql("type_filter_after_cap", f"SELECT id, created FROM newest WHERE type = 'episodic' AND {LIVE}", "mem", more=NEWEST)
sql("search_filter_page", f"SELECT id, created FROM mem WHERE type = 'semantic' AND list_contains(tags, 'en') AND {LIVE} ORDER BY created, id LIMIT 20 OFFSET 10", "mem")


def _page(after: int, n: int) -> str:
    return f"p AS (SELECT id FROM mem WHERE agent_id = 'src0' AND id > {after} ORDER BY id LIMIT {n}), q AS (SELECT p.id, (SELECT count(*) FROM mem WHERE agent_id = 'src0' AND id > {after}) > {n} AS has_more, (SELECT max(id) FROM p) AS cursor FROM p)"


sql("export_first_page", "SELECT * FROM q", "mem", more=_page(0, 10))
sql("export_next_page", "SELECT * FROM q", "mem", more=_page(200, 10))
sql("export_has_more", "SELECT has_more, count(*) AS n FROM q GROUP BY has_more", "mem", more=_page(0, 1000))

sql("tags_intersect", "SELECT id FROM mem WHERE list_contains(tags, 'en') INTERSECT SELECT id FROM mem WHERE list_contains(tags, 'odd')", "mem")
sql("tags_union", "SELECT id FROM mem WHERE list_contains(tags, 'de') UNION SELECT id FROM mem WHERE list_contains(tags, 'short')", "mem")
LAST = "last AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"
sql("live_except_tombstoned", "SELECT id FROM versions EXCEPT SELECT id FROM last WHERE deleted", "versions", more=LAST)
sql("checkpoint_plus_tail", "SELECT id, seq, data FROM last", "versions", more=LAST)

# text
RUN = r"[A-Za-z0-9_\-.:/+#\x{80}-\x{10FFFF}]+"
TOK = rf"""full_terms AS (SELECT id, list_filter(list_transform(regexp_extract_all(coalesce(data, ''), '{RUN}'), lambda t: translate(regexp_replace(t, '^[-.:/+#]+|[-.:/+#]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), lambda t: t <> '') AS f FROM mem),
tok AS (SELECT id, flatten(list_transform(f, lambda t: CASE WHEN regexp_matches(t, '[_\-.:/+#]') THEN list_concat([t], list_filter(string_split_regex(t, '[_\-.:/+#]+'), lambda p: strlen(p) >= 2 AND strlen(p) < strlen(t))) ELSE [t] END)) AS toks FROM full_terms),
doc AS (SELECT id, toks, len(toks) AS dl FROM tok WHERE len(toks) > 0)"""
ONE = "one AS (SELECT id, unnest(toks) AS term FROM doc)"
sql("tokenize_documents", "SELECT id, term, count(*) AS tf FROM one GROUP BY id, term", "mem", more=f"{TOK}, {ONE}")
sql("term_document_frequency", "SELECT term, count(DISTINCT id) AS df FROM one GROUP BY term", "mem", more=f"{TOK}, {ONE}")
sql("doc_lengths", "SELECT id, dl FROM doc", "mem", more=TOK)
sql("corpus_stats", "SELECT count(*) AS n, CAST(sum(dl) AS BIGINT) AS total_len, round(avg(dl), 6) AS avgdl FROM doc", "mem", more=TOK)
sql("distinct_terms", "SELECT count(DISTINCT term) AS n FROM one", "mem", more=f"{TOK}, {ONE}")


#: The terms of the catalogue's queries, cut by hand.
TERMS = {
    Q.QUERY: ["apache", "license", "version"],
    Q.LONG_QUERY: ["the", "license", "of", "creative", "commons", "by-nc", "by", "nc", "and", "mail5.example.com", "mail5", "example", "com", "version", "2.0", "das", "einer"],
    Q.IDENTIFIER: ["by-nc", "by", "nc", "mail5.example.com", "mail5", "example", "com"],
}


def _bm25(query: str, limit: int = 8192) -> str:
    terms = TERMS[query]
    tf = ", ".join(f"len(list_filter(toks, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    s = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5e0) / (df{i} + 0.5e0)) * tf{i} * 2.2e0 / (tf{i} + 1.2e0 * (1 - 0.75e0 + 0.75e0 * dl / (total / n))) ELSE 0e0 END" for i in range(len(terms)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""{TOK}, counted AS (SELECT id, dl, {tf} FROM doc), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(dl) AS DOUBLE) AS total, {df} FROM counted),
lex AS (SELECT id, round({s}, 9) AS bm25 FROM counted, st WHERE {some}),
lranked AS (SELECT * FROM (SELECT id, bm25, row_number() OVER (ORDER BY bm25 DESC, id) AS lrank FROM lex) WHERE lrank <= {limit})"""


W = "CASE WHEN importance * confidence > 0 THEN importance * confidence ELSE 1.0e0 END"
REC = f"exp(-{LN2} * greatest({NOW} - updated, 0) / {WEEK}.0e0)"
sql("bm25_topk", "SELECT id, round(bm25, 6) AS score, lrank FROM lranked", "mem", more=_bm25(Q.QUERY, 10))
sql("bm25_multi_term", "SELECT id, round(bm25, 6) AS score, lrank FROM lranked", "mem", more=_bm25(Q.LONG_QUERY, 20))


def _lexical(name: str, query: str, where: str, k: int) -> None:
    sql(name, f"SELECT id, round(score, 6) AS score, lrank FROM (SELECT l.id, round({W} * bm25, 9) AS score, lrank FROM lranked l JOIN mem m ON l.id = m.id WHERE {where}) ORDER BY score DESC, id LIMIT {k}", "mem", more=_bm25(query))


_lexical("bm25_weighted", Q.QUERY, LIVE, 20)
_lexical("bm25_filtered_namespace", Q.LONG_QUERY, f"{LIVE} AND agent_id = '{Q.LN}'", 10)
_lexical("bm25_identifier", Q.IDENTIFIER, LIVE, 20)
sql("bm25_explain", f"""SELECT id, round(bm25, 6) AS bm25, importance, confidence, round(w, 6) AS weight, round(r, 6) AS recency_factor, round(score, 6) AS score
FROM (SELECT l.id, bm25, importance, confidence, {W} AS w, {REC} AS r, round({W} * bm25 * {REC}, 9) AS score FROM lranked l JOIN mem m ON l.id = m.id WHERE {LIVE}) ORDER BY score DESC, id LIMIT 10""", "mem", more=_bm25(Q.QUERY))

# vectors
D = "CAST({0} AS DOUBLE[])"
COS = "round(CASE WHEN sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) = 0 THEN 0 ELSE list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) END, 9)"


def _sem(view: str = "mem_vec", where: str = "TRUE", limit: int = 8192, first: str = "id = 1") -> str:
    return f"""qv AS (SELECT CAST(vec AS DOUBLE[]) AS b FROM {view} WHERE {first}), sims AS (SELECT id, max({COS}) AS sim FROM (SELECT id, CAST(vec AS DOUBLE[]) AS a FROM {view}) v, qv GROUP BY id),
sranked AS (SELECT * FROM (SELECT id, sim, row_number() OVER (ORDER BY sim DESC, id) AS srank FROM sims WHERE {where}) WHERE srank <= {limit})"""


def _semantic(name: str, where: str, k: int, offset: int = 0, least: str = "TRUE", times: str = "1") -> None:
    sql(name, f"SELECT id, round(score, 6) AS score, srank FROM (SELECT s.id, round({W} * sim * {times}, 9) AS score, srank FROM sranked s JOIN mem m ON s.id = m.id WHERE {where}) ORDER BY score DESC, id LIMIT {k} OFFSET {offset}", "mem", "mem_vec", more=_sem(where=least))


sql("cosine_topk", "SELECT id, round(sim, 6) AS score, srank FROM sranked", "mem_vec", more=_sem(limit=10))
_semantic("cosine_min_score", LIVE, 50, least="sim >= 0.25")
_semantic("cosine_weighted", LIVE, 20)
_semantic("cosine_half_life", LIVE, 10, times=REC)
_semantic("cosine_filtered_tags", f"{LIVE} AND list_contains(tags, 'en') AND list_contains(tags, 'even')", 10)
sql("cosine_best_of_n", "SELECT id, round(sim, 6) AS score, srank FROM sranked", "multi_vec", more=_sem("multi_vec", limit=10, first="id = 1 AND slot = 0"))
_semantic("cosine_paged", LIVE, 10, 10)
sql("vector_norms", "SELECT id, round(sqrt(list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[]))), 6) AS norm FROM mem_vec", "mem_vec")

RRF = "coalesce(1.0e0 / (60 + srank), 0) + coalesce(1.0e0 / (60 + lrank), 0)"


def _fused(want: int, where: str, least: str = "TRUE") -> str:
    first = 4 * want + 32
    levels = [first]
    while levels[-1] < 8192:
        levels.append(min(8192, levels[-1] * 4))
    lv = " UNION ALL ".join(f"SELECT {x} AS f" for x in levels)
    return f"""{_bm25(Q.LONG_QUERY)}, {_sem(where=least)}, good AS (SELECT id FROM mem WHERE {where}),
f_all AS (SELECT coalesce(s.id, l.id) AS id, srank, lrank, least(coalesce(srank, 9999), coalesce(lrank, 9999)) AS best FROM sranked s FULL JOIN lranked l ON s.id = l.id),
lv AS ({lv}), lengths AS (SELECT coalesce(max(srank), 0) AS ns, coalesce(max(lrank), 0) AS nl FROM f_all),
enough AS (SELECT f FROM lv, lengths WHERE (SELECT count(*) FROM f_all JOIN good USING (id) WHERE best <= f) >= {want} OR (ns < f AND nl < f)),
depth AS (SELECT coalesce(min(f), 8192) AS f FROM enough),
hits AS (SELECT f_all.id, CASE WHEN srank <= f THEN srank END AS srank, CASE WHEN lrank <= f THEN lrank END AS lrank FROM f_all JOIN good USING (id), depth WHERE best <= f),
page AS (SELECT id, srank, lrank, round({RRF}, 9) AS score FROM hits ORDER BY score DESC, id LIMIT {want})"""


sql("rrf_full_outer", f"SELECT coalesce(s.id, l.id) AS id, srank, lrank, round({RRF}, 9) AS score FROM sranked s FULL JOIN lranked l ON s.id = l.id", "mem", "mem_vec", more=f"{_bm25(Q.LONG_QUERY, 72)}, {_sem(limit=72)}")
sql("hybrid_topk", "SELECT * FROM page", "mem", "mem_vec", more=_fused(10, LIVE))
sql("hybrid_min_score", "SELECT * FROM page", "mem", "mem_vec", more=_fused(20, LIVE, "sim >= 0.25"))
sql("hybrid_explain", "SELECT p.id, round(CASE WHEN p.srank IS NOT NULL THEN sim END, 6) AS similarity, round(CASE WHEN p.lrank IS NOT NULL THEN bm25 END, 6) AS bm25, 1.0e0 AS weight, 1.0e0 AS recency, p.srank IS NOT NULL AS semantic, p.lrank IS NOT NULL AS lexical FROM page p LEFT JOIN sranked s ON p.id = s.id LEFT JOIN lranked l ON p.id = l.id", "mem", "mem_vec", more=_fused(10, LIVE))
sql("hybrid_namespace_global_rank", "SELECT * FROM page", "mem", "mem_vec", more=_fused(10, f"{LIVE} AND agent_id = '{Q.LN}'"))
WHOLE = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: CAST({0}[i] AS BIGINT) * CAST({1}[i] AS BIGINT)))"
sql("int8_quantized_cosine", f"SELECT id, round(scale, 9) AS scale, floor(CAST({WHOLE.format('a', 'b')} AS DOUBLE) / nullif(sqrt(CAST({WHOLE.format('a', 'a')} AS DOUBLE) * CAST({WHOLE.format('b', 'b')} AS DOUBLE)), 0) * 1000000e0 + 0.5e0) / 1000000e0 AS score FROM z, (SELECT a AS b FROM z WHERE id = 1) AS one", "mem_vec",
    more="v AS (SELECT id, CAST(vec AS DOUBLE[]) AS x FROM mem_vec), m AS (SELECT id, x, list_max(list_transform(x, lambda y: abs(y))) / 127e0 AS scale FROM v), z AS (SELECT id, scale, list_transform(x, lambda y: CASE WHEN scale = 0 THEN 0e0 ELSE round(y / scale) END) AS a FROM m)")

# time
sql("latest_versions", "SELECT id, seq, updated, data, deleted FROM last", "versions", more=LAST)
HIST = "h AS (SELECT id, seq, updated AS valid_from, coalesce(lead(updated) OVER (PARTITION BY id ORDER BY seq), 0) AS valid_to, deleted FROM versions)"
sql("history_validity", "SELECT * FROM h", "versions", more=HIST)
ASOF = f"o AS (SELECT * FROM versions WHERE updated <= {Q.AS_OF} QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"
sql("as_of_point", "SELECT id, seq, data FROM o WHERE id = 5 AND NOT deleted", "versions", more=ASOF)
sql("as_of_all_ids", "SELECT id, seq, data FROM o WHERE NOT deleted", "versions", more=ASOF)
sql("versions_valid_join", f"SELECT h.id, t.at_ms AS \"at\", seq, deleted FROM h JOIN (SELECT {BASE + WEEK} AS at_ms UNION ALL SELECT {Q.AS_OF}) t ON valid_from <= t.at_ms AND (t.at_ms < valid_to OR (valid_to = 0))", "versions", more=HIST.replace("coalesce(lead(updated) OVER (PARTITION BY id ORDER BY seq), 0)", "coalesce(lead(updated) OVER (PARTITION BY id ORDER BY seq), 0)"))
sql("recency_decay", f"SELECT id, round({REC}, 9) AS decay FROM mem", "mem")
sql("ttl_sweep", f"SELECT id, expires_at FROM mem WHERE expires_at <> 0 AND expires_at <= {Q.SWEEP}", "mem")


# maintenance
def _forget(weight: float, least: float, limit: str = "") -> str:
    kept = f"round(importance * exp(-{LN2} * greatest({NOW} - greatest(updated, coalesce(last_recalled, 0)), 0) / {WEEK}.0e0) * (1 + {weight}e0 * (1 - 1 / (1 + coalesce(recall_count, 0)::DOUBLE))), 9)"
    return f"SELECT id, round(k, 6) AS retention FROM (SELECT m.id, {kept} AS k FROM mem m LEFT JOIN usage_counts u ON m.id = u.id WHERE type = 'episodic') WHERE k < {least} ORDER BY id {limit}"


sql("forget_candidates", _forget(1.0, 0.05), "mem", "usage_counts")
sql("forget_usage_weight_zero", _forget(0.0, 0.08), "mem", "usage_counts")
sql("forget_max", _forget(1.0, 0.05, "LIMIT 25"), "mem", "usage_counts")
# the vectors of this view are copies or far apart, so that a cluster is a group of copies within a namespace
CLU = f"clu AS (SELECT m.*, min(m.id) OVER (PARTITION BY agent_id, vec) AS seed, count(*) OVER (PARTITION BY agent_id, vec) AS members FROM mem m JOIN dup_vec v ON m.id = v.id WHERE type = 'semantic' AND {LIVE})"
SUR = "sur AS (SELECT seed, arg_max(id, (updated, id)) AS survivor, count(*) AS members, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags, max(importance) AS importance, max(confidence) AS confidence FROM clu WHERE members > 1 GROUP BY seed)"
sql("consolidate_pairs", "SELECT seed AS a, id AS b, 1.0e0 AS sim FROM clu WHERE id <> seed", "mem", "dup_vec", more=CLU)
sql("consolidate_survivors", "SELECT * FROM sur", "mem", "dup_vec", more=f"{CLU}, {SUR}")
sql("consolidate_supersedes", "SELECT survivor AS from_id, id AS to_id, 'supersedes' AS kind FROM sur JOIN clu USING (seed) WHERE id <> survivor", "mem", "dup_vec", more=f"{CLU}, {SUR}")
sql("purge_namespace", "SELECT agent_id, count(*) AS n FROM versions WHERE agent_id <> 'ns1' GROUP BY agent_id", "versions")
sql("compaction_live", "SELECT id, seq, agent_id FROM last WHERE NOT deleted", "versions", more=LAST)
sql("compaction_worthwhile", "SELECT live, dead, dead > 0 AND dead * 4 >= live + dead AS worthwhile FROM (SELECT (SELECT count(*) FROM last WHERE NOT deleted) AS live, (SELECT count(*) FROM versions) - (SELECT count(*) FROM last WHERE NOT deleted) AS dead)", "versions", more=LAST)

# graph
sql("edges_exploded", "SELECT * FROM edges", "edges")


def _walk(depth: int, live: str) -> str:
    return f"live AS (SELECT id FROM mem WHERE {live}), walk AS (SELECT id, 0 AS level FROM live WHERE id = 2 UNION SELECT e.to_id, level + 1 FROM walk w JOIN edges e ON e.from_id = w.id JOIN live l ON l.id = e.to_id WHERE level < {depth})"


for name, depth in (("traverse_depth_1", 1), ("traverse_depth_3", 3)):
    sql(name, "SELECT id, CAST(min(level) AS BIGINT) AS level FROM walk GROUP BY id", "mem", "edges", more=_walk(depth, LIVE))
sql("traverse_namespace", "SELECT id, CAST(min(level) AS BIGINT) AS level FROM walk GROUP BY id", "mem", "edges", more=_walk(4, f"{LIVE} AND id % 3 <> 0"))
sql("edge_kinds", "SELECT kind, count(*) AS n, count(DISTINCT from_id) AS sources FROM edges GROUP BY kind", "edges")
sql("relate_dedup", "SELECT from_id AS id, count(*) AS n FROM (SELECT DISTINCT from_id, to_id, kind FROM edges WHERE from_id <> to_id AND from_id IN (SELECT id FROM mem) AND to_id IN (SELECT id FROM mem)) GROUP BY from_id", "mem", "edges")

# statistics
sql("stats_live_tombstones", "SELECT count(*) FILTER (WHERE NOT deleted) AS live, count(*) FILTER (WHERE deleted) AS tombstones FROM last", "versions", more=LAST)
sql("stats_by_op", "SELECT event_type AS op, count(*) AS requests, count(*) FILTER (WHERE value > 400) AS slow FROM events GROUP BY event_type")
BOUNDS = "100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000, 100000, 250000"
HISTO = f"""b AS (SELECT unnest(range(0, 12)) AS slot, unnest([{BOUNDS}, -1]) AS bound),
obs AS (SELECT len(list_filter([{BOUNDS}], lambda x: x < value * 100)) AS slot FROM events WHERE value IS NOT NULL),
hist AS (SELECT b.slot, b.bound, count(obs.slot) AS n FROM b LEFT JOIN obs ON b.slot = obs.slot GROUP BY b.slot, b.bound),
cum AS (SELECT slot, bound, n, CAST(sum(n) OVER (ORDER BY slot) AS BIGINT) AS cumulative FROM hist)"""
sql("latency_histogram", "SELECT CAST(slot AS INT) AS slot, CAST(bound AS BIGINT) AS bound, n, cumulative FROM cum", more=HISTO)


def _quantile(q: float) -> str:
    return f"round(coalesce((SELECT CASE WHEN bound < 0 THEN 250000e0 ELSE low + (bound - low) * ({q}e0 * total - (cumulative - n)) / n END FROM c2 WHERE cumulative >= {q}e0 * total AND n > 0 ORDER BY slot LIMIT 1), 0), 6)"


sql("latency_percentiles", f"SELECT {_quantile(0.5)} AS p50, {_quantile(0.95)} AS p95, {_quantile(0.99)} AS p99", more=HISTO + ", c2 AS (SELECT *, coalesce(lag(bound) OVER (ORDER BY slot), 0) AS low, max(cumulative) OVER () AS total FROM cum)")
TEN = "ten AS (SELECT agent_id, count(*) AS records, CAST(sum(strlen(data)) AS BIGINT) AS bytes FROM mem WHERE agent_id IS NOT NULL GROUP BY agent_id)"
sql("tenant_usage", "SELECT * FROM ten", "mem", more=TEN)
sql("tenant_quota_exceeded", "SELECT * FROM (SELECT agent_id, records + g AS records, bytes + 1000 AS bytes FROM ten JOIN (SELECT agent_id, count(*) AS g FROM mem WHERE id % 4 = 0 GROUP BY agent_id) USING (agent_id)) WHERE records > 60", "mem", more=TEN)
sql("usage_totals", "SELECT count(*) AS tracked, CAST(sum(recall_count) AS BIGINT) AS recalls, max(last_recalled) AS last_recalled FROM usage_counts", "usage_counts")
sql("tag_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM mem) GROUP BY tag", "mem")


# capture
def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _has(low: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({low}, {_lit(p)})" for p in phrases) + ")"


TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
WORDS = r"(CASE WHEN {0} = '' THEN 0 ELSE len(string_split_regex({0}, '\s+')) END)"
SENT = rf"""sl AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]?'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 8) AS l FROM transcripts),
sent AS (SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS pos, l[i] AS sentence FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM sl))"""
TOPS = "greatest(" + ", ".join(f"CASE WHEN contains(lower(sentence), {_lit(p)}) THEN {w}e0 ELSE 0e0 END" for p, w in SALIENCE.items()) + ")"
SAL = f"(CASE WHEN {TOPS} > 0 AND {WORDS.format('sentence')} >= 6 THEN least(1.0e0, {TOPS} + 0.1e0) ELSE {TOPS} END)"
TAGSQL = "array_to_string(list_filter(['session', " + ", ".join(f"CASE WHEN {_has('lower(sentence)', ph)} THEN '{t}' END" for t, ph in TAGS.items()) + "], lambda x: x IS NOT NULL), ',')"
SYMS = "length(sentence) - length(translate(sentence, '{}[]()<>=|/\\`', ''))"
CODESQL = "(" + " OR ".join(f"regexp_matches(sentence, {_lit(p)})" for p in CODE) + f" OR length(sentence) - length(replace(sentence, ';', '')) >= 2 OR (length(sentence) >= 12 AND ({SYMS}) / CAST(length(sentence) AS DOUBLE) > 0.08))"
sql("sentence_split", "SELECT * FROM sent", "transcripts", more=SENT)
sql("salience_score", f"SELECT * FROM (SELECT conv_id, turn, pos, round({SAL}, 6) AS salience FROM sent) WHERE salience > 0", "transcripts", more=SENT)
sql("infer_tags", f"SELECT conv_id, turn, pos, {TAGSQL} AS tags FROM sent", "transcripts", more=SENT)
sql("ephemeral_filter", f"SELECT conv_id, turn FROM transcripts WHERE NOT {_has('lower(text)', EPHEMERAL)}", "transcripts")
sql("looks_like_code", f"SELECT conv_id, turn, pos FROM sent WHERE {CODESQL}", "transcripts", more=SENT)
sql("capture_candidates", f"""SELECT conv_id, sentence AS text, round(s, 6) AS salience, {TAGSQL} AS tags FROM (SELECT *, {SAL} AS s FROM sent WHERE NOT {CODESQL} QUALIFY row_number() OVER (PARTITION BY conv_id, lower(sentence) ORDER BY turn, pos) = 1)
WHERE s >= 0.5 AND NOT {_has('lower(sentence)', EPHEMERAL)}""", "transcripts", more=SENT)
sql("fake_extract_facts", "SELECT conv_id, n, fact FROM fc WHERE n <= 12", "transcripts", more=rf"""ln AS (SELECT conv_id, turn, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, unnest(string_split(text, chr(10))) AS line FROM transcripts),
wd AS (SELECT conv_id, turn, pos, string_split_regex({TRIM.format('line')}, '\s+') AS w FROM ln),
gs AS (SELECT conv_id, turn, pos, array_to_string(list_slice(w, 1, 24), ' ') AS fact FROM wd WHERE len(w) >= 4),
ft AS (SELECT * FROM gs QUALIFY row_number() OVER (PARTITION BY conv_id, lower(fact) ORDER BY turn, pos) = 1),
fc AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS n, fact FROM ft)""")
sql("supersede_judge", r"SELECT n.id AS new_id, o.id AS old_id FROM n JOIN o ON starts_with(o.t, n.s) AND o.t <> n.t WHERE n.s <> ''", "mem", more=r"""x AS (SELECT id, type, lower(trim(data)) AS t FROM mem),
n AS (SELECT id, t, array_to_string(list_slice(string_split_regex(t, '\s+'), 1, 2), ' ') AS s FROM x WHERE type = 'episodic'), o AS (SELECT id, t FROM x WHERE type = 'semantic')""")
sql("client_blend_score", "SELECT m.id, round(sim * (0.5e0 + 0.5e0 * coalesce(importance, 0.5e0)) * coalesce(confidence, 1.0e0), 4) AS score FROM mem m JOIN sims s ON m.id = s.id", "mem", "mem_vec", more=_sem())

# evaluation
MANY = f"""{TOK}, {ONE}, tf AS (SELECT id, term, count(*) AS tf FROM one GROUP BY id, term), df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM doc), qs AS (SELECT DISTINCT query_id, query FROM eval_queries),
qf AS (SELECT query_id, list_filter(list_transform(regexp_extract_all(query, '{RUN}'), lambda t: translate(regexp_replace(t, '^[-.:/+#]+|[-.:/+#]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), lambda t: t <> '') AS f FROM qs),
qt AS (SELECT DISTINCT query_id, unnest(flatten(list_transform(f, lambda t: CASE WHEN regexp_matches(t, '[_\\-.:/+#]') THEN list_concat([t], list_filter(string_split_regex(t, '[_\\-.:/+#]+'), lambda p: strlen(p) >= 2 AND strlen(p) < strlen(t))) ELSE [t] END))) AS term FROM qf),
sc AS (SELECT qt.query_id, tf.id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * dl / avgdl))), 9) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN doc ON doc.id = tf.id, st GROUP BY qt.query_id, tf.id),
hits AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 10),
rel AS (SELECT DISTINCT query_id, relevant_id AS id FROM eval_queries),
ev AS (SELECT rel.query_id, round(count(*) FILTER (WHERE rank <= 1) / CAST(count(*) AS DOUBLE), 6) AS recall_at_1, round(count(*) FILTER (WHERE rank <= 5) / CAST(count(*) AS DOUBLE), 6) AS recall_at_5, round(count(*) FILTER (WHERE rank <= 10) / CAST(count(*) AS DOUBLE), 6) AS recall_at_10, round(coalesce(1.0e0 / min(rank), 0), 6) AS rr FROM rel LEFT JOIN hits ON rel.query_id = hits.query_id AND rel.id = hits.id GROUP BY rel.query_id)"""
MEAN = "count(*) AS queries, round(avg(recall_at_1), 6) AS recall_at_1, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(rr), 6) AS mrr"
sql("eval_recall_at_k", "SELECT query_id, recall_at_1, recall_at_5, recall_at_10 FROM ev", "mem", "eval_queries", more=MANY)
sql("eval_mrr", f"SELECT {MEAN} FROM ev", "mem", "eval_queries", more=MANY)
RECENT = """nw AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS rank FROM (SELECT id FROM mem ORDER BY created DESC, id DESC LIMIT 10)),
rc AS (SELECT rel.query_id, round(count(*) FILTER (WHERE rank <= 1) / CAST(count(*) AS DOUBLE), 6) AS recall_at_1, round(count(*) FILTER (WHERE rank <= 5) / CAST(count(*) AS DOUBLE), 6) AS recall_at_5, round(count(*) FILTER (WHERE rank <= 10) / CAST(count(*) AS DOUBLE), 6) AS recall_at_10, round(coalesce(1.0e0 / min(rank), 0), 6) AS rr FROM rel LEFT JOIN nw ON rel.id = nw.id GROUP BY rel.query_id)"""
sql("eval_mode_comparison", f"SELECT 'lexical' AS mode, {MEAN} FROM ev UNION ALL SELECT 'recent', {MEAN} FROM rc", "mem", "eval_queries", more=f"{MANY}, {RECENT}")

# streams in batch form, extensions, access
RING = "ring AS (SELECT * FROM sessions {0} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY local_id DESC) <= 4)"
sql("ring_buffer_last_n", "SELECT session_id, local_id FROM ring", "sessions", more=RING.format(""))
sql("working_live_at", f"SELECT session_id, local_id FROM ring WHERE created + 3600000 > {BASE + 3_700_000}", "sessions", more=RING.format(f"WHERE created <= {BASE + 3_700_000}"))
sql("usage_counts", "SELECT * FROM usage_counts", "usage_counts")
sql("events_tumbling", "SELECT epoch_ms(date_trunc('day', ts)) AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
sql("events_sliding", "SELECT epoch_ms(d) AS start_ms, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY 1")
sql("events_session_window", "SELECT user_id, min(epoch_us(ts)) // 1000 AS start_ms, count(*) AS n FROM s2 GROUP BY user_id, s", more="""s1 AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 43200000000 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s2 AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM s1)""")
sql("events_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
_rows = ", ".join(f"('{hashlib.sha256(s.encode()).hexdigest()}', {_lit(n) if n else 'NULL'}, '{c}')" for s, n, c in Q.TOKENS)
TOKENS = f"tk AS (SELECT * FROM (VALUES {_rows}) AS t(token, namespace, scope))"
sql("token_scope_filter", "SELECT token, scope, count(*) AS n FROM tk JOIN mem ON namespace IS NULL OR agent_id = namespace GROUP BY token, scope", "mem", more=TOKENS)
sql("token_fingerprint", "SELECT substr(token, 1, 12) AS fingerprint, namespace, scope FROM tk", more=TOKENS)


# folds over an order: recursion
def _nearest(view: str, k: int) -> str:
    return f"""vs AS (SELECT id, CAST(vec AS DOUBLE[]) AS a FROM {view}), qs AS (SELECT id AS query_id, a AS b FROM vs WHERE (id - 1) % 100 = 0),
pr AS (SELECT query_id, id, a, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM (SELECT query_id, id, a, {COS} AS sim FROM vs, qs) QUALIFY rank <= {k})"""


sql("near_dup_suppress", "SELECT f.query_id, CAST(pr.rank AS INT) AS rank, pr.id FROM (SELECT query_id, unnest(ids) AS id FROM st QUALIFY k = max(k) OVER (PARTITION BY query_id)) f JOIN pr ON pr.query_id = f.query_id AND pr.id = f.id", "mem", "dup_vec", more=f"""{_nearest("dup_vec", 40)},
st AS (SELECT query_id, 0 AS k, CAST([] AS DOUBLE[][]) AS kept, CAST([] AS BIGINT[]) AS ids FROM qs
  UNION ALL SELECT query_id, k + 1, CASE WHEN close THEN kept ELSE list_append(kept, a) END, CASE WHEN close THEN ids ELSE list_append(ids, id) END
  FROM (SELECT st.*, pr.id, pr.a, len(list_filter(st.kept, lambda v: list_cosine_similarity(v, pr.a) >= 0.95e0)) > 0 AS close FROM st JOIN pr ON pr.query_id = st.query_id AND pr.rank = st.k + 1))""")
sql("recall_context_budget", """SELECT query_id, concat('Relevant memories from past sessions:', chr(10), string_agg(line, chr(10) ORDER BY rank) FILTER (WHERE NOT gone), CASE WHEN count(*) FILTER (WHERE gone) > 0 THEN concat(chr(10), '- (+', count(*) FILTER (WHERE gone), ' more relevant memor', CASE WHEN count(*) FILTER (WHERE gone) = 1 THEN 'y' ELSE 'ies' END, ' omitted to fit the recall budget; call memory_search to see the rest)') ELSE '' END) AS context,
  CAST(count(*) FILTER (WHERE NOT gone) AS INT) AS included FROM ln GROUP BY query_id""", "mem", "mem_vec", more=f"""{_nearest("mem_vec", 20)},
tx AS (SELECT query_id, rank, m.id, tags, replace(trim(data), chr(10), ' ') AS t FROM pr JOIN mem m ON pr.id = m.id),
ct AS (SELECT *, substr(t, 1, 500) AS cut, length(substr(t, 1, 500)) - instr(reverse(substr(t, 1, 500)), ' ') AS sp FROM tx),
l0 AS (SELECT query_id, rank, concat('- [#', id, '] ', CASE WHEN length(t) <= 500 THEN t ELSE concat(rtrim(CASE WHEN instr(cut, ' ') > 0 AND sp >= 300 THEN substr(cut, 1, sp) ELSE cut END), ' […]') END, CASE WHEN len(tags) > 0 THEN concat(' (tags: ', array_to_string(tags, ', '), ')') ELSE '' END) AS line FROM ct),
l1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) > 1 AND sum(length(line)) OVER (PARTITION BY query_id ORDER BY rank) > 2000 AS over_ FROM l0),
ln AS (SELECT *, max(CAST(over_ AS INT)) OVER (PARTITION BY query_id ORDER BY rank) = 1 AS gone FROM l1)""")
_CLUSTERS = f"""rc AS (SELECT agent_id AS grp, id, created, unnest(list_distinct(tags)) AS tag FROM mem WHERE type = 'episodic' AND importance <= 0.6e0 AND {NOW} - created >= {WEEK} AND NOT list_contains(tags, 'summary')),
tg AS (SELECT grp, tag, list(id ORDER BY created, id) AS all_ids FROM rc GROUP BY grp, tag HAVING count(*) >= 3), tn AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY tag) AS k FROM tg),
st AS (SELECT DISTINCT grp, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS placed, CAST(NULL AS VARCHAR) AS tag, CAST(NULL AS BIGINT[]) AS ids, 0 AS c FROM tn
  UNION ALL SELECT grp, k, CASE WHEN good THEN list_concat(placed, free) ELSE placed END, tag, CASE WHEN good THEN free END, c + CAST(good AS INT)
  FROM (SELECT *, len(free) >= 3 AND c < 20 AS good FROM (SELECT st.grp, tn.k, st.placed, tn.tag, st.c, list_slice(list_filter(tn.all_ids, lambda i: NOT list_contains(st.placed, i)), 1, 20) AS free FROM st JOIN tn ON tn.grp = st.grp AND tn.k = st.k + 1))),
cl AS (SELECT grp, tag, ids FROM st WHERE ids IS NOT NULL)"""
sql("summary_clusters", "SELECT grp AS agent_id, tag, len(ids) AS n, ids[1] AS first_id FROM cl", "mem", more=_CLUSTERS)
sql("summary_fake", r"SELECT grp AS agent_id, tag, substr(concat('[distilled ', count(*), ' memories] ', string_agg(gist, '; ' ORDER BY pos)), 1, 400) AS text FROM ms GROUP BY grp, tag", "mem", more=_CLUSTERS + r""",
mp AS (SELECT grp, tag, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS pos FROM cl),
ms AS (SELECT grp, tag, pos, array_to_string(list_slice(string_split_regex(regexp_replace(data, '^\s+|\s+$', '', 'g'), '\s+'), 1, 6), ' ') AS gist FROM mp JOIN mem USING (id) WHERE data IS NOT NULL AND data <> '')""")
sql("summarised_store", r"SELECT grp AS agent_id, tag, len(ids) AS sources, list_max(list_transform(ids, lambda i: i)) AS last_source, array_to_string(list_sort(list_distinct(list_concat(flatten(tags), ['summary']))), ',') AS tags, importance FROM (SELECT cl.grp, cl.tag, any_value(cl.ids) AS ids, list(m.tags) AS tags, max(m.importance) AS importance FROM (SELECT grp, tag, ids, unnest(ids) AS id FROM cl) cl JOIN mem m ON m.id = cl.id GROUP BY cl.grp, cl.tag)", "mem", more=_CLUSTERS)
sql("token_bucket_allow", "SELECT agent_id, allowed, count(*) AS n FROM st WHERE k > 0 GROUP BY agent_id, allowed", more="""rq AS (SELECT concat('ns', CAST(user_id % 5 AS VARCHAR)) AS agent_id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id % 5 ORDER BY epoch_us(ts), event_id) AS k FROM events),
st AS (SELECT DISTINCT agent_id, CAST(0 AS BIGINT) AS k, 5e0 AS tokens, CAST(NULL AS BIGINT) AS last, FALSE AS allowed FROM rq
  UNION ALL SELECT agent_id, k, CASE WHEN now_ >= 1 THEN now_ - 1 ELSE now_ END, at_us, now_ >= 1
  FROM (SELECT rq.agent_id, rq.k, rq.at_us, CASE WHEN st.last IS NULL THEN 5e0 WHEN rq.at_us > st.last THEN least(5e0, st.tokens + CAST(rq.at_us - st.last AS DOUBLE) / 1e6 * 0.001e0) ELSE st.tokens END AS now_ FROM st JOIN rq ON rq.agent_id = st.agent_id AND rq.k = st.k + 1))""")

# operations
sql("stats_rollup", """SELECT (SELECT count(*) FROM last WHERE NOT deleted) AS records, (SELECT count(*) FROM last WHERE deleted) AS tombstones, (SELECT CAST(sum(strlen(data)) AS BIGINT) FROM versions) AS log_bytes,
  (SELECT count(DISTINCT agent_id) FROM last WHERE NOT deleted) AS tenants, (SELECT count(*) FROM usage_counts) AS usage_tracked, (SELECT count(DISTINCT event_type) FROM events) AS operations, (SELECT count(*) FROM events) AS requests""", "versions", "usage_counts", more=LAST)
sql("metric_families", """SELECT 'memory_records' AS name, CAST(count(*) FILTER (WHERE NOT deleted) AS DOUBLE) AS value, '' AS label FROM last UNION ALL SELECT 'memory_tombstones', CAST(count(*) FILTER (WHERE deleted) AS DOUBLE), '' FROM last
UNION ALL SELECT 'memory_requests_total', CAST(count(*) AS DOUBLE), event_type FROM events GROUP BY event_type UNION ALL SELECT 'memory_tenant_records', CAST(count(*) AS DOUBLE), agent_id FROM last WHERE NOT deleted GROUP BY agent_id""", "versions", more=LAST)
sql("promote_images", f"SELECT session_id, local_id, 'episodic' AS type, strlen(data) AS bytes FROM ring WHERE created + 3600000 > {BASE + 3_700_000} AND local_id % 2 = 0", "sessions", more=RING.format(f"WHERE created <= {BASE + 3_700_000}"))
sql("ring_after_promote", f"SELECT session_id, local_id FROM ring WHERE created + 3600000 > {BASE + 3_700_000} AND local_id % 2 = 1", "sessions", more=RING.format(f"WHERE created <= {BASE + 3_700_000}"))
sql("replica_apply", "SELECT op, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT n.id, CASE WHEN n.deleted THEN 'delete' WHEN o.id IS NULL THEN 'insert' WHEN o.data = n.data AND o.updated = n.updated THEN 'same' ELSE 'update' END AS op FROM last n LEFT JOIN (SELECT * FROM versions WHERE seq <= 5000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) o ON o.id = n.id) GROUP BY op", "versions", more=LAST)
_given = ", ".join(f"('{hashlib.sha256(x.encode()).hexdigest()[:12]}', {_lit(n) if n else 'NULL'}, '{c}')" for x, n, c in Q.TOKENS if x != "beta")
sql("token_operations", f"SELECT * FROM (VALUES {_given}, ('{hashlib.sha256(b'delta').hexdigest()[:12]}', 'src3', 'rw')) AS t(fingerprint, namespace, scope)")
