"""All registered queries with their oracle SQL, by name. Names follow the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import text as T
from tallgrass.operators import changes, events, extract, filters, graph, lint, memory, prose, search
from tallgrass.plans import bindings as B
from tallgrass.sources import files, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, run: Callable, sql: str | None = None, *ctes: str) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = ("WITH " + ", ".join(f"{c} AS ({B.CTES[c]})" for c in ctes) + " " if ctes else "") + sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


SAVED = "CAST(coalesce(sum(original_tokens - compressed_tokens), 0) AS BIGINT) AS savings"
register("telemetry_stats_by_layer", lambda s, d: events.stats_by_layer(B.telemetry(s, d)), f"SELECT layer, count(*) AS events, CAST(coalesce(sum(original_tokens), 0) AS BIGINT) AS original_tokens, CAST(coalesce(sum(compressed_tokens), 0) AS BIGINT) AS compressed_tokens, {SAVED} FROM telemetry GROUP BY layer", "telemetry")
register("telemetry_savings_pct", lambda s, d: events.savings_percent(B.telemetry(s, d), "session"), "SELECT session, round(CASE WHEN sum(original_tokens) > 0 THEN 100.0::DOUBLE * sum(original_tokens - compressed_tokens) / sum(original_tokens) ELSE 0 END, 6) AS savings_pct FROM telemetry GROUP BY session", "telemetry")
register("telemetry_rollup", lambda s, d: events.telemetry_rollup(B.telemetry(s, d)), f"SELECT layer, feature, count(*) AS events, {SAVED} FROM telemetry GROUP BY ROLLUP (layer, feature)", "telemetry")
register("pending_count_by_session", lambda s, d: events.pending_by_session(B.turns(s, d)), "SELECT session_id, count(*) AS pending FROM turns WHERE rolled_up_into IS NULL GROUP BY session_id", "turns")
COMPACT = "count(*) AS event_count, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum(compressed_tokens) AS BIGINT) AS compressed_tokens, count(*) FILTER (status = 'err') AS errors, arg_min(tool, turn) AS first_tool"
register("session_compact", lambda s, d: events.compact(B.turns(s, d)), f"SELECT session_id, {COMPACT} FROM turns GROUP BY session_id", "turns")
register("auto_compact_every_n", lambda s, d: events.auto_compact(B.turns(s, d), 3), f"SELECT session_id, window_no, {COMPACT} FROM (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1) // 3 AS window_no, count(*) OVER (PARTITION BY session_id) AS n FROM turns) WHERE (window_no + 1) * 3 <= n GROUP BY session_id, window_no", "turns")
register("session_digest_buckets", lambda s, d: events.digest_buckets(B.turns(s, d), whole_commands=True).where("place <= 5").drop("more"), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, bucket ORDER BY n DESC, item ASC NULLS LAST) AS place FROM (SELECT session_id, CASE tool WHEN 'Read' THEN 'read' WHEN 'Bash' THEN 'bash' ELSE 'search' END AS bucket, target AS item, count(*) AS n, count(*) FILTER (status = 'err') AS errors FROM turns GROUP BY ALL)) WHERE place <= 5", "turns")
register("latest_turn_per_session", lambda s, d: events.latest_turn(B.turns(s, d)), "SELECT session_id, max(turn) AS turn, arg_max(tool, turn) AS tool, arg_max(target, turn) AS target, arg_max(status, turn) AS status FROM turns GROUP BY session_id", "turns")
WORDS2 = r"list_distinct(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 2))"
register("loop_detect", lambda s, d: events.detect_loops(B.messages(s, d)), f"""WITH m AS (SELECT conv_id AS session_id, turn, CASE role WHEN 'user' THEN 'user' ELSE 'tool' END AS stream, {WORDS2} AS words FROM conversations WHERE trim(text) <> ''),
p AS (SELECT *, list(words) OVER (PARTITION BY session_id, stream ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before FROM m),
j AS (SELECT session_id, turn, stream, round(coalesce(list_max(list_transform(before, lambda b: CASE WHEN len(list_distinct(list_concat(b, words))) = 0 THEN 0 ELSE len(list_intersect(b, words)) / len(list_distinct(list_concat(b, words))) END)), 0), 6) AS similarity FROM p)
SELECT session_id, turn, stream, similarity, similarity >= 0.7 AND sum(CAST(similarity >= 0.7 AS INT)) OVER (PARTITION BY session_id ORDER BY turn) <= 2 AS is_loop FROM j""")
register("drift_history", lambda s, d: events.drift(B.table(s, d, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("version"), F.col("lang").alias("hash"))), "SELECT *, CAST(sum(CAST(changed AS INT)) OVER (PARTITION BY path ORDER BY version) AS BIGINT) AS changes FROM (SELECT source AS path, doc_id AS version, lang AS hash, coalesce(lang <> lag(lang) OVER (PARTITION BY source ORDER BY doc_id), false) AS changed FROM documents)")
register("read_cache_decisions", lambda s, d: events.read_decisions(B.reads(s, d)), "SELECT *, CASE WHEN blocked THEN 'blocked' WHEN mtime IS NULL OR seen IS NULL THEN 'allow' WHEN abs(mtime - seen) < 0.001 THEN 'redundant' WHEN size <= 51200 THEN 'delta' ELSE 'allow' END AS decision FROM (SELECT * EXCLUDE (seen), seen, row_number() OVER (PARTITION BY session_id, path ORDER BY seq) AS reads FROM (SELECT user_id AS session_id, event_type AS path, event_id AS seq, floor(value / 100) AS mtime, CAST(round(value * 200) AS BIGINT) AS size, event_type = 'signup' AS blocked, lag(floor(value / 100)) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS seen FROM events))".replace("SELECT *, CASE", "SELECT session_id, path, seq, mtime, size, blocked, reads, CASE", 1))
def _health(s, d):
    t = B.telemetry(s, d).withColumn("saved", F.col("original_tokens") - F.col("compressed_tokens"))
    facts = t.groupBy(F.col("session").cast("string").alias("project")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("layer").alias("active_layers"), F.count_if(F.col("layer") == "view").alias("cache_events"), F.coalesce(100.0 * F.sum(F.when(F.col("layer") == "view", F.col("saved"))) / F.sum(F.when(F.col("layer") == "view", F.col("original_tokens"))), F.lit(0.0)).alias("cache_savings_pct"), F.max(F.when(F.col("session") % 3 != 0, F.col("original_tokens"))).alias("doc_tokens"))
    return events.health(facts.withColumn("doc_limit", F.lit(4500)))


register("health_score", _health, """SELECT project, CAST(score AS BIGINT) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM (
SELECT project, greatest(0, least(100, 75 + CASE WHEN doc IS NULL THEN -3 WHEN doc <= 4500 THEN 5 ELSE -5 END + CASE WHEN n = 0 THEN -2 ELSE 5 END + CASE WHEN cn >= 5 AND pct < 5 THEN -3 ELSE 0 END + CASE WHEN layers <= 3 THEN -5 ELSE 0 END)) AS score FROM (
SELECT CAST(session AS VARCHAR) AS project, count(*) AS n, count(DISTINCT layer) AS layers, count(*) FILTER (layer = 'view') AS cn, coalesce(100.0 * sum(original_tokens - compressed_tokens) FILTER (layer = 'view') / sum(original_tokens) FILTER (layer = 'view'), 0) AS pct, max(original_tokens) FILTER (session % 3 <> 0) AS doc FROM telemetry GROUP BY session))""", "telemetry")
register("token_estimate", lambda s, d: B.docs(s, d).select("id", T.token_estimate(F.col("text")).alias("tokens")), "SELECT doc_id AS id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
register("content_dedup", lambda s, d: changes.first_of_content(B.docs(s, d).withColumnRenamed("text", "content")), "SELECT substr(sha256(coalesce(text, '')), 1, 32) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
register("snapshot_diff", lambda s, d: changes.difference(changes.snapshot(B.files(s, d, "present")), changes.snapshot(B.files(s, d, "stored"))), "SELECT coalesce(c.path, s.path) AS path, CASE WHEN s.hash IS NULL THEN 'added' WHEN c.hash IS NULL THEN 'removed' WHEN c.hash <> s.hash THEN 'modified' ELSE 'unchanged' END AS change FROM present AS c FULL JOIN stored AS s ON c.path = s.path", "stored", "present")
register("snapshot_upsert", lambda s, d: changes.upsert(changes.snapshot(B.files(s, d, "stored")), changes.snapshot(B.files(s, d, "present")), ["path"]).select("path", "hash"), "SELECT * FROM present UNION ALL SELECT * FROM stored WHERE path NOT IN (SELECT path FROM present)", "stored", "present")
register("purge_removed", lambda s, d: changes.delete_keys(changes.snapshot(B.files(s, d, "stored")), changes.snapshot(B.files(s, d, "present")), ["path"]).select("path"), "SELECT path FROM stored WHERE path NOT IN (SELECT path FROM present)", "stored", "present")
RATE, FLOOR = ("CASE kind " + " ".join(f"WHEN '{r[0]}' THEN {r[i]}::DOUBLE" for r in memory.DECAY) + f" ELSE {e} END" for i, e in ((1, 1.0), (2, 0.1)))
DECAYED = f"greatest({FLOOR}, relevance * pow({RATE}, greatest(0, {B.NOW} - last_seen) / 86400.0::DOUBLE))"
register("decay_scores", lambda s, d: B.observations(s, d).select("id", "kind", F.round(memory.decayed(B.NOW), 6).alias("score")), f"SELECT id, kind, round({DECAYED}, 6) AS score FROM observations", "observations")
register("decay_pass_stats", lambda s, d: memory.decay_pass(B.observations(s, d), B.NOW), f"SELECT count(*) AS scanned, count(*) FILTER (abs(new - relevance) > 1e-6) AS updated, count(*) FILTER (new <= low AND low < 0.2) AS archived FROM (SELECT *, {DECAYED} AS new, {FLOOR} AS low FROM observations WHERE NOT archived AND {RATE} < 1)", "observations")
RECALL = f"SELECT id, kind, importance, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT *, round(importance / 5.0::DOUBLE * {DECAYED}, 6) AS score FROM (SELECT * FROM observations WHERE NOT archived {{}} ORDER BY importance DESC, relevance DESC, last_seen DESC, id LIMIT {{}}))"
register("recall_no_query", lambda s, d: memory.recall(B.observations(s, d), B.NOW, limit=25), RECALL.format("", 25), "observations")
register("recall_keyword", lambda s, d: memory.recall(B.observations(s, d), B.NOW, ["the", "of"], ["project", "decision", "reference"], 20), RECALL.format("AND kind IN ('project', 'decision', 'reference') AND list_contains(w, 'the') AND list_contains(w, 'of')", 20).replace("FROM observations WHERE", f"FROM (SELECT *, {WORDS2.replace('text', 'content', 1).replace('regexp_split_to_array(translate(content', 'regexp_split_to_array(translate(content').replace('_to_content', '_to_text')} AS w FROM observations) WHERE"), "observations")
register("observations_by_kind_topk", lambda s, d: memory.top_by_kind(B.observations(s, d)), "SELECT kind, id, importance, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY importance DESC, id DESC) AS place FROM observations WHERE NOT archived) WHERE place <= 5", "observations")
register("remember_dedup", lambda s, d: memory.remember(B.observations(s, d)).select("project", "id", "kind", "importance", "access_count"), "SELECT project, min(id) AS id, arg_min(kind, id) AS kind, arg_min(importance, id) AS importance, count(*) - 1 AS access_count FROM (SELECT *, substr(content, 1, 40) AS title FROM observations) WHERE trim(title) <> '' AND trim(content) <> '' GROUP BY project, kind, title, content", "observations")
# retrieval
VEC = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
COS = "SELECT vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(q, q)), 6) AS score FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
vectors = lambda s, d: B.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
register("dense_scores", lambda s, d: search.cosine(vectors(s, d), B.query_vector(s, d)), COS)
register("dense_topk", lambda s, d: search.top(search.cosine(vectors(s, d), B.query_vector(s, d)), 50), f"SELECT * FROM ({COS}) ORDER BY score DESC, id LIMIT 50")
QUERY = ["then", "of", "in", "st", "thing"]
LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _bm25_sql(counts: list[str], length: str) -> str:
    cols = ", ".join(f"{c} AS c{i}" for i, c in enumerate(counts))
    dfs = ", ".join(f"count(*) FILTER (c{i} > 0) AS d{i}" for i in range(len(counts)))
    parts = " + ".join(f"greatest(1e-6, ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE))) * c{i} * 2.2::DOUBLE / (c{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))" for i in range(len(counts)))
    return f"SELECT id, round({parts}, 6) AS score FROM (SELECT doc_id AS id, {length} AS len, {cols} FROM (SELECT doc_id, {LOW} AS low, list_filter(regexp_split_to_array({LOW}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 1) AS w FROM documents)), (SELECT count(*) AS n, avg(len) AS a, {dfs} FROM (SELECT {length} AS len, {cols} FROM (SELECT {LOW} AS low, list_filter(regexp_split_to_array({LOW}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 1) AS w FROM documents))) WHERE " + " OR ".join(f"c{i} > 0" for i in range(len(counts)))


BM25 = _bm25_sql([f"len(list_filter(w, lambda x: x = '{q}'))" for q in QUERY], "len(w)")
TRI = _bm25_sql([f"(length(low) - length(replace(low, '{q}', ''))) // {len(q)}" for q in QUERY if len(q) >= 3], "greatest(length(low) - 2, 0)")
register("bm25_scores", lambda s, d: search.bm25(B.docs(s, d), QUERY), BM25)
register("bm25_topk", lambda s, d: search.top(search.bm25(B.docs(s, d), QUERY), 50), f"SELECT * FROM ({BM25}) ORDER BY score DESC, id LIMIT 50")
register("trigram_match", lambda s, d: search.top(search.trigram_bm25(B.docs(s, d), QUERY), 50), f"SELECT * FROM ({TRI}) ORDER BY score DESC, id LIMIT 50")
register("rrf_fusion", lambda s, d: search.fuse({"bm25": search.top(search.bm25(B.docs(s, d), QUERY)), "dense": search.top(search.cosine(vectors(s, d), B.query_vector(s, d)))}), f"WITH b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({BM25}) QUALIFY r <= 50), v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({COS}) QUALIFY r <= 50) SELECT coalesce(b.id, v.id) AS id, coalesce(b.r, 0) AS bm25_rank, coalesce(v.r, 0) AS dense_rank, round(coalesce(1.0::DOUBLE / (60 + b.r), 0) + coalesce(1.0::DOUBLE / (60 + v.r), 0), 6) AS score FROM b FULL JOIN v ON b.id = v.id")
register("hybrid_search", lambda s, d: search.hybrid(B.docs(s, d), vectors(s, d), B.query_text(s, d), B.query_vector(s, d)))
VOCAB = "SELECT DISTINCT unnest(regexp_split_to_array(" + LOW + ", '[^a-z]+')) AS term FROM documents"
register("fuzzy_terms", lambda s, d: search.correct(["thme", "thign", "witg", "xyzzyq", "tat"], B.docs(s, d).select(F.explode(F.split(T.ascii_lower(F.col("text")), "[^a-z]+")).alias("term")).where("length(term) >= 3").distinct()), f"SELECT word, min(distance_term).t AS term, min(distance_term).d AS distance FROM (SELECT word, {{'d': levenshtein(word, term), 't': term}} AS distance_term FROM (SELECT unnest(['thme', 'thign', 'witg', 'xyzzyq', 'tat']) AS word), ({VOCAB}) WHERE length(term) >= 3 AND abs(length(word) - length(term)) <= 1 AND levenshtein(word, term) <= 1) GROUP BY word")
# graph
register("symbol_like", lambda s, d: graph.symbols_like(B.nodes(s, d), "er#000", 30), "SELECT * FROM nodes WHERE name ILIKE '%er#000%' OR qn ILIKE '%er#000%' ORDER BY name, qn LIMIT 30", "nodes")
register("callers_of", lambda s, d: graph.callers_of(B.nodes(s, d), B.edges(s, d), "nation::3"), "SELECT * FROM nodes WHERE qn IN (SELECT source FROM edges WHERE target IN ('nation::3', '3') OR starts_with(target, 'nation::3::') OR starts_with(target, '3::'))", "nodes", "edges")
register("callees_of", lambda s, d: graph.callees_of(B.nodes(s, d), B.edges(s, d), "customer::7"), "SELECT * FROM nodes WHERE qn IN (SELECT target FROM edges WHERE source = 'customer::7') OR name IN (SELECT target FROM edges WHERE source = 'customer::7')", "nodes", "edges")
register("impact_radius", lambda s, d: graph.impact(B.edges(s, d), "region::1", 2), "SELECT qn, CAST(min(depth) AS BIGINT) AS depth FROM (SELECT source AS qn, 1 AS depth FROM edges WHERE target = 'region::1' UNION ALL SELECT b.source, 2 FROM edges AS a JOIN edges AS b ON b.target = a.source WHERE a.target = 'region::1') WHERE qn <> 'region::1' GROUP BY qn", "edges")
register("unresolved_edges", lambda s, d: graph.unresolved(B.nodes(s, d), B.bare_edges(s, d)), "SELECT * FROM bare_edges WHERE target NOT IN (SELECT qn FROM nodes)", "nodes", "edges", "bare_edges")
register("resolve_unique_leaf", lambda s, d: graph.resolve_unique(B.nodes(s, d), B.bare_edges(s, d)), "SELECT source, u.qn AS target, round(least(1.0, confidence + 0.1), 6) AS confidence FROM bare_edges AS e JOIN (SELECT name, min(qn) AS qn FROM nodes GROUP BY name HAVING count(*) = 1) AS u ON e.target = u.name WHERE e.target NOT IN (SELECT qn FROM nodes)", "nodes", "edges", "bare_edges")
register("outline_topn", lambda s, d: graph.outline(B.nodes(s, d), 20), "SELECT qn, name, file, line, place, more FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, qn) AS place, greatest(0, count(*) OVER (PARTITION BY file) - 20) AS more FROM nodes) WHERE place <= 20", "nodes")
register("graph_counts", lambda s, d: B.nodes(s, d).groupBy("file").agg(F.count(F.lit(1)).alias("symbols")), "SELECT file, count(*) AS symbols FROM nodes GROUP BY file", "nodes")
# text
register("filter_head_tail", lambda s, d: B.docs(s, d).select("id", F.sha2(T.head_tail(F.col("text"), 2, 1).cast("binary"), 256).alias("digest")), "SELECT doc_id AS id, sha256(CASE WHEN len(l) <= 3 THEN text ELSE array_to_string(list_concat(l[1:2], ['…'], l[len(l):len(l)]), chr(10)) END) AS digest FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)")
register("filter_max_lines", lambda s, d: B.docs(s, d).select("id", F.sha2(T.max_lines(F.col("text"), 2).cast("binary"), 256).alias("digest")), "SELECT doc_id AS id, sha256(CASE WHEN len(l) <= 2 THEN text ELSE concat(array_to_string(l[1:2], chr(10)), chr(10), '… [+', len(l) - 2, ' lines truncated]') END) AS digest FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)")
register("truncate_lines", lambda s, d: B.docs(s, d).select("id", F.sha2(T.truncate_lines(F.col("text"), 40).cast("binary"), 256).alias("digest")), "SELECT doc_id AS id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) > 40 THEN substr(x, 1, 39) || '…' ELSE x END), chr(10))) AS digest FROM documents")
register("strip_lines", lambda s, d: B.docs(s, d).select("id", F.sha2(T.drop_lines(F.col("text"), ["^The ", "!!$"]).cast("binary"), 256).alias("digest")), "SELECT doc_id AS id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(^The )|(!!$)')), chr(10))) AS digest FROM documents")
PHRASES = "coalesce(" + ", ".join(f"CASE WHEN contains({LOW}, '{p}') THEN '{p}' END" for p in T.MARKETING_PHRASES) + ")"
register("marketing_phrase_scan", lambda s, d: B.docs(s, d).select("id", T.marketing_phrase(F.col("text")).alias("phrase")), f"SELECT doc_id AS id, {PHRASES} AS phrase FROM documents")
register("ignored_paths", lambda s, d: B.table(s, d, "documents").select("doc_id", T.ignored(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), ["src1*/**", "*7", "src?/de/*"]).alias("ignored")), "SELECT doc_id, regexp_matches(p, '^(?:src1[^/]*/.*|[^/]*7|src[^/]/de/[^/]*)$') OR regexp_matches(string_split(p, '/')[-1], '^(?:src1[^/]*/.*|[^/]*7|src[^/]/de/[^/]*)$') AS ignored FROM (SELECT doc_id, concat_ws('/', source, lang, doc_id) AS p FROM documents)")
BANNER = "coalesce(length(t) >= 10 AND contains('" + T.BANNER_CHARS + "', f) AND f <> '' AND length(regexp_replace(replace(t, f, ''), '[ \\t]', '', 'g')) = 0, false)"
register("banner_scan", lambda s, d: B.docs(s, d).select("id", F.posexplode(F.split("text", "\n")).alias("line", "body")).where(T.is_banner(F.col("body")) | T.is_goal_header(F.col("body")) | T.has_layer_label(F.col("body"))).select("id", (F.col("line") + 1).cast("long").alias("line")), f"SELECT id, line FROM (SELECT id, line, body, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS t, substr(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), 1, 1) AS f, lower(regexp_replace(regexp_replace(body, '^[# \\t]+', ''), '^\\s+|\\s+$', '', 'g')) AS g FROM (SELECT doc_id AS id, CAST(i AS BIGINT) AS line, string_split(text, chr(10))[i] AS body FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))) WHERE {BANNER} OR regexp_matches(g, '^goals?:|^goals?$') OR regexp_matches(' ' || lower(body) || ' ', '[^a-z0-9_]layer ([0-9]+|[xn])[^a-z0-9_]')")
# procedural text transforms (no SQL form)
for _name, _fn in (("hash_embed", prose.hash_embed), ("humanise", prose.humanise), ("shrink_prose", prose.shrink), ("structural_digest", prose.structural_digest), ("chunk_paragraphs", prose.chunk)):
    register(_name, lambda s, d, f=_fn: f(B.docs(s, d)))
register("line_delta", lambda s, d: prose.line_delta(B.docs(s, d).withColumn("old", F.col("text")).withColumn("new", F.regexp_replace("text", "(?m)^The ", "A "))))
# command filters and permissions
COMMANDS = ["git status", "git log --oneline -5", "git log", "git branch -a", "git diff --stat", "cargo build", "cargo test --all", "cargo clippy", "npm install", "yarn run dev", "npx jest", "openclaw status", "openclaw logs", "openclaw mcp list", "openclaw mcp show x", "ls -la", "cat file.txt"]


def _outputs(s, d):
    command = F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), (F.col("doc_id") % len(COMMANDS) + 1).cast("int"))
    return B.table(s, d, "documents").select(F.col("doc_id").alias("id"), command.alias("command"), "text")


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _filter_sql(f: filters.Filter) -> str:
    """The stages of one filter in DuckDB, as (text, kind)."""
    line = "x"
    for pattern, new in f.replace:
        line = f"regexp_replace({line}, {_quoted(pattern)}, {_quoted(new.replace('$1', chr(92) + '1'))}, 'g')"
    keep = f"NOT regexp_matches(x, {_quoted('|'.join(f'(?:{p})' for p in f.strip))})" if f.strip else "true"
    wide = f"CASE WHEN length(x) > {f.width} THEN concat(x[1:{f.width - 1}], '…') ELSE x END" if f.width else "x"
    ends = f"CASE WHEN len(l) <= {f.head + f.tail} THEN l ELSE list_concat(list_concat(l[1:{f.head}], ['…']), l[len(l) - {f.tail} + 1:len(l)]) END" if f.head or f.tail else "l"
    most = f"CASE WHEN len(l) <= {f.most} THEN l ELSE list_concat(l[1:{f.most}], [concat('… [+', len(l) - {f.most}, ' lines truncated]')]) END" if f.most else "l"
    whole = "".join(f"WHEN regexp_matches(whole, {_quoted(p if p.startswith('(?') else '(?m)' + p)}) THEN {{}} " for p, _ in f.match)
    pick = lambda i, rest: f"CASE {whole.format(*[_quoted((m, 'matched')[i]) for _, m in f.match])}{rest} END"
    bare = r"regexp_replace(regexp_replace(array_to_string(l, chr(10)), '^(?:[ \t]*\n)+', ''), '(?:\n[ \t]*)+$', '')"
    blank = f"WHEN trim(t) = '' THEN {{}} ELSE {{}}"
    text = pick(0, blank.format(_quoted(f.on_empty or ""), "t"))
    kind = pick(1, blank.format(_quoted("on_empty" if f.on_empty is not None else "filtered"), "'filtered'"))
    raw = "string_split(text, chr(10))"
    lines = f"list_transform(CASE WHEN {raw}[-1] = '' THEN {raw}[1:len({raw}) - 1] ELSE {raw} END, lambda x: {line})"
    return f"SELECT id, command, {text} AS filtered, {kind} AS kind FROM (SELECT *, {bare} AS t FROM (SELECT id, command, whole, {most} AS l FROM (SELECT id, command, whole, {ends} AS l FROM (SELECT id, command, array_to_string(l, chr(10)) AS whole, list_transform(list_filter(l, lambda x: {keep}), lambda x: {wide}) AS l FROM (SELECT id, command, {lines} AS l FROM named WHERE filter = {_quoted(f.name)})))))"


OUTPUTS = f"SELECT doc_id AS id, {COMMANDS}[doc_id % {len(COMMANDS)} + 1] AS command, text FROM documents"
WHICH = "CASE " + " ".join(f"WHEN regexp_matches(command, {_quoted(f.command)}) THEN {_quoted(f.name)}" for f in filters.BUILTIN) + " END"
register("filter_dispatch", lambda s, d: _outputs(s, d).select("id", "command", filters.which(F.col("command")).alias("filter")), f"SELECT id, command, {WHICH} AS filter FROM ({OUTPUTS})")
FILTERED = f"WITH named AS (SELECT id, command, text, {WHICH} AS filter FROM ({OUTPUTS}) WHERE octet_length(encode(text)) <= {filters.MAX_BYTES}), done AS (" + " UNION ALL ".join(map(_filter_sql, filters.BUILTIN)) + ") "
register("filter_apply", lambda s, d: filters.run(_outputs(s, d)).select("id", "command", F.sha2(F.col("filtered").cast("binary"), 256).alias("digest"), "kind"), FILTERED + "SELECT id, command, sha256(filtered) AS digest, kind FROM done")
register("filter_savings", lambda s, d: filters.run(_outputs(s, d)).groupBy("filter").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("tokens_before") - F.col("tokens_after")).alias("savings")), FILTERED + "SELECT filter, count(*) AS runs, CAST(sum(ceil(length(text) / 4) - ceil(length(filtered) / 4)) AS BIGINT) AS savings FROM named JOIN done USING (id) GROUP BY filter")
ALLOW, DENY = ["Bash(the very:*)", "Node"], ["Bash(and)", "py", "*(of the)"]
register("permission_check", lambda s, d: B.table(s, d, "documents").withColumn("runtime", F.element_at(F.split(F.lit("bash python node"), " "), (F.col("doc_id") % 3 + 1).cast("int"))).select("doc_id", "runtime", filters.permission(F.col("runtime"), F.col("text"), ALLOW, DENY).alias("p")).select("doc_id", "runtime", "p.decision", "p.rule"),
         """SELECT doc_id, runtime, CASE WHEN rule IS NULL THEN 'allow' ELSE 'deny' END AS decision, rule FROM (SELECT *, CASE WHEN (runtime = 'bash' AND contains(text, 'the very')) OR runtime = 'node' THEN NULL WHEN runtime = 'bash' AND contains(text, 'and') THEN 'Bash(and)' WHEN runtime = 'python' THEN 'py' WHEN contains(text, 'of the') THEN '*(of the)' END AS rule
FROM (SELECT *, ['bash', 'python', 'node'][doc_id % 3 + 1] AS runtime FROM documents))""")
# hygiene and source extraction
_sources = lambda s, d: B.table(s, d, "documents").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), "text")
MD = "SELECT concat(source, '/', doc_id, '.md') AS path, unnest(string_split(text, chr(10))) AS raw FROM documents"
register("line_kinds", lambda s, d: lint.classify(_sources(s, d), "path", "kind").groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n")), f"SELECT path, CASE WHEN trim(raw) = '' THEN 'blank' ELSE 'prose' END AS kind, count(*) AS n FROM ({MD}) GROUP BY ALL")


def _comments(s, d):
    """Documents as configuration files: first words that begin with an upper-case letter of A-F become banners, of G-M praise."""
    text = F.regexp_replace(F.regexp_replace("text", "(?m)^[A-F].*$", "# =========="), "(?m)^[G-M].*$", "# a world-class thing")
    return B.table(s, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".toml")).alias("path"), text.alias("text"))


COMMENTED = "SELECT concat(doc_id, '.toml') AS path, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents"
BROKEN = f"SELECT path, line, CASE WHEN regexp_matches(raw, '^[A-F]') THEN 'decorative_banner' ELSE 'marketing_phrase' END AS rule_id FROM ({COMMENTED}) WHERE regexp_matches(raw, '^[A-M]')"
register("lint_violations", lambda s, d: lint.violations(lint.classify(_comments(s, d))).select("path", "line", "rule_id", "severity"), f"SELECT *, CASE rule_id WHEN 'decorative_banner' THEN 'error' ELSE 'warn' END AS severity FROM ({BROKEN})")
register("lint_report", lambda s, d: lint.report(lint.classify(_comments(s, d), "path"), lint.violations(lint.classify(_comments(s, d)))), f"SELECT (SELECT count(*) FROM documents) AS files_scanned, count(DISTINCT path) AS files_with_violations, count(*) AS violations, count(*) FILTER (rule_id = 'decorative_banner') AS errors FROM ({BROKEN})")
register("lint_fix", lambda s, d: lint.rewrite(_comments(s, d)).select("path", "lines_removed"), f"SELECT path, count(*) AS lines_removed FROM ({BROKEN}) WHERE rule_id = 'decorative_banner' GROUP BY path")


def _code(s, d):
    """One Python file per customer that imports and calls its nation's function."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    text = F.concat(F.lit("from nation import n"), n, F.lit("\n\ndef c"), k, F.lit("():\n    n"), n, F.lit("()\n    c"), k, F.lit("()\n    other(1)\n"))
    dealt = B.table(s, d, "customer").select("c_custkey", "c_nationkey").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "c_custkey")  # few bytes, much to parse
    return dealt.select(F.concat(F.lit("app/"), k, F.lit(".py")).alias("path"), F.lit("python").alias("lang"), text.alias("text"))


FILE = "concat('app/', c_custkey, '.py') AS file"
OWN = "concat('app::', c_custkey, '::c', c_custkey)"
register("extract_symbols", lambda s, d: extract.nodes_of(extract.extract(_code(s, d))).select("kind", "name", "qn", "file", "line", "line_end"), f"SELECT 'File' AS kind, concat(c_custkey, '.py') AS name, concat('app::', c_custkey, ':file') AS qn, {FILE}, 1::BIGINT AS line, 7::BIGINT AS line_end FROM customer UNION ALL SELECT 'Function', concat('c', c_custkey), {OWN}, {FILE}, 3, 6 FROM customer")
register("resolve_calls", lambda s, d: extract.resolve(extract.extract(_code(s, d))), f"""SELECT 'ImportsFrom' AS kind, concat('app::', c_custkey, ':file') AS source, concat('from nation import n', c_nationkey) AS target, {FILE}, 1::BIGINT AS line, 0.7::DOUBLE AS confidence, 'inferred' AS tier FROM customer
UNION ALL SELECT 'Calls', {OWN}, concat('nation::n', c_nationkey), {FILE}, 4, 0.8, 'resolved' FROM customer UNION ALL SELECT 'Calls', {OWN}, {OWN}, {FILE}, 5, 0.8, 'resolved' FROM customer UNION ALL SELECT 'Calls', {OWN}, 'other', {FILE}, 6, 0.6, 'inferred' FROM customer""")
register("observations_markdown", lambda s, d: sinks.markdown(B.observations(s, d).withColumn("title", F.substring("content", 1, 40)), B.KINDS, 10**6), f"SELECT kind, CAST(list_position({list(B.KINDS)}, kind) AS BIGINT) AS place, count(*) AS n, concat('## ', kind, chr(10), chr(10), string_agg(concat('- [', importance, '] ', regexp_replace(content[1:40], '\\s+', ' ', 'g')), chr(10) ORDER BY importance DESC, id DESC)) AS body FROM observations WHERE NOT archived GROUP BY kind", "observations")
_events = lambda s, d: B.table(s, d, "conversations").select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("sessionId"), F.col("role").alias("tool"), F.col("turn").alias("original_tokens"))).alias("value"))
register("json_events", lambda s, d: files.json_events(_events(s, d)), "SELECT CAST(conv_id AS VARCHAR) AS session_id, role AS tool_name, CAST(NULL AS VARCHAR) AS target, 'ok' AS status, turn AS original_tokens, 0::BIGINT AS compressed_tokens, '' AS summary, false AS malformed FROM conversations")
