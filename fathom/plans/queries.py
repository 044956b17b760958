"""Every operator as a query on the test tables, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import prompts as P
from fathom.functions import scalar as S
from fathom.operators import codeindex as C
from fathom.operators import graphs as N
from fathom.operators import hooks as H
from fathom.operators import imports as G
from fathom.operators import memory as M
from fathom.operators import references as E
from fathom.operators import repos as D
from fathom.operators import review as V
from fathom.operators import rewards as W
from fathom.operators import rules as R
from fathom.operators import similar as Y
from fathom.operators import trigrams as T
from fathom.plans import projections as J
from fathom.plans.projections import sql, t
from fathom.sources import scan as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

COS = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
R4 = "floor({} * 10000.0 + 0.5) / 10000.0"
R3 = "floor({} * 1000.0 + 0.5) / 1000.0"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return keep


def q4(c):
    return S.half_up(F.col(c) if isinstance(c, str) else c, 4)


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return list(t(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


@query("vector_topk", f"SELECT vec_id AS id, {R4.format('s')} AS similarity FROM (SELECT vec_id, {COS.format('embedding', Q0)} AS s FROM embeddings) WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return M.search(t(spark, d, "embeddings"), first_vector(spark, d), 10, 0.2, "vec_id").select("id", q4("similarity").alias("similarity"))


@query("vector_topk_batch", f"SELECT query_id, id, {R4.format('s')} AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {COS.format('q.embedding', 'e.embedding')} AS s FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) WHERE s >= 0.1) WHERE rank <= 5")
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return M.search_many(rows, rows.where("id % 20 = 0"), 5, 0.1).select("query_id", "id", q4("similarity").alias("similarity"), "rank")


def _recall(where: str, least: float) -> str:
    return sql("solutions", "repos", body=f"""
near AS (SELECT r.repo_id, {COS.format('r.vector', 'o.vector')} AS rs FROM repos r, (SELECT vector FROM repos WHERE repo_id = 1) o),
sup AS (SELECT supersedes AS id, max(id) AS superseded_by FROM solutions WHERE supersedes IS NOT NULL GROUP BY supersedes),
scored AS (SELECT s.*, {COS.format('s.embedding', Q0)} AS c, rs FROM solutions s LEFT JOIN near USING (repo_id) {where}),
boosted AS (SELECT *, least(0.99, CASE WHEN repo_id = 1 THEN c * 1.15 WHEN rs > 0.3 THEN c * 1.08 ELSE c END) AS raw FROM scored),
hits AS (SELECT *, {R3.format('raw')} AS similarity FROM boosted WHERE raw >= {least})
SELECT id, CASE WHEN length(problem) > 100 THEN concat(substr(problem, 1, 100), '...') ELSE problem END AS problem, similarity, CAST(score AS DOUBLE) AS score,
  floor(CASE WHEN successes + failures > 0 THEN successes / (successes + failures) ELSE 0.5 END * 100.0 + 0.5) / 100.0 AS success_rate, superseded_by,
  (SELECT count(*) FROM hits) AS total_found FROM hits LEFT JOIN sup USING (id) ORDER BY similarity * score DESC, id LIMIT 5""")


@query("recall", _recall("", 0.1))
def recall(spark: SparkSession, d: str) -> DataFrame:
    return M.recall(J.solutions(spark, d).withColumn("score", F.col("score").cast("double")), J.repos(spark, d), first_vector(spark, d), 1, 5, 0.1, 0.3)


@query("recall_filtered", _recall("WHERE scope = 'stack' AND category = 'feature' AND complexity IS NOT NULL AND complexity <= 8", 0.02))
def recall_filtered(spark: SparkSession, d: str) -> DataFrame:
    return M.recall(J.solutions(spark, d).withColumn("score", F.col("score").cast("double")), J.repos(spark, d), first_vector(spark, d), 1, 5, 0.02, 0.3, "stack", "feature", 8)


@query("get_solution", sql("solutions", body="SELECT s.id, s.problem, CAST(1.0 AS DOUBLE) AS similarity, CAST(s.score AS DOUBLE) AS score, floor(CASE WHEN s.successes + s.failures > 0 THEN s.successes / (s.successes + s.failures) ELSE 0.5 END * 100.0 + 0.5) / 100.0 AS success_rate, (SELECT min(x.id) FROM solutions x WHERE x.supersedes = 19) AS superseded_by FROM solutions s WHERE s.id = 19"))
def get_solution(spark: SparkSession, d: str) -> DataFrame:
    return M.get_solution(J.solutions(spark, d).withColumn("score", F.col("score").cast("double")), 19)


@query("dedup_all", f"SELECT vec_id AS id FROM embeddings a WHERE NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.vec_id < a.vec_id AND {COS.format('a.embedding', 'b.embedding')} >= 0.4)")
def dedup_all(spark: SparkSession, d: str) -> DataFrame:
    _checkpoints(spark)
    return M.dedup_all(t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 0.4).select("id")


# a fold over the rows in order: a row stays unless one that stayed is among its earlier neighbours
GREEDY = f"WITH near AS (SELECT a.vec_id AS id, coalesce(list(b.vec_id) FILTER (b.vec_id IS NOT NULL), []) AS earlier FROM embeddings a LEFT JOIN embeddings b ON b.vec_id < a.vec_id AND {COS.format('a.embedding', 'b.embedding')} >= 0.4 GROUP BY a.vec_id)"


@query("dedup_greedy", f"{GREEDY} SELECT unnest(list_reduce(list_prepend(CAST([] AS BIGINT[]), list(list_prepend(id, earlier) ORDER BY id)), lambda kept, row: CASE WHEN list_has_any(kept, row[2:]) THEN kept ELSE list_append(kept, row[1]) END)) AS id FROM near")
def dedup_greedy(spark: SparkSession, d: str) -> DataFrame:
    _checkpoints(spark)
    return M.dedup_greedy(t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 0.4).select("id")


def _checkpoints(spark: SparkSession) -> None:
    """The session's checkpoint folder; a local session without one gets a folder of its own, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            where = tempfile.mkdtemp()
        context.setCheckpointDir(where)


FOLD = "list_reduce(list_prepend(0.5::DOUBLE, list(CASE outcome WHEN 'success' THEN 1.0 WHEN 'partial' THEN 2.0 WHEN 'failure' THEN 3.0 ELSE 0.0 END::DOUBLE ORDER BY ts, log_id)), lambda s, o: CASE WHEN o = 1 THEN s + 0.1::DOUBLE * (1 - s) WHEN o = 2 THEN least(1.0::DOUBLE, s + 0.03::DOUBLE) WHEN o = 3 THEN greatest(0.1::DOUBLE, s - 0.15::DOUBLE) ELSE s END)"


@query("reward_fold", sql("usage", body=f"SELECT solution_id, {R4.format(FOLD)} AS score, count(*) FILTER (outcome = 'success') AS successes, count(*) FILTER (outcome = 'partial') AS partials, count(*) FILTER (outcome = 'failure') AS failures FROM usage_log GROUP BY solution_id"))
def reward_fold(spark: SparkSession, d: str) -> DataFrame:
    return W.reward_state(J.usage(spark, d)).withColumn("score", q4("score"))


@query("usage_counters", sql("solutions", body="SELECT s.id, s.successes + coalesce(u.n, 0) AS uses, u.last AS last_used_at FROM solutions s LEFT JOIN (SELECT user_id AS id, CAST(count(*) AS BIGINT) AS n, max(ts) AS last FROM events GROUP BY user_id) u ON u.id = s.id"))
def usage_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = J.solutions(spark, d).select("id", F.col("successes").alias("uses"), F.lit(None).cast("timestamp").alias("last_used_at"))
    delta = t(spark, d, "events").select(F.col("user_id").alias("id"), F.lit(1).alias("uses"), F.col("ts").alias("last_used_at"))
    return M.apply_usage(rows, delta)


@query("success_rate", sql("solutions", body="SELECT id, floor(CASE WHEN successes + failures > 0 THEN successes / (successes + failures) ELSE 0.5 END * 100.0 + 0.5) / 100.0 AS rate FROM solutions"))
def success_rate(spark: SparkSession, d: str) -> DataFrame:
    return J.solutions(spark, d).select("id", S.success_rate(F.col("successes"), F.col("failures")).alias("rate"))


@query("auto_complexity", "SELECT doc_id, CAST(greatest(1, least(10, 1 + least(4, length(text) // 500) + least(2, doc_id % 4) + least(2, doc_id % 3) + least(2, (doc_id % 9) // 2))) AS INTEGER) AS complexity FROM documents")
def auto_complexity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return t(spark, d, "documents").select("doc_id", S.auto_complexity(F.col("text"), k % 4, k % 3, k % 9).alias("complexity"))


@query("status_counts", "SELECT 'documents' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'events', count(*) FROM events")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.table_counts({n: t(spark, d, n) for n in ("documents", "embeddings", "events")})


@query("top_tags", "SELECT tag, count(*) AS n FROM (SELECT unnest([lang, source]) AS tag FROM documents) GROUP BY tag ORDER BY n DESC, tag LIMIT 10")
def top_tags(spark: SparkSession, d: str) -> DataFrame:
    return M.top_tags(t(spark, d, "documents").select(F.array("lang", "source").alias("tags")))


@query("recent", "SELECT event_id AS id, event_type FROM events ORDER BY date_trunc('second', ts) DESC, event_id LIMIT 5")
def recent(spark: SparkSession, d: str) -> DataFrame:
    return M.recent(t(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", "ts"), "ts").select("id", "event_type")


@query("text_preview", "SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(substr(text, 1, 100), '...') ELSE text END AS preview FROM documents")
def text_preview(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", S.preview(F.col("text")).alias("preview"))


NORMAL = r"substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[0-9]+', 'N', 'g'), '[''\"`][^\n\r]*?[''\"`]', 'STR', 'g'), '/[A-Za-z0-9_\-./]+', 'PATH', 'g'), '\s+', ' ', 'g')), 1, 500)"
SIGNED = f"SELECT *, {NORMAL.format('error_message')} AS normalized, substr(sha256(concat(error_type, ':', {NORMAL.format('error_message')})), 1, 16) AS signature FROM errors"


@query("failure_signature", sql("errors", body=f"SELECT seq, normalized, signature FROM ({SIGNED})"))
def failure_signature(spark: SparkSession, d: str) -> DataFrame:
    return M.failure_rows(J.errors(spark, d)).select("seq", "normalized", "signature")


@query("failure_upsert", sql("errors", body=f"""signed AS ({SIGNED}),
stored AS (SELECT signature, min(error_type) AS error_type, 'stored' AS error_message, 'old cause' AS root_cause, CAST(NULL AS STRING) AS fix_applied, 2::BIGINT AS occurrences, CAST(NULL AS TIMESTAMP) AS resolved_at FROM signed WHERE error_type = 'build' GROUP BY signature),
n AS (SELECT signature, arg_min(error_type, (ts, seq)) AS nt, arg_min(error_message, (ts, seq)) AS nm, arg_max(root_cause, (ts, seq)) FILTER (root_cause IS NOT NULL) AS nc, arg_max(fix_applied, (ts, seq)) FILTER (fix_applied IS NOT NULL) AS nf, max(ts) FILTER (fix_applied IS NOT NULL) AS nr, count(*) AS nn FROM signed GROUP BY signature)
SELECT signature, coalesce(error_type, nt) AS error_type, coalesce(error_message, nm) AS error_message, coalesce(nc, root_cause) AS root_cause, coalesce(nf, fix_applied) AS fix_applied, coalesce(occurrences, 0) + coalesce(nn, 0) AS occurrences, coalesce(nr, resolved_at) AS resolved_at FROM stored FULL JOIN n USING (signature)"""))
def failure_upsert(spark: SparkSession, d: str) -> DataFrame:
    errors = J.errors(spark, d)
    stored = M.failure_rows(errors).where("error_type = 'build'").groupBy("signature").agg(F.min("error_type").alias("error_type"))
    stored = stored.selectExpr("signature", "error_type", "'stored' AS error_message", "'old cause' AS root_cause", "CAST(NULL AS STRING) AS fix_applied", "2L AS occurrences", "CAST(NULL AS TIMESTAMP) AS resolved_at")
    return M.upsert_failures(stored, errors)


@query("failure_search", f"SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'build' ELSE 'runtime' END AS error_type, {R3.format('s')} AS similarity FROM (SELECT vec_id, {COS.format('embedding', Q0)} AS s FROM embeddings) WHERE s >= 0.1 ORDER BY similarity DESC, id LIMIT 3")
def failure_search(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "embeddings").selectExpr("vec_id AS id", "CASE WHEN vec_id % 2 = 0 THEN 'build' ELSE 'runtime' END AS error_type", "embedding")
    return M.search_failures(rows, first_vector(spark, d), 3, 0.1)


LIKE = "lower({}) LIKE replace(replace(lower({}), '*', '%'), '?', '_')"


@query("warnings_check", sql("warnings", body=f"SELECT probe, id, severity, target, CAST(row_number() OVER (PARTITION BY probe ORDER BY repo_id IS NULL, severity DESC, id) AS INTEGER) AS place FROM (SELECT DISTINCT p_name AS probe FROM part) p, warnings w WHERE type = 'file' AND {LIKE.format('probe', 'target')} AND (repo_id IS NULL OR repo_id = 1)"))
def warnings_check(spark: SparkSession, d: str) -> DataFrame:
    probes = t(spark, d, "part").select(F.col("p_name").alias("probe"), F.lit(1).cast("long").alias("repo_id")).distinct()
    return R.check_warnings(probes, J.warnings(spark, d))


@query("warnings_packages", sql("warnings", body="SELECT probe, id, severity, target, CAST(row_number() OVER (PARTITION BY probe ORDER BY repo_id IS NULL, ecosystem IS NULL, severity DESC, id) AS INTEGER) AS place FROM (SELECT DISTINCT replace(p_name, ' ', '-') AS probe FROM part) p, warnings w WHERE type = 'package' AND probe = target AND (repo_id IS NULL OR repo_id = 1)"))
def warnings_packages(spark: SparkSession, d: str) -> DataFrame:
    probes = t(spark, d, "part").select(F.expr("replace(p_name, ' ', '-')").alias("probe"), F.lit(1).cast("long").alias("repo_id")).distinct()
    return R.check_warnings(probes, J.warnings(spark, d), "package")


@query("warnings_merge", sql("warnings", body="""n AS (SELECT id + 100000 AS id, type, target, ecosystem, repo_id, 'block' AS severity, 'new' AS reason FROM warnings WHERE id % 7 = 0 UNION ALL SELECT 999999 AS id, 'file', 'only/new', NULL, NULL, 'info', 'new'),
o AS (SELECT min(id) AS id, type, target, ecosystem, repo_id, min(severity) AS severity, min(reason) AS reason FROM warnings GROUP BY type, target, ecosystem, repo_id), nn AS (SELECT min(id) AS id, type, target, ecosystem, repo_id, min(severity) AS severity, min(reason) AS reason FROM n GROUP BY type, target, ecosystem, repo_id)
SELECT coalesce(o.id, nn.id) AS id, coalesce(o.type, nn.type) AS type, coalesce(o.target, nn.target) AS target, CASE WHEN o.id IS NOT NULL THEN o.ecosystem ELSE nn.ecosystem END AS ecosystem, CASE WHEN o.id IS NOT NULL THEN o.repo_id ELSE nn.repo_id END AS repo_id, coalesce(nn.severity, o.severity) AS severity, coalesce(nn.reason, o.reason) AS reason FROM o FULL JOIN nn ON o.type = nn.type AND o.target = nn.target AND o.ecosystem IS NOT DISTINCT FROM nn.ecosystem AND o.repo_id IS NOT DISTINCT FROM nn.repo_id"""))
def warnings_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = J.warnings(spark, d)
    keys = ["type", "target", "ecosystem", "repo_id"]
    one = lambda df: df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in ("id", "severity", "reason")]).select("id", *keys, "severity", "reason")
    new = rows.where("id % 7 = 0").selectExpr("id + 100000 AS id", *keys, "'block' AS severity", "'new' AS reason")
    new = new.unionByName(spark.sql("SELECT 999999L AS id, 'file' AS type, 'only/new' AS target, CAST(NULL AS STRING) AS ecosystem, CAST(NULL AS BIGINT) AS repo_id, 'info' AS severity, 'new' AS reason"))
    return R.merge_warnings(one(rows), one(new))


PACKAGE_FACTS = "SELECT replace(p_name, ' ', '-') AS package, max(CASE WHEN p_partkey % 17 = 0 THEN concat('use ', p_brand) END) AS deprecated, max(p_partkey * 1000) AS size, max(p_partkey * 300) AS gzip FROM part GROUP BY 1"
PACKAGE_ADVISORIES = "SELECT replace(p_name, ' ', '-') AS package, 'npm' AS ecosystem, CASE WHEN p_size > 40 THEN 'CRITICAL' ELSE 'low' END AS level FROM part WHERE p_partkey % 13 = 0"


@query("package_issues", sql("warnings", body=f"""own AS (SELECT DISTINCT replace(p_name, ' ', '-') AS package, CASE WHEN p_partkey % 9 = 0 THEN 'pip' ELSE 'npm' END AS ecosystem FROM part), facts AS ({PACKAGE_FACTS}), advisories AS ({PACKAGE_ADVISORIES})
SELECT package, ecosystem, 'cve' AS type, CASE WHEN c THEN 'critical' ELSE 'warn' END AS severity, concat(CAST(n AS STRING), CASE WHEN c THEN ' critical' ELSE ' of lower levels' END) AS detail FROM own JOIN (SELECT package, ecosystem, level = 'CRITICAL' AS c, count(*) AS n FROM advisories GROUP BY ALL) USING (package, ecosystem)
UNION ALL SELECT o.package, o.ecosystem, 'warning', CASE WHEN w.severity = 'block' THEN 'critical' ELSE w.severity END, w.reason FROM own o JOIN warnings w ON w.target = o.package AND w.type = 'package' AND coalesce(w.ecosystem, o.ecosystem) = o.ecosystem
UNION ALL SELECT package, ecosystem, 'deprecated', 'warn', substr(deprecated, 1, 100) FROM own JOIN facts USING (package) WHERE ecosystem = 'npm' AND deprecated <> ''
UNION ALL SELECT package, ecosystem, 'size', 'info', concat(CAST(CAST(floor(size / 1024.0 + 0.5) AS BIGINT) AS STRING), ' KB, gzip ', CAST(CAST(floor(gzip / 1024.0 + 0.5) AS BIGINT) AS STRING), ' KB') FROM own JOIN facts USING (package) WHERE ecosystem = 'npm' AND size > 500000"""))
def package_issues(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part")
    of = lambda text: spark.sql(text.replace("FROM part", "FROM {part}"), part=part)
    own = part.selectExpr("replace(p_name, ' ', '-') AS package", "CASE WHEN p_partkey % 9 = 0 THEN 'pip' ELSE 'npm' END AS ecosystem")
    return R.package_issues(own, J.warnings(spark, d), of(PACKAGE_ADVISORIES), of(PACKAGE_FACTS))


@query("package_audit", sql("warnings", body="SELECT package, 'npm' AS ecosystem, coalesce(w.n, 0) AS n_warnings, coalesce(a.n, 0) AS n_advisories, coalesce(w.b, false) OR coalesce(a.c, false) AS ask FROM (SELECT DISTINCT replace(p_name, ' ', '-') AS package FROM part) p LEFT JOIN (SELECT target, count(*) AS n, bool_or(severity = 'block') AS b FROM warnings WHERE type = 'package' GROUP BY target) w ON w.target = package LEFT JOIN (SELECT replace(p_name, ' ', '-') AS ap, count(*) AS n, bool_or(p_size = 50) AS c FROM part WHERE p_partkey % 13 = 0 GROUP BY 1) a ON a.ap = package"))
def package_audit(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part")
    names = part.selectExpr("replace(p_name, ' ', '-') AS package", "'npm' AS ecosystem").distinct()
    advisories = part.where("p_partkey % 13 = 0").selectExpr("replace(p_name, ' ', '-') AS package", "'npm' AS ecosystem", "CASE WHEN p_size = 50 THEN 'critical' ELSE 'low' END AS level")
    return R.audit_packages(names, J.warnings(spark, d), advisories)


PACKAGE_SQL = " ".join(f"WHEN len({names}) > 0 THEN {value}" for pattern, group, eco in P.PACKAGES for names, value in [(f"list_filter(list_transform(list_filter(regexp_split_to_array(regexp_extract(command, '{pattern}', {group}), '\\s+'), lambda w: w != '' AND NOT starts_with(w, '-')), lambda w: regexp_replace(w, '@[\\d.^~>=<]+.*$', '')), lambda w: w != '')",) * 2])


@query("command_packages", "SELECT event_id, CASE " + " ".join(f"WHEN regexp_matches(command, '{p}') THEN '{e}'" for p, _, e in P.PACKAGES) + f" END AS ecosystem, array_to_string(CASE {PACKAGE_SQL} END, ' ') AS packages FROM (SELECT event_id, {J.COMMAND} AS command FROM events)")
def command_packages(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "events").selectExpr("event_id", f"{J.COMMAND} AS command").withColumn("p", P.command_packages(F.col("command")))
    return rows.select("event_id", "p.ecosystem", F.array_join("p.packages", " ").alias("packages"))


@query("commit_commands", rf"SELECT event_id, CASE WHEN regexp_matches(command, '^\s*git\s+commit\b') THEN 'git' WHEN regexp_matches(command, '^\s*jj\s+(commit|describe|new)\b') THEN 'jj' END AS vcs FROM (SELECT event_id, {J.COMMAND} AS command FROM events)")
def commit_commands(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").selectExpr("event_id", f"{J.COMMAND} AS command").select("event_id", P.commit_system(F.col("command")).alias("vcs"))


@query("sensitive_paths", "SELECT event_id, CASE WHEN ends_with(path, '.env.example') THEN NULL " + " ".join(f"WHEN regexp_matches(path, '{P.any_of(ps)}') THEN '{c}'" for c, ps in P.SENSITIVE) + f" END AS category FROM (SELECT event_id, {J.PATH} AS path FROM events)")
def sensitive_paths(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").selectExpr("event_id", f"{J.PATH} AS path").select("event_id", P.sensitive_category(F.col("path"), [".env.example"]).alias("category"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("doc_queries", sql("prompts", body="SELECT conv_id, turn, regexp_matches(prompt, " + _quoted(P.any_of(P.DOCS)) + ") AS is_doc, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(prompt, {_quoted(f'(?i)\\b({p})\\b')}) THEN '{n}' END" for n, p in P.LIBRARIES) + "], lambda x: x IS NOT NULL), ',') AS libraries FROM prompts"))
def doc_queries(spark: SparkSession, d: str) -> DataFrame:
    return J.prompts(spark, d).select("conv_id", "turn", P.is_doc_query(F.col("prompt")).alias("is_doc"), F.array_join(P.libraries_in(F.col("prompt")), ",").alias("libraries"))


LIBRARIES_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(prompt, {_quoted(f'(?i)\\b({p})\\b')}) THEN '{n}' END" for n, p in P.LIBRARIES) + "], lambda x: x IS NOT NULL)"


@query("doc_topics", sql("prompts", body=f"SELECT conv_id, turn, CASE WHEN topic = '' THEN 'general usage' ELSE topic END AS topic FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(list_reduce(list_prepend(prompt, {LIBRARIES_SQL}), lambda a, n: regexp_replace(a, concat('(?i)\\b', n, '\\b'), '', 'g')), {_quoted(P.TOPIC_WORDS)}, '', 'g'), '\\s+', ' ', 'g')) AS topic FROM prompts)"))
def doc_topics(spark: SparkSession, d: str) -> DataFrame:
    return J.prompts(spark, d).select("conv_id", "turn", P.topic_of(F.col("prompt"), P.libraries_in(F.col("prompt"))).alias("topic"))


@query("prompt_complexity", sql("prompts", body="SELECT conv_id, turn, CAST(greatest(1, least(10, floor(3.0 + " + " + ".join(f"CASE WHEN regexp_matches(prompt, {_quoted(P.any_of(ps))}) THEN {w} ELSE 0.0 END" for w, _, ps in P.COMPLEXITY) + r" + CASE WHEN len(regexp_split_to_array(prompt, '\s+')) > 100 THEN 1.0 ELSE 0.0 END + CASE WHEN len(list_filter(regexp_split_to_array(prompt, '[.!?]+'), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')) > 10)) >= 4 THEN 1.0 ELSE 0.0 END + 0.5))) AS INTEGER) AS complexity FROM prompts"))
def prompt_complexity(spark: SparkSession, d: str) -> DataFrame:
    return J.prompts(spark, d).select("conv_id", "turn", P.prompt_complexity(F.col("prompt")).alias("complexity"))


RULES = [
    {"name": "push", "event": "bash", "pattern": "git\\s+commit", "action": "block", "message": "no commits", "priority": 5},
    {"name": "npm", "event": "bash", "pattern": "^npm", "action": "warn", "message": "npm", "priority": 9},
    {"name": "purchase", "event": "bash", "pattern": "purchase", "action": "block", "message": "no purchases", "priority": 1},
    {"name": "broken", "event": "bash", "pattern": "(", "action": "block", "message": "never", "priority": 99},
    {"name": "edit", "event": "edit", "pattern": "x", "action": "block", "message": "other event", "priority": 1},
    {"name": "add", "event": "bash", "pattern": "ADD", "action": "allow", "message": None, "priority": None},
]


@query("rule_evaluation", f"SELECT event_id AS id, array_to_string(list_filter([CASE WHEN regexp_matches(command, '(?i)^npm') THEN 'npm' END, CASE WHEN regexp_matches(command, '(?i)git\\s+commit') THEN 'push' END, CASE WHEN regexp_matches(command, '(?i)purchase') THEN 'purchase' END, CASE WHEN regexp_matches(command, '(?i)ADD') THEN 'add' END], lambda x: x IS NOT NULL), ',') AS matched, regexp_matches(command, '(?i)git\\s+commit') OR regexp_matches(command, '(?i)purchase') AS blocked, CASE WHEN regexp_matches(command, '(?i)purchase') THEN 'no purchases' WHEN regexp_matches(command, '(?i)git\\s+commit') THEN 'no commits' END AS block_message FROM (SELECT event_id, {J.COMMAND} AS command FROM events)")
def rule_evaluation(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "events").selectExpr("event_id AS id", f"{J.COMMAND} AS subject")
    return R.evaluate_rules(rows, RULES, "bash").withColumn("matched", F.array_join("matched", ","))


@query("tool_approval", "SELECT event_id, CASE WHEN event_type = 'error' THEN false WHEN event_type = 'signup' THEN true ELSE event_type IN ('click', 'view') END AS approved FROM events")
def tool_approval(spark: SparkSession, d: str) -> DataFrame:
    approved = P.auto_approved(F.col("event_type"), {"core": ["click", "view"], "web": ["purchase"]}, ["core"], never=["error"], extra=["signup"])
    return t(spark, d, "events").select("event_id", approved.alias("approved"))


AS_OF = "TIMESTAMP '2024-01-30 00:00:00'"
CACHE = "SELECT concat(event_type, ':', CAST(user_id AS STRING)) AS cache_key, props AS response, ts AS created_at, event_id AS seq FROM events"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").selectExpr("concat(event_type, ':', CAST(user_id AS STRING)) AS cache_key", "props AS response", "ts AS created_at", "event_id AS seq")


@query("cache_get", f"SELECT * FROM (SELECT cache_key, arg_max(response, (created_at, seq)) AS response, max(created_at) AS created_at FROM ({CACHE}) GROUP BY cache_key) WHERE created_at > {AS_OF} - INTERVAL 48 HOUR")
def cache_get(spark: SparkSession, d: str) -> DataFrame:
    return R.cache_get(_cache(spark, d), F.expr(AS_OF), 48)


@query("cache_purge", f"SELECT * FROM ({CACHE}) WHERE created_at >= {AS_OF} - INTERVAL 48 HOUR")
def cache_purge(spark: SparkSession, d: str) -> DataFrame:
    return R.cache_purge(_cache(spark, d), F.expr(AS_OF), 48)


@query("once_ledger", f"SELECT * FROM (SELECT event_type AS hook_name, user_id AS session_id, min(ts) AS executed_at FROM events GROUP BY 1, 2) WHERE executed_at >= {AS_OF} - INTERVAL 27 DAY")
def once_ledger(spark: SparkSession, d: str) -> DataFrame:
    return R.ledger_purge(R.ledger_mark(t(spark, d, "events").selectExpr("event_type AS hook_name", "user_id AS session_id", "ts AS executed_at")), F.expr(AS_OF), 27)


@query("find_definition", sql("files", "symbols", body="SELECT symbol_id, file_path, line, kind, exported FROM symbols JOIN files USING (file_id) WHERE name = (SELECT min(name) FROM symbols)"))
def find_definition(spark: SparkSession, d: str) -> DataFrame:
    symbols = J.symbols(spark, d)
    name = symbols.agg(F.min("name")).first()[0]
    return C.find_definitions(symbols, J.files(spark, d), name).select("symbol_id", "file_path", "line", "kind", "exported")


@query("list_exports", sql("files", "symbols", body="SELECT symbol_id, name, file_path, line FROM symbols JOIN files USING (file_id) WHERE exported AND lower(file_path) LIKE 'src/m1%'"))
def list_exports(spark: SparkSession, d: str) -> DataFrame:
    return C.list_exports(J.symbols(spark, d), J.files(spark, d), "SRC/m1").select("symbol_id", "name", "file_path", "line")


@query("search_symbols", sql("files", "symbols", body="SELECT symbol_id, name, tier FROM (SELECT *, CASE WHEN name = 'r' THEN 0 WHEN lower(name) LIKE 'r%' THEN 1 ELSE 2 END AS tier FROM symbols JOIN files USING (file_id) WHERE lower(name) LIKE '%r%') ORDER BY tier, exported DESC, length(name), file_path, line, symbol_id LIMIT 30"))
def search_symbols(spark: SparkSession, d: str) -> DataFrame:
    return C.search_symbols(J.symbols(spark, d), J.files(spark, d), "r").select("symbol_id", "name", "tier")


FOUND_BY = "SELECT symbol_id, name, tier FROM (SELECT *, CASE WHEN name = '{q}' THEN 0 WHEN lower(name) LIKE '{q}%' THEN 1 ELSE 2 END AS tier FROM symbols JOIN files USING (file_id) WHERE lower(name) LIKE '%{q}%') ORDER BY tier, exported DESC, length(name), file_path, line, symbol_id LIMIT 30"


@query("search_symbols_indexed", sql("files", "symbols", body=FOUND_BY.replace("{q}", "plat")))
def search_symbols_indexed(spark: SparkSession, d: str) -> DataFrame:
    symbols = J.symbols(spark, d)
    return T.search_postings(T.name_postings(symbols), symbols, J.files(spark, d), "plat").select("symbol_id", "name", "tier")


@query("ranked_files")
def ranked_files(spark: SparkSession, d: str) -> DataFrame:
    return T.ranked_files(J.files(spark, d), "sm1f")


@query("get_imports", sql("files", "imports", body="SELECT import_id, imported_name, local_name, source_path, line FROM imports JOIN files USING (file_id) WHERE file_path = 'src/m3/f8.ts'"))
def get_imports(spark: SparkSession, d: str) -> DataFrame:
    return C.file_imports(J.imports(spark, d), J.files(spark, d), "src/m3/f8.ts").select("import_id", "imported_name", "local_name", "source_path", "line")


BASE = r"regexp_extract(regexp_replace(file_path, '\.(ts|tsx|js|jsx|mjs)$', ''), '[^/]*$')"
PLACED = r"""placed AS (SELECT i.*, f.file_path FROM imports i JOIN files f USING (file_id)),
whole AS (SELECT *, regexp_extract(source_path, '[^/]*$') AS last, CASE WHEN ends_with(source_path, '/index') THEN regexp_extract(source_path, '([^/]*)/index$', 1) END AS folder FROM placed WHERE is_default OR is_namespace)"""
TOP = f"top AS (SELECT symbol_id AS def_id, name, file_path AS def_path, {BASE} AS base FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY exported DESC, file_path, line, symbol_id) AS n FROM symbols JOIN files USING (file_id)) WHERE n = 1)"


def _met(name: str, definitions: str) -> str:
    """A CTE of the places that import each definition (def_id, name, def_path, base)."""
    ways = [("placed", "i.imported_name = x.name"), ("placed", "i.local_name = x.name"), ("whole", "i.last = x.base"), ("whole", "i.folder = x.base")]
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT x.def_id, i.file_path, i.line, i.import_id, i.imported_name FROM {definitions} x JOIN {t} i ON {on} WHERE i.file_path <> x.def_path" for t, on in ways) + ")"


@query("find_callers", sql("files", "symbols", "imports", body=f"{PLACED}, {TOP}, {_met('met', 'top')} SELECT def_id, file_path, line, arg_min(imported_name, import_id) AS imported_name FROM met GROUP BY def_id, file_path, line"))
def find_callers(spark: SparkSession, d: str) -> DataFrame:
    return C.callers(C.top_definition(J.symbols(spark, d), J.files(spark, d)), J.imports(spark, d), J.files(spark, d))


@query("index_status", sql("files", "symbols", "imports", body="SELECT (SELECT count(*) FROM files) AS files, (SELECT max(mtime) FROM files) AS last_indexed, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM imports) AS imports"))
def index_status(spark: SparkSession, d: str) -> DataFrame:
    return C.index_status(J.files(spark, d).withColumnRenamed("mtime", "indexed_at"), J.symbols(spark, d), J.imports(spark, d))


ENTRY_SQL = "regexp_matches({}, " + _quoted("|".join(f"(?:{p})" for p in G.ENTRY_POINTS)) + ")"
EXPORTED = f"exported AS (SELECT symbol_id AS def_id, name, file_path AS def_path, line, {BASE} AS base FROM symbols JOIN files USING (file_id) WHERE exported AND NOT {ENTRY_SQL.format('file_path')})"
DEAD_CTES = f"{PLACED}, {EXPORTED}, {_met('called', 'exported')}"
DEAD = "SELECT def_id AS symbol_id, name, def_path AS file_path, line FROM exported WHERE def_id NOT IN (SELECT def_id FROM called)"


def _dead(spark: SparkSession, d: str) -> DataFrame:
    return C.dead_exports(J.symbols(spark, d), J.imports(spark, d), J.files(spark, d), G.is_entry(F.col("file_path")), None)


@query("dead_exports", sql("files", "symbols", "imports", body=f"{DEAD_CTES} {DEAD}"))
def dead_exports(spark: SparkSession, d: str) -> DataFrame:
    return _dead(spark, d).select("symbol_id", "name", "file_path", "line")


def _resolved(alias: bool = False) -> str:
    """Edges by SQL: each .. drops a folder of the importing file's; with ``alias``, @app/ means src/."""
    bare = "concat('src/', substr(source_path, 6))" if alias else "NULL"
    return rf"""split AS (SELECT import_id, file_path AS from_path, source_path, len(regexp_extract(source_path, '^((\.\./)*)', 1)) // 3 AS ups, string_split(regexp_replace(file_path, '/?[^/]*$', ''), '/') AS folders FROM imports JOIN files USING (file_id)),
meant AS (SELECT import_id, from_path, source_path, CASE WHEN starts_with(source_path, './') THEN array_to_string(list_append(folders, substr(source_path, 3)), '/') WHEN ups > 0 THEN array_to_string(list_append(folders[1 : len(folders) - ups], substr(source_path, 3 * ups + 1)), '/') WHEN starts_with(source_path, '@app/') THEN {bare} END AS stem FROM split),
tried AS (SELECT import_id, from_path, source_path, concat(stem, e.ext) AS file_path, e.p FROM meant, (VALUES ('', 0), ('.ts', 1), ('.tsx', 2), ('.js', 3), ('.jsx', 4), ('.mjs', 5), ('/index.ts', 6), ('/index.tsx', 7), ('/index.js', 8), ('/index.jsx', 9), ('/index.mjs', 10)) e(ext, p) WHERE stem IS NOT NULL),
resolved AS (SELECT import_id, from_path, source_path, arg_min(file_path, p) AS to_path FROM tried JOIN (SELECT DISTINCT file_path FROM files) USING (file_path) GROUP BY import_id, from_path, source_path),
edges AS (SELECT DISTINCT from_path AS src, to_path AS dst FROM resolved)"""


RESOLVED = _resolved()


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(J.imports(spark, d), J.files(spark, d))


@query("import_edges", sql("files", "imports", body=f"{RESOLVED} SELECT src, dst FROM edges"))
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("src", "dst")


@query("import_edges_aliased", sql("files", "imports", body=f"{_resolved(True)} SELECT src, dst FROM edges"))
def import_edges_aliased(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(J.imports(spark, d), J.files(spark, d), aliases=[("@app/*", "src/*")]).select("src", "dst")


ORPHANS = f"SELECT f.file_path, coalesce(n, 0) AS symbols, coalesce(x, 0) AS exports FROM files f LEFT JOIN (SELECT file_id, count(*) AS n, count(*) FILTER (exported) AS x FROM symbols GROUP BY file_id) s USING (file_id) WHERE NOT {ENTRY_SQL.format('f.file_path')} AND f.file_path NOT IN (SELECT dst FROM edges)"


@query("orphaned_files", sql("files", "symbols", "imports", body=f"{RESOLVED} {ORPHANS}"))
def orphaned_files(spark: SparkSession, d: str) -> DataFrame:
    return G.orphans(J.files(spark, d), _edges(spark, d), J.symbols(spark, d), limit=None).drop("repo_id")


BY_REGEX = "SELECT repo_id, file_path, '{0}' AS kind, {2} AS key FROM (SELECT repo_id, file_path, unnest(regexp_extract_all(text, '{1}', 1)) AS x FROM code_lines)"
KEY = "CASE WHEN contains({x}, '/') AND regexp_replace({x}, '.*/', '') = 'index' THEN regexp_extract({x}, '([^/]*)/index$', 1) ELSE regexp_replace({x}, '.*/', '') END"
SOURCE_KEY = KEY.replace("{x}", r"regexp_replace(x, '\.(ts|tsx|js|jsx|mjs)$', '')")
KINDS = [("dynamic", E.DYNAMIC, SOURCE_KEY), ("reexport", E.REEXPORT, SOURCE_KEY), ("string", E.STRING, "x"), ("decorator", E.DECORATOR, "x"), ("tag", E.TAG, "x")]
POSTED = "posted AS (" + " UNION ALL ".join(BY_REGEX.format(kind, pattern.replace("'", "''"), key) for kind, pattern, key in KINDS) + ")"


@query("reference_postings", sql("files", "lines", body=f"{POSTED} SELECT repo_id, kind, key, min(file_path) AS lo, max(file_path) AS hi FROM posted GROUP BY repo_id, kind, key"))
def reference_postings(spark: SparkSession, d: str) -> DataFrame:
    return E.postings(J.code_lines(spark, d))


OWN_KEY = KEY.replace("{x}", r"regexp_replace(c.file_path, '\.(ts|tsx|js|jsx|mjs)$', '')")
_IN_ANY = "EXISTS (SELECT 1 FROM posted q WHERE q.repo_id = c.repo_id AND q.kind = '{}' AND {})"
FLAGS_SQL = {
    "dynamic_import": _IN_ANY.format("dynamic", "q.key = c.own AND q.file_path <> c.file_path"), "reexported": _IN_ANY.format("reexport", "q.key = c.own AND q.file_path <> c.file_path"), "string_named": _IN_ANY.format("string", "q.key = c.name"),
    "decorated": _IN_ANY.format("decorator", "q.file_path = c.file_path AND q.key = 'Injectable'"), "public_doc": _IN_ANY.format("tag", "q.file_path = c.file_path"),
}
EVIDENCE = "evidence AS (SELECT c.*, " + ", ".join(f"{x} AS {k}" for k, x in FLAGS_SQL.items()) + f" FROM (SELECT *, {OWN_KEY} AS own FROM found c) c)"
FOUND = f"dead AS ({DEAD}), lone AS ({ORPHANS}), found AS (SELECT repo_id, 'dead_export' AS category, d.file_path, d.name, symbol_id AS id, 1 AS exports FROM dead d JOIN files f USING (file_path) UNION ALL SELECT repo_id, 'orphaned_file', o.file_path, NULL, file_id, exports FROM lone o JOIN files f USING (file_path))"
UNUSED = f"{RESOLVED}, {DEAD_CTES}, {FOUND}, {POSTED}, {EVIDENCE}"


def _unused(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Dead exports and orphaned files of all repositories, with the ids of symbols and of files."""
    files = J.files(spark, d)
    dead = _dead(spark, d).select("repo_id", "file_path", "name", F.col("symbol_id").alias("id"))
    lone = G.orphans(files, _edges(spark, d), J.symbols(spark, d), limit=None).join(files.select("file_path", F.col("file_id").alias("id")), "file_path")
    return dead, lone.select("repo_id", "file_path", "exports", "id")


@query("dead_code_evidence", sql("files", "symbols", "imports", "lines", body=f"{UNUSED} SELECT id, name, file_path, dynamic_import, reexported, string_named, decorated, public_doc FROM evidence WHERE category = 'dead_export'"))
def dead_code_evidence(spark: SparkSession, d: str) -> DataFrame:
    return E.evidence(_unused(spark, d)[0], J.code_lines(spark, d)).select("id", "name", "file_path", "dynamic_import", "reexported", "string_named", "decorated", "public_doc")


@query("dead_code_confidence", sql("files", "symbols", "imports", "lines", body=f"""{UNUSED}, points AS (SELECT id, category, CAST(CASE WHEN category = 'dead_export' THEN greatest(0, 95 - CASE WHEN reexported THEN 40 ELSE 0 END - CASE WHEN public_doc THEN 60 ELSE 0 END) ELSE 80 + CASE WHEN exports = 0 THEN 10 ELSE 0 END - CASE WHEN dynamic_import OR reexported THEN 40 ELSE 0 END END AS INTEGER) AS score FROM evidence
WHERE NOT (decorated OR (category = 'dead_export' AND (dynamic_import OR string_named)))) SELECT id, category, score, CAST(CASE WHEN score >= 90 THEN 1 WHEN score >= 70 THEN 2 ELSE 3 END AS INTEGER) AS tier FROM points"""))
def dead_code_confidence(spark: SparkSession, d: str) -> DataFrame:
    return V.cleanup_confidence(E.dead_code(*_unused(spark, d), J.code_lines(spark, d)))


@query("dead_code_summary", sql("files", "symbols", "imports", body=f"{RESOLVED}, {DEAD_CTES} SELECT (SELECT count(*) FROM files WHERE lower(file_path) LIKE 'src/%') AS files_analyzed, (SELECT count(*) FROM symbols WHERE exported) AS symbols_analyzed, (SELECT count(*) FROM ({DEAD})) AS dead_exports, (SELECT count(*) FROM ({ORPHANS})) AS orphaned_files"))
def dead_code_summary(spark: SparkSession, d: str) -> DataFrame:
    files, symbols = J.files(spark, d), J.symbols(spark, d)
    return G.dead_code_summary(files, symbols, _dead(spark, d), G.orphans(files, _edges(spark, d), symbols, limit=None), "src/")


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("repo_id", "src", "dst")


# every cycle is found once, from its least file on
ALL_CYCLES = f"""{RESOLVED}, p(first, last, path, closed) AS (SELECT src, dst, [src, dst], src = dst FROM edges WHERE dst >= src UNION ALL
SELECT p.first, g.dst, list_append(p.path, g.dst), g.dst = p.first FROM p JOIN edges g ON g.src = p.last WHERE NOT p.closed AND len(p.path) <= 10 AND (g.dst = p.first OR (g.dst > p.first AND NOT list_contains(p.path, g.dst))))"""


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("all_cycles", _recursive(sql("files", "imports", body=f"{ALL_CYCLES} SELECT array_to_string(path, '>') AS cycle, CAST(len(path) - 1 AS INTEGER) AS length FROM p WHERE closed")))
def all_cycles(spark: SparkSession, d: str) -> DataFrame:
    _checkpoints(spark)
    return G.all_cycles(_graph(spark, d)).select(F.array_join("cycle", ">").alias("cycle"), "length")


@query("cycle_summary", _recursive(sql("files", "imports", body=f"{ALL_CYCLES} SELECT count(*) AS cycles, CAST(max(len(path) - 1) AS INTEGER) AS longest, (SELECT count(DISTINCT x) FROM (SELECT unnest(path) AS x FROM p WHERE closed)) AS files FROM p WHERE closed")))
def cycle_summary(spark: SparkSession, d: str) -> DataFrame:
    _checkpoints(spark)
    return G.cycle_summary(G.all_cycles(_graph(spark, d)))


# two files are of one component where each reaches the other
COMPONENTS = f"{RESOLVED}, reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT a, dst FROM reach JOIN edges ON b = src), nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"


@query("strong_components", _recursive(sql("files", "imports", body=f"{COMPONENTS} SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM (SELECT node, least(node, coalesce((SELECT min(r.b) FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a WHERE r.a = node), node)) AS component FROM nodes)")))
def strong_components(spark: SparkSession, d: str) -> DataFrame:
    _checkpoints(spark)
    return N.strong_components(_graph(spark, d)).select("node", "component", "size")


@query("circular_deps")
def circular_deps(spark: SparkSession, d: str) -> DataFrame:
    _checkpoints(spark)
    return G.cycles_by_search(_edges(spark, d)).select(F.array_join("cycle", ">").alias("cycle"), "length")


REACH = f"{RESOLVED}, r(target, file, degree) AS (SELECT file_path, file_path, 0 FROM files UNION SELECT r.target, g.src, r.degree + 1 FROM r JOIN edges g ON g.dst = r.file WHERE r.degree < 3), near AS (SELECT target, file, CAST(min(degree) AS INTEGER) AS degree FROM r GROUP BY target, file HAVING min(degree) > 0)"


def _reach(spark: SparkSession, d: str) -> DataFrame:
    return G.reverse_reach(_graph(spark, d), J.files(spark, d).select(F.col("file_path").alias("target")))


@query("reverse_reach", _recursive(sql("files", "imports", body=f"{REACH} SELECT * FROM near")))
def reverse_reach(spark: SparkSession, d: str) -> DataFrame:
    _checkpoints(spark)
    return _reach(spark, d)


@query("blast_risk", _recursive(sql("files", "imports", body=f"""{REACH},
points AS (SELECT f.file_path AS target, 10 + coalesce(sum(CASE n.degree WHEN 1 THEN 5 WHEN 2 THEN 2 WHEN 3 THEN 1 END), 0) AS base,
  coalesce(bool_or(starts_with(n.file, 'scripts/')), false) AS covered, starts_with(f.file_path, 'src/m1/') OR coalesce(bool_or(starts_with(n.file, 'src/m1/')), false) AS edge FROM files f LEFT JOIN near n ON n.target = f.file_path GROUP BY f.file_path),
weighed AS (SELECT target, floor(base * (10 + CASE WHEN covered THEN 0 ELSE 3 END + CASE WHEN edge THEN 5 ELSE 0 END) + 0.5) / 10.0 AS points FROM points)
SELECT target, points, CASE WHEN points < 20 THEN 'low' WHEN points < 50 THEN 'medium' WHEN points <= 100 THEN 'high' ELSE 'critical' END AS risk,
  CAST(CASE WHEN points < 20 THEN least(3, 1 + floor(points * 3 / 20)) WHEN points < 50 THEN least(6, 4 + floor((points - 20) * 3 / 30)) WHEN points <= 100 THEN least(9, 7 + floor((points - 50) * 3 / 50)) ELSE 10 END AS INTEGER) AS score FROM weighed""")))
def blast_risk(spark: SparkSession, d: str) -> DataFrame:
    """Scripts stand for tests, and the folder m1 for the service boundary."""
    _checkpoints(spark)
    files = J.files(spark, d).select(F.col("file_path").alias("target"))
    reach = _reach(spark, d).checkpoint()
    edge = files.where("target LIKE 'src/m1/%'").unionByName(reach.where("file LIKE 'src/m1/%'").select("target"))
    return G.risk(files, reach, reach.where("file LIKE 'scripts/%'").select("target"), edge)


DIFF_NEW = "SELECT concat('f', CAST(page_id AS STRING)) AS file_path, page_id % 7 AS mtime, sha256(html) AS hash FROM pages WHERE page_id % 5 <> 0"
DIFF_OLD = "SELECT concat('f', CAST(page_id AS STRING)) AS file_path, page_id % 5 AS mtime, CASE WHEN page_id % 3 = 0 THEN 'other' WHEN page_id % 11 = 0 THEN NULL ELSE sha256(html) END AS hash FROM pages WHERE page_id % 6 <> 0"
STATUS = "CASE WHEN o.file_path IS NULL THEN 'added' WHEN n.file_path IS NULL THEN 'deleted' WHEN n.mtime > o.mtime AND (o.hash IS NULL OR n.hash <> o.hash) THEN 'modified' ELSE 'unchanged' END"


def _diff(spark: SparkSession, d: str) -> DataFrame:
    pages = t(spark, d, "pages").withColumn("sha", F.sha2(F.col("html").cast("binary"), 256))
    new = pages.where("page_id % 5 <> 0").selectExpr("concat('f', CAST(page_id AS STRING)) AS file_path", "page_id % 7 AS mtime", "sha AS hash")
    old = pages.where("page_id % 6 <> 0").selectExpr("concat('f', CAST(page_id AS STRING)) AS file_path", "page_id % 5 AS mtime", "CASE WHEN page_id % 3 = 0 THEN 'other' WHEN page_id % 11 = 0 THEN NULL ELSE sha END AS hash")
    return C.diff(new, old)


@query("index_diff", f"SELECT coalesce(n.file_path, o.file_path) AS file_path, {STATUS} AS status FROM ({DIFF_NEW}) n FULL JOIN ({DIFF_OLD}) o ON n.file_path = o.file_path")
def index_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)


@query("diff_summary", f"SELECT {STATUS} AS status, count(*) AS n FROM ({DIFF_NEW}) n FULL JOIN ({DIFF_OLD}) o ON n.file_path = o.file_path GROUP BY 1")
def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.diff_summary(_diff(spark, d))


@query("file_hash", "SELECT page_id, sha256(html) AS hash, concat('repo_', substr(sha256(url), 1, 8)) AS repo_id FROM pages")
def file_hash(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("hash"), F.concat(F.lit("repo_"), F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 8)).alias("repo_id"))


SCAN = "CASE WHEN event_id % 7 = 0 THEN concat('src/node_modules/', event_type, '.js') WHEN event_id % 7 = 1 THEN concat('src/', event_type, '.test.ts') WHEN event_id % 7 = 2 THEN concat('types/', event_type, '.d.ts') WHEN event_id % 7 = 3 THEN concat('tmp/', event_type, '.log') WHEN event_id % 7 = 4 THEN concat('gen/', event_type, CAST(user_id AS STRING), '.ts') ELSE concat('src/', event_type, CAST(user_id AS STRING), '.ts') END"


@query("scan_filter", f"SELECT event_id, event_id % 7 < 4 OR (event_id % 7 = 4 AND event_type = 'click') AS excluded FROM (SELECT event_id, event_type, {SCAN} AS path FROM events)")
def scan_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "events").selectExpr("event_id", f"{SCAN} AS path")
    return rows.select("event_id", X.excluded(F.col("path"), globs=["gen/click*"], ignore=X.gitignore_patterns("# logs\n*.log\n!keep.log\n")).alias("excluded"))


@query("suggest_files", "SELECT DISTINCT url AS file_path FROM pages WHERE regexp_matches(url, '(?i)p.*1')")
def suggest_files(spark: SparkSession, d: str) -> DataFrame:
    return C.suggest_files(t(spark, d, "pages").select(F.col("url").alias("file_path")), "p1", 1 << 30)


@query("frameworks", "SELECT user_id, array_to_string(list_filter([CASE WHEN user_id % 4 = 0 OR user_id % 3 = 0 THEN 'react' END, CASE WHEN user_id % 6 = 1 THEN 'express' END, CASE WHEN user_id % 5 = 0 THEN 'fastapi' END], lambda x: x IS NOT NULL), ',') AS frameworks, CASE WHEN user_id % 7 = 0 THEN 'vitest' WHEN user_id % 2 = 0 THEN 'pytest' END AS test_framework FROM (SELECT DISTINCT user_id FROM events)")
def frameworks(spark: SparkSession, d: str) -> DataFrame:
    deps = F.expr("array_compact(array(CASE WHEN user_id % 4 = 0 THEN 'next' END, CASE WHEN user_id % 3 = 0 THEN 'react-dom' END, CASE WHEN user_id % 6 = 1 THEN 'express' END, CASE WHEN user_id % 5 = 0 THEN 'fastapi' END, CASE WHEN user_id % 7 = 0 THEN 'vitest' END, CASE WHEN user_id % 2 = 0 THEN 'pytest' END))")
    return t(spark, d, "events").select("user_id").distinct().select("user_id", F.array_join(X.frameworks_of(deps), ",").alias("frameworks"), X.test_framework_of(deps).alias("test_framework"))


@query("fingerprint_text", "SELECT p_partkey, concat('project: ', p_name, CASE WHEN p_size % 2 = 0 THEN ' | languages: typescript, python' ELSE '' END, ' | patterns: ', p_type, ' | dependencies: ', p_brand) AS text FROM part")
def fingerprint_text(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    langs = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("typescript"), F.lit("python"))).otherwise(none)
    return t(spark, d, "part").select("p_partkey", X.fingerprint_text(F.col("p_name"), langs, none, F.array("p_type"), F.array("p_brand")).alias("text"))


LISTING = "SELECT user_id AS root, CASE WHEN event_id % 5 = 0 THEN 'package.json' WHEN event_id % 5 = 1 THEN concat('app', CAST(user_id AS STRING), '.csproj') WHEN event_id % 5 = 2 THEN 'deno.json' WHEN event_id % 5 = 3 THEN 'Makefile' ELSE 'readme.md' END AS name FROM events"


def _listing(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(LISTING.replace("FROM events", "FROM {events}"), events=t(spark, d, "events"))


@query("project_types", f"SELECT root, CASE WHEN name = 'package.json' THEN 'TypeScript/JavaScript' WHEN name = 'deno.json' THEN 'Deno' WHEN name = 'Makefile' THEN 'C/C++' ELSE 'C#' END AS project, bool_or(name <> 'deno.json') AS indexable FROM ({LISTING}) WHERE name <> 'readme.md' GROUP BY 1, 2")
def project_types(spark: SparkSession, d: str) -> DataFrame:
    return X.project_types(_listing(spark, d))


@query("session_indexable", f"SELECT root, bool_or(name = 'package.json') AS indexable FROM ({LISTING}) GROUP BY root")
def session_indexable(spark: SparkSession, d: str) -> DataFrame:
    return X.session_indexable(_listing(spark, d))


@query("unused_packages", sql("imports", body="SELECT name FROM (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'lodash' ELSE concat('pkg', CAST(user_id % 20 AS STRING)) END AS name FROM events) WHERE name NOT IN (SELECT source_path FROM imports) AND name NOT IN ('pkg1', 'pkg2')"))
def unused_packages(spark: SparkSession, d: str) -> DataFrame:
    deps = t(spark, d, "events").selectExpr("CASE WHEN user_id % 3 = 0 THEN 'lodash' ELSE concat('pkg', CAST(user_id % 20 AS STRING)) END AS name").distinct().selectExpr("name", "name = 'pkg1' AS peer")
    return V.unused_packages(deps, J.imports(spark, d), spark.sql("SELECT 'pkg2' AS mention")).select("name")


@query("copied_blocks", "SELECT sha256(array_to_string(b, chr(10))) AS digest, count(*) AS copies FROM (SELECT list(l) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS b FROM (SELECT doc_id, line, trim(regexp_replace(x, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)) WHERE l <> '') WHERE len(b) = 3 GROUP BY 1 HAVING count(*) > 1")
def copied_blocks(spark: SparkSession, d: str) -> DataFrame:
    texts = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text")
    return V.copied_blocks(V.lines_of(texts), 3).select("digest", "copies")


@query("similar_blocks")
def similar_blocks(spark: SparkSession, d: str) -> DataFrame:
    _checkpoints(spark)
    return Y.similar_blocks(_doc_lines(spark, d), 3).select("a", "b", "similarity", "a_first", "b_first")


def _doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return V.lines_of(t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text"))


FINDING_PATH = "CASE WHEN p_partkey % 7 = 0 THEN concat('src/api/f', CAST(p_partkey AS STRING), '.ts') WHEN p_partkey % 7 = 1 THEN concat('tests/f', CAST(p_partkey AS STRING), '.ts') WHEN p_partkey % 7 = 2 THEN concat('src/f', CAST(p_partkey AS STRING), '.spec.ts') WHEN p_partkey % 7 = 3 THEN concat('src/apis/f', CAST(p_partkey AS STRING), '.ts') ELSE concat('src/f', CAST(p_partkey AS STRING), '.ts') END"


@query("review_triage", """SELECT id, s AS score, CAST(CASE WHEN s >= 90 THEN 1 WHEN s >= 70 THEN 2 ELSE 3 END AS INTEGER) AS tier FROM (SELECT p_partkey AS id, CAST(greatest(0, least(100, p_size * 2
 + CASE p_partkey % 7 WHEN 0 THEN 15 WHEN 1 THEN -10 WHEN 2 THEN -10 ELSE 0 END + CASE WHEN p_partkey % 23 > 10 THEN 10 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 10 ELSE 0 END - CASE WHEN p_partkey % 11 = 0 THEN 15 ELSE 0 END
 + CASE p_partkey % 4 WHEN 0 THEN 20 WHEN 1 THEN -10 ELSE 0 END)) AS INTEGER) AS s FROM part)""")
def review_triage(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").selectExpr("p_partkey AS id", f"{FINDING_PATH} AS file_path", "p_size * 2 AS score", "p_partkey % 23 AS callers", "p_partkey % 5 = 0 AS confirmed", "p_partkey % 11 = 0 AS false_positives", "CASE p_partkey % 4 WHEN 0 THEN 'introduced' WHEN 1 THEN 'existing' END AS hygiene")
    return V.triage(rows)


@query("cleanup_confidence", """SELECT * FROM (SELECT id, category, CAST(s AS INTEGER) AS score, CAST(CASE WHEN s >= 90 THEN 1 WHEN s >= 70 THEN 2 ELSE 3 END AS INTEGER) AS tier FROM (SELECT p_partkey AS id,
 CASE p_partkey % 4 WHEN 0 THEN 'dead_export' WHEN 1 THEN 'stale_todo' WHEN 2 THEN 'circular_dependency' ELSE 'unused_package' END AS category,
 CASE p_partkey % 4 WHEN 0 THEN least(100, 85 + CASE WHEN p_size % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 5 ELSE 0 END - CASE WHEN p_size % 5 = 0 THEN 60 ELSE 0 END)
  WHEN 1 THEN 60 + CASE WHEN p_size % 2 = 0 THEN 15 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 10 ELSE 0 END - CASE WHEN p_size % 5 = 0 THEN 20 ELSE 0 END
  WHEN 2 THEN 100 ELSE 75 + CASE WHEN p_size % 2 = 0 THEN 15 ELSE 0 END - CASE WHEN p_size % 3 = 0 THEN 20 ELSE 0 END - CASE WHEN p_size % 5 = 0 THEN 25 ELSE 0 END END AS s FROM part WHERE p_size % 13 <> 0)) WHERE tier < 3""")
def cleanup_confidence(spark: SparkSession, d: str) -> DataFrame:
    flags = {0: ("no_callers", "underscore", "public_doc"), 1: ("over_12_months", "over_6_months", "issue"), 2: ("none", "at", "all"), 3: ("never_imported", "peer", "scripts_only")}
    names = [F.when(F.col("p_partkey") % 4 == k, F.array(*map(F.lit, v))) for k, v in flags.items()]
    held = F.array_compact(F.array(*[F.when(F.col("p_size") % m == 0, F.get(F.coalesce(*names), F.lit(i))) for i, m in enumerate((2, 3, 5))]))
    category = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'dead_export' WHEN 1 THEN 'stale_todo' WHEN 2 THEN 'circular_dependency' ELSE 'unused_package' END")
    return V.cleanup_confidence(t(spark, d, "part").select(F.col("p_partkey").alias("id"), category.alias("category"), held.alias("flags"), (F.col("p_size") % 13 == 0).alias("safe")), "aggressive")


@query("signal_ratio", "SELECT 100.0::DOUBLE * count(*) FILTER (p_size * 2 >= 70) / count(*) AS ratio FROM part")
def signal_ratio(spark: SparkSession, d: str) -> DataFrame:
    return V.signal_ratio(t(spark, d, "part").select(V.tier(F.col("p_size") * 2).alias("tier")))


@query("test_coverage", sql("files", "symbols", "imports", body=f"{PLACED}, {TOP}, {_met('met', 'top')} SELECT avg(CASE WHEN def_id IN (SELECT def_id FROM met WHERE starts_with(file_path, 'scripts')) THEN 1.0 ELSE 0.0 END) AS coverage FROM top"))
def test_coverage(spark: SparkSession, d: str) -> DataFrame:
    tops = C.top_definition(J.symbols(spark, d), J.files(spark, d))
    called = C.callers(tops, J.imports(spark, d), J.files(spark, d)).withColumn("file_path", F.regexp_replace("file_path", "^scripts", "test"))
    return V.coverage(called, tops)


# One file a part, in five languages by turns: an import over several lines, a class of the part's name, a method and a helper.
SOURCES = {
    "ts": "import {\n  x,\n  y as z\n} from './base';\nexport class NAME {\n  run(): void {\n  }\n}\nfunction helper() {}\n",
    "py": "from .base import (\n    x,\n    y as z,\n)\nclass NAME:\n    def run(self):\n        pass\ndef _helper():\n    pass\n",
    "go": 'package p\nimport (\n  "fmt"\n  io "a/b"\n)\ntype NAME struct {\n}\nfunc (f *NAME) Run() {\n}\nfunc helper() {\n}\n',
    "rs": "use base::{\n    x,\n    y as z,\n};\npub struct NAME {\n}\nimpl NAME {\n    pub fn run(&self) {\n    }\n}\nfn helper() {\n}\n",
    "java": "import base.x;\nimport base.y.*;\npublic class NAME {\n    public void run() {\n    }\n    private int helper() {\n    }\n}\n",
}
# what each file declares and imports, by the languages' own rules: name, kind, line, exported; name, local name, path, line
DECLARED = {
    0: [("NAME", "class", 5, True), ("run", "method", 6, False), ("helper", "function", 9, False)],
    1: [("NAME", "class", 5, True), ("run", "method", 6, True), ("_helper", "function", 8, False)],
    2: [("NAME", "class", 6, True), ("Run", "method", 8, True), ("helper", "function", 10, False)],
    3: [("NAME", "class", 5, True), ("run", "method", 8, True), ("helper", "function", 11, False)],
    4: [("NAME", "class", 3, True), ("run", "method", 4, True), ("helper", "method", 6, False)],
}
IMPORTED = {
    0: [("x", "x", "./base", 1), ("y", "z", "./base", 1)],
    1: [("x", "x", ".base", 1), ("y", "z", ".base", 1)],
    2: [("*", "fmt", "fmt", 3), ("*", "io", "a/b", 4)],
    3: [("x", "x", "base::x", 1), ("y", "z", "base::y", 1)],
    4: [("x", "x", "base.x", 1), ("*", "*", "base.y", 2)],
}
SOURCE_NAME = "concat('C', replace(p_name, ' ', ''))"
SOURCE_PATH = "concat('src/p', CAST(p_partkey AS STRING), '.', CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(SOURCES)) + " END)"


def _literals(table: dict) -> str:
    cell = lambda v: str(v).lower() if isinstance(v, bool) else _quoted(v) if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(cell(v) for v in (k, *row)) + ")" for k, rows in table.items() for row in rows)


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    from fathom.sources import parsers

    texts = F.array(*[F.lit(x) for x in SOURCES.values()])
    content = F.replace(F.get(texts, (F.col("p_partkey") % 5).cast("int")), F.lit("NAME"), F.expr(SOURCE_NAME))
    return parsers.parse_files(t(spark, d, "part").select(F.expr(SOURCE_PATH).alias("file_path"), content.cast("binary").alias("content")))


@query("parse_symbols", f"SELECT {SOURCE_PATH} AS file_path, CASE WHEN s.name = 'NAME' THEN {SOURCE_NAME} ELSE s.name END AS name, kind, CAST(line AS INTEGER) AS line, exported FROM part JOIN (VALUES {_literals(DECLARED)}) s(k, name, kind, line, exported) ON p_partkey % 5 = k")
def parse_symbols(spark: SparkSession, d: str) -> DataFrame:
    from fathom.sources import parsers

    return parsers.symbol_rows(_parsed(spark, d)).select("file_path", "name", "kind", "line", "exported")


@query("parse_imports", f"SELECT {SOURCE_PATH} AS file_path, s.name AS imported_name, local_name, source_path, CAST(line AS INTEGER) AS line FROM part JOIN (VALUES {_literals(IMPORTED)}) s(k, name, local_name, source_path, line) ON p_partkey % 5 = k")
def parse_imports(spark: SparkSession, d: str) -> DataFrame:
    from fathom.sources import parsers

    return parsers.import_rows(_parsed(spark, d)).select("file_path", "imported_name", "local_name", "source_path", "line")


LINES = "CASE WHEN event_id % 5 = 0 THEN concat('  console.', CASE WHEN event_id % 3 = 0 THEN 'log' WHEN event_id % 3 = 1 THEN 'table' ELSE 'warn' END, '(', event_type, ');') WHEN event_id % 5 = 1 THEN concat('// if (', event_type, ') { go(); }') WHEN event_id % 5 = 2 THEN concat('please print this console.log page ', CAST(user_id AS STRING)) WHEN event_id % 5 = 3 THEN concat(CASE WHEN event_id % 2 = 0 THEN '# TODO ' ELSE '# TEMPORARY: ' END, event_type) ELSE 'if (DEBUG) console.log(1)' END"
LINE_PATH = "concat(CASE WHEN user_id % 5 = 0 THEN 'src/logger.' WHEN user_id % 5 = 1 THEN 'scripts/f' WHEN user_id % 5 = 2 THEN 'src/client' ELSE 'src/f' END, CAST(user_id AS STRING), '.ts')"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").selectExpr(f"{LINE_PATH} AS file_path", "CAST(event_id AS INT) AS line", f"{LINES} AS text", "ts AS written")


@query("debug_leftovers", f"SELECT file_path, line FROM (SELECT {LINE_PATH} AS file_path, CAST(event_id AS INTEGER) AS line, event_id, user_id FROM events) WHERE event_id % 5 = 0 AND event_id % 3 < 2 AND user_id % 5 > 1")
def debug_leftovers(spark: SparkSession, d: str) -> DataFrame:
    return V.debug_leftovers(_lines(spark, d)).select("file_path", "line")


@query("commented_code", f"SELECT {LINE_PATH} AS file_path, CAST(event_id AS INTEGER) AS line FROM events WHERE event_id % 5 = 1")
def commented_code(spark: SparkSession, d: str) -> DataFrame:
    return V.commented_code(_lines(spark, d)).select("file_path", "line")


@query("todo_ages", f"SELECT {LINE_PATH} AS file_path, CAST(event_id AS INTEGER) AS line, CASE WHEN ts < TIMESTAMP '2024-01-11 00:00:00' THEN 'stale' ELSE 'aging' END AS tier FROM events WHERE event_id % 5 = 3")
def todo_ages(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return V.todos(lines.select("file_path", "line", "text"), lines.select("file_path", "line", "written"), F.expr("TIMESTAMP '2025-01-10 00:00:00'")).select("file_path", "line", "tier")


HINT_ORDER = """list_filter([CASE WHEN rate < 0.5 THEN concat('Only ', CAST(CAST(floor(rate * 100 + 0.5) AS INTEGER) AS STRING), '% of its uses succeeded, so check it first.') END, CASE WHEN supersedes IS NOT NULL THEN concat('Solution ', CAST(supersedes AS STRING), ' replaces it.') END,
 CASE WHEN id % 3 = 0 THEN 'Do not use: any, eval' END, CASE WHEN id % 4 = 0 THEN 'It needs: node' END, CASE WHEN complexity >= 7 THEN 'It is complex: take it in small steps.' END,
 CASE WHEN id % 2 = 0 THEN 'Close match: apply it and report the outcome.' ELSE 'Loose match: adapt it and report the outcome.' END, CASE WHEN id % 5 = 0 THEN 'Known errors are listed with it: look at them before you start.' END], lambda x: x IS NOT NULL)"""


@query("recall_hints", sql("solutions", body=f"SELECT id, array_to_string({HINT_ORDER}[1:3], '|') AS hints FROM (SELECT *, CASE WHEN successes + failures > 0 THEN successes / (successes + failures) ELSE 0.5 END AS rate FROM solutions)"))
def recall_hints(spark: SparkSession, d: str) -> DataFrame:
    texts = lambda step, *xs: F.when(F.col("id") % step == 0, F.array(*map(F.lit, xs))).otherwise(F.array().cast("array<string>"))
    rate = F.when(F.col("successes") + F.col("failures") > 0, F.col("successes") / (F.col("successes") + F.col("failures"))).otherwise(0.5)
    rows = J.solutions(spark, d).select("id", F.when(F.col("id") % 2 == 0, 0.81).otherwise(0.8).alias("similarity"), rate.alias("success_rate"), F.col("supersedes").alias("superseded_by"), texts(3, "any", "eval", "goto").alias("anti_patterns"), texts(4, "node").alias("prerequisites"), "complexity")
    return M.hints(rows, F.col("id") % 5 == 0).select("id", F.array_join("hints", "|").alias("hints"))


@query("warnings_list", sql("warnings", body="SELECT id, target, severity FROM warnings WHERE type = 'file' AND (repo_id = 2 OR repo_id IS NULL)"))
def warnings_list(spark: SparkSession, d: str) -> DataFrame:
    return R.list_warnings(J.warnings(spark, d).withColumn("created_at", F.lit(0)), "file", 2).select("id", "target", "severity")


@query("unused_imports", "SELECT file_path, local_name FROM (SELECT concat('f', CAST(p_partkey AS STRING)) AS file_path, concat('v', CAST(p_size AS STRING)) AS local_name, p_size % 2 = 0 AS used FROM part) WHERE NOT used")
def unused_imports(spark: SparkSession, d: str) -> DataFrame:
    """One import a file, named again below it or only as part of a longer word."""
    part = t(spark, d, "part")
    names = part.selectExpr("concat('f', CAST(p_partkey AS STRING)) AS file_path", "concat('v', CAST(p_size AS STRING)) AS local_name", "'m' AS source_path", "1 AS line")
    texts = part.selectExpr("concat('f', CAST(p_partkey AS STRING)) AS file_path", "concat('import {v', CAST(p_size AS STRING), '} from m\nuse(', CASE WHEN p_size % 2 = 0 THEN '' ELSE 'w' END, 'v', CAST(p_size AS STRING), ')') AS text")
    return V.unused_imports(names, texts).select("file_path", "local_name")


HOOK_WARNINGS = "hw AS (SELECT * FROM warnings WHERE type = 'package' UNION ALL SELECT -1 AS id, 'package' AS type, 'lodash' AS target, 'npm' AS ecosystem, CAST(NULL AS BIGINT) AS repo_id, 'block' AS severity, 'left unmaintained' AS reason UNION ALL SELECT -2, 'package', 'requests==2.3', 'npm', CAST(NULL AS BIGINT), 'block', 'other ecosystem' UNION ALL SELECT -3, 'package', 'a', CAST(NULL AS STRING), 2, 'block', 'in repo two')"


def _hook_warnings(spark: SparkSession, d: str) -> DataFrame:
    more = spark.sql("SELECT * FROM VALUES (-1L, 'package', 'lodash', 'npm', CAST(NULL AS BIGINT), 'block', 'left unmaintained'), (-2L, 'package', 'requests==2.3', 'npm', CAST(NULL AS BIGINT), 'block', 'other ecosystem'), (-3L, 'package', 'a', CAST(NULL AS STRING), 2L, 'block', 'in repo two') AS w(id, type, target, ecosystem, repo_id, severity, reason)")
    return J.warnings(spark, d).where("type = 'package'").unionByName(more)


@query("hook_pre_bash", sql("warnings", body=f"""{HOOK_WARNINGS}, c AS (SELECT event_id, user_id % 3 AS repo_id, event_type, user_id, {J.COMMAND} AS command FROM events),
why AS (SELECT event_id, user_id, regexp_matches(command, '(?i)git\\s+commit') AND event_type = 'purchase' AS ruled, event_id % 8 IN (3, 5) AS commits, list_filter([
 CASE WHEN event_id % 8 = 0 AND user_id % 4 = 0 THEN '[CVE] 2 critical/high CVE(s) found' END, CASE WHEN event_id % 8 = 0 THEN '[WARNING] left unmaintained' END,
 CASE WHEN event_id % 8 = 7 AND repo_id = 2 THEN '[WARNING] in repo two' END], lambda x: x IS NOT NULL) AS issues FROM c)
SELECT event_id AS id, CASE WHEN ruled THEN 'deny' WHEN NOT commits AND len(issues) > 0 THEN 'ask' END AS decision,
 CASE WHEN ruled THEN 'no purchases' WHEN commits THEN CASE WHEN event_id % 8 = 3 THEN 'Git commit: review first' ELSE 'Jujutsu commit: review first' END WHEN len(issues) > 0 THEN array_to_string(issues, '; ') END AS reason FROM why"""))
def hook_pre_bash(spark: SparkSession, d: str) -> DataFrame:
    commands = t(spark, d, "events").selectExpr("event_id AS id", f"{J.COMMAND} AS command", "user_id % 3 AS repo_id")
    advisories = t(spark, d, "events").where("user_id % 4 = 0").selectExpr("concat('pkg', CAST(user_id AS STRING)) AS package").distinct().selectExpr("package", "'npm' AS ecosystem", "explode(array('high', 'CRITICAL', 'low')) AS level")
    rules = [{"name": "commit", "event": "bash", "pattern": "git\\s+commit.*purchase", "action": "block", "message": "no purchases", "priority": 1}]
    return H.pre_bash(commands, rules, _hook_warnings(spark, d), advisories)


FILE_WARNINGS = "SELECT * FROM VALUES (1L, 'file', 'src/*1.ts', CAST(NULL AS STRING), CAST(NULL AS BIGINT), 'block', 'cursed'), (2L, 'file', 'SRC/click?.ts', CAST(NULL AS STRING), 1L, 'warn', 'odd'), (3L, 'file', 'src/e*', CAST(NULL AS STRING), 2L, 'block', 'second repo') AS w(id, type, target, ecosystem, repo_id, severity, reason)"
SENSITIVE_SQL = "CASE WHEN ends_with(path, '.env.example') THEN NULL " + " ".join(f"WHEN regexp_matches(path, '{P.any_of(ps)}') THEN '{c}'" for c, ps in P.SENSITIVE) + " END"


@query("hook_pre_read", f"""WITH r AS (SELECT event_id AS id, {J.PATH} AS path, user_id % 3 AS repo_id FROM events),
x AS (SELECT id, path LIKE 'db/%click' AS ruled, {SENSITIVE_SQL} AS category, path LIKE 'src/%1.ts' OR (repo_id = 1 AND path LIKE 'src/click_.ts') OR (repo_id = 2 AND path LIKE 'src/e%') AS warned FROM r)
SELECT id, CASE WHEN ruled THEN 'deny' WHEN category IS NOT NULL OR warned THEN 'ask' END AS decision, CASE WHEN ruled THEN 'no dumps' WHEN category IS NOT NULL OR warned THEN coalesce(category, 'warning') END AS reason FROM x""")
def hook_pre_read(spark: SparkSession, d: str) -> DataFrame:
    reads = t(spark, d, "events").selectExpr("event_id AS id", f"{J.PATH} AS path", "user_id % 3 AS repo_id")
    rules = [{"name": "dumps", "event": "read", "pattern": "^db/.*click$", "action": "block", "message": "no dumps", "priority": 1}]
    return H.pre_read(reads, rules, spark.sql(FILE_WARNINGS), allowed=[".env.example"])


@query("hook_pre_edit", f"""WITH r AS (SELECT event_id AS id, {J.PATH} AS path, user_id % 3 AS repo_id, props FROM events),
x AS (SELECT id, contains(props, '7') AND starts_with(path, 'src/') AS ruled, list_filter([CASE WHEN repo_id = 2 AND path LIKE 'src/e%' THEN 'second repo' END, CASE WHEN path LIKE 'src/%1.ts' THEN 'cursed' END], lambda w: w IS NOT NULL) AS why FROM r)
SELECT id, CASE WHEN ruled THEN 'deny' WHEN len(why) > 0 THEN 'ask' END AS decision, CASE WHEN ruled THEN 'no sevens' WHEN len(why) > 0 THEN array_to_string(why, '; ') END AS reason FROM x""")
def hook_pre_edit(spark: SparkSession, d: str) -> DataFrame:
    edits = t(spark, d, "events").selectExpr("event_id AS id", f"{J.PATH} AS path", "user_id % 3 AS repo_id", "props AS content")
    rules = [{"name": "sevens", "event": "edit", "pattern": "^src/[^\\n]*\\n.*7", "action": "block", "message": "no sevens", "priority": 1}]
    return H.pre_edit(edits, rules, spark.sql(FILE_WARNINGS))


@query("hook_pre_web", "SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 3 = 0 THEN 'deny' END AS decision, CASE WHEN turn % 3 = 0 THEN 'react: hooks' END AS reason FROM conversations")
def hook_pre_web(spark: SparkSession, d: str) -> DataFrame:
    query_text = F.expr("CASE WHEN turn % 3 = 0 THEN 'React hooks documentation' WHEN turn % 3 = 1 THEN 'weather in may' END")
    url = F.expr("CASE WHEN turn % 3 = 2 THEN 'https://example.org/a/b' END")
    return H.pre_web(t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), query_text.alias("query"), url.alias("url")))


@query("hook_permission", "SELECT event_id AS id, CASE WHEN event_type IN ('click', 'error') THEN 'allow' END AS decision, CAST(NULL AS STRING) AS reason FROM events")
def hook_permission(spark: SparkSession, d: str) -> DataFrame:
    tool = F.expr("CASE event_type WHEN 'click' THEN 'Read' WHEN 'error' THEN 'doctor' WHEN 'view' THEN 'WebFetch' WHEN 'signup' THEN 'Grep' ELSE 'Write' END")
    return H.permission_request(t(spark, d, "events").select(F.col("event_id").alias("id"), tool.alias("tool")), never=["Grep"])


@query("hook_session_start", f"SELECT root, concat('repo_', substr(sha256(CAST(root AS STRING)), 1, 8)) AS repo_id, bool_or(name = 'package.json') AS indexable FROM ({LISTING}) GROUP BY root")
def hook_session_start(spark: SparkSession, d: str) -> DataFrame:
    return H.session_start(_listing(spark, d))


STORED_REPOS = "SELECT concat('id', CAST(s_suppkey AS STRING)) AS id, concat('/r/', CAST(s_suppkey AS STRING)) AS path, s_name AS name, s_nationkey AS v, TIMESTAMP '2024-01-01 00:00:00' AS at FROM supplier WHERE s_suppkey % 3 > 0"
DETECTED_REPOS = "SELECT concat('/r/', CAST(s_suppkey AS STRING)) AS path, concat('new', s_name) AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey ELSE s_nationkey + 100 END AS v FROM supplier WHERE s_suppkey % 5 > 0"


@query("repo_upsert", f"""SELECT coalesce(s.id, concat('repo_', substr(sha256(n.path), 1, 8))) AS id, coalesce(s.path, n.path) AS path, CASE WHEN n.path IS NOT NULL AND (s.id IS NULL OR s.v <> n.v) THEN n.name ELSE s.name END AS name,
CASE WHEN n.path IS NOT NULL AND (s.id IS NULL OR s.v <> n.v) THEN n.v ELSE s.v END AS v, CASE WHEN n.path IS NOT NULL AND (s.id IS NULL OR s.v <> n.v) THEN {AS_OF} ELSE s.at END AS updated_at, coalesce(s.at, {AS_OF}) AS created_at FROM ({STORED_REPOS}) s FULL JOIN ({DETECTED_REPOS}) n ON s.path = n.path""")
def repo_upsert(spark: SparkSession, d: str) -> DataFrame:
    from fathom.sources import schemas

    of = lambda text: spark.sql(text.replace("FROM supplier", "FROM {supplier}"), supplier=t(spark, d, "supplier"))
    lists = lambda df: df.withColumns({c: F.array(F.col("v").cast("string")) for c in D.PRINTS})
    stored = schemas.conform(lists(of(STORED_REPOS)).withColumn("created_at", F.col("at")).withColumn("updated_at", F.col("at")), "repos")
    detected = lists(of(DETECTED_REPOS)).withColumn("test_framework", F.lit(None).cast("string")).withColumn("fingerprint_embedding", F.lit(None).cast("array<float>"))
    return D.upsert_repos(stored, detected, F.expr(AS_OF)).select("id", "path", "name", F.get("languages", F.lit(0)).cast("int").alias("v"), "updated_at", "created_at")


@query("repo_clear", sql("files", "symbols", "imports", body="SELECT (SELECT count(*) FROM files WHERE file_id % 4 <> 1) AS files, (SELECT count(*) FROM symbols WHERE file_id % 4 <> 1) AS symbols, (SELECT count(*) FROM imports WHERE file_id % 4 <> 1) AS imports"))
def repo_clear(spark: SparkSession, d: str) -> DataFrame:
    files = J.files(spark, d).select(F.col("file_id").alias("id"), (F.col("file_id") % 4).alias("repo_id"), "file_path")
    left = D.clear_repo(files, J.symbols(spark, d), J.imports(spark, d), 1)
    counts = [df.agg(F.count("*").alias(n)) for df, n in zip(left, ("files", "symbols", "imports"), strict=True)]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


@query("meta_upsert", f"SELECT coalesce(s.key, n.key) AS key, coalesce(n.value, s.value) AS value, CASE WHEN n.key IS NOT NULL THEN {AS_OF} ELSE s.at END AS updated_at FROM (SELECT n_name AS key, 'old' AS value, TIMESTAMP '2024-01-01 00:00:00' AS at FROM nation WHERE n_nationkey % 2 = 0) s FULL JOIN (SELECT n_name AS key, CAST(n_regionkey AS STRING) AS value FROM nation WHERE n_nationkey % 3 = 0) n ON s.key = n.key")
def meta_upsert(spark: SparkSession, d: str) -> DataFrame:
    nation = t(spark, d, "nation")
    stored = nation.where("n_nationkey % 2 = 0").selectExpr("n_name AS key", "'old' AS value", "TIMESTAMP '2024-01-01 00:00:00' AS updated_at")
    new = nation.where("n_nationkey % 3 = 0").selectExpr("n_name AS key", "CAST(n_regionkey AS STRING) AS value")
    return D.upsert_meta(stored, new.unionByName(new), F.expr(AS_OF))


@query("index_merge", "SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN n.file_path IS NOT NULL THEN n.v ELSE o.v END AS v FROM (SELECT concat('f', CAST(page_id AS STRING)) AS file_path, page_id AS v FROM pages WHERE page_id % 4 <> 0 AND page_id % 6 <> 1) o FULL JOIN (SELECT concat('f', CAST(page_id AS STRING)) AS file_path, page_id + 1000000 AS v FROM pages WHERE page_id % 4 = 0) n ON o.file_path = n.file_path")
def index_merge(spark: SparkSession, d: str) -> DataFrame:
    pages = t(spark, d, "pages").selectExpr("concat('f', CAST(page_id AS STRING)) AS file_path", "page_id AS v")
    changes = pages.selectExpr("file_path", "CASE WHEN v % 4 = 0 THEN 'modified' WHEN v % 6 = 1 THEN 'deleted' ELSE 'unchanged' END AS status")
    return C.merge_index(pages, pages.where("v % 4 = 0").withColumn("v", F.col("v") + 1000000), changes)


@query("ledger_clear", "SELECT event_type AS hook_name, user_id AS session_id, min(ts) AS executed_at FROM events WHERE NOT (event_type = 'click' AND user_id = 3) AND event_type <> 'view' GROUP BY 1, 2")
def ledger_clear(spark: SparkSession, d: str) -> DataFrame:
    marked = R.ledger_mark(t(spark, d, "events").selectExpr("event_type AS hook_name", "user_id AS session_id", "ts AS executed_at"))
    return R.ledger_clear(R.ledger_clear(marked, "click", 3), "view")


@query("warnings_remove", sql("warnings", body="SELECT id, target FROM warnings WHERE id % 9 <> 0"))
def warnings_remove(spark: SparkSession, d: str) -> DataFrame:
    return R.remove_warnings(J.warnings(spark, d), t(spark, d, "part").where("p_partkey % 9 = 0").select(F.col("p_partkey").alias("id"))).select("id", "target")


@query("repo_names", "SELECT DISTINCT url, CASE WHEN page_id % 2 = 0 THEN concat('app', CAST(page_id AS STRING)) ELSE concat('dir', CAST(page_id AS STRING)) END AS name, page_id FROM pages")
def repo_names(spark: SparkSession, d: str) -> DataFrame:
    remote = F.expr("CASE WHEN page_id % 4 = 0 THEN concat('git@host:team/app', CAST(page_id AS STRING), '.git') WHEN page_id % 2 = 0 THEN concat('https://host/team/app', CAST(page_id AS STRING)) END")
    root = F.expr("concat('/home/dir', CAST(page_id AS STRING), CASE WHEN page_id % 3 = 0 THEN '/' ELSE '' END)")
    return t(spark, d, "pages").select("url", D.repo_name(root, remote).alias("name"), "page_id")
