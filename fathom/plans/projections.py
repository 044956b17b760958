"""The logical tables as projections of the star-schema test tables: one expression text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOLUTIONS = [
    ("e.vec_id", "id"), ("e.embedding", "embedding"), ("d.text", "problem"), ("CASE WHEN e.vec_id % 3 = 0 THEN 'global' WHEN e.vec_id % 3 = 1 THEN 'stack' ELSE 'repo' END", "scope"),
    ("CASE WHEN e.vec_id % 4 = 0 THEN 'bugfix' WHEN e.vec_id % 4 = 1 THEN 'feature' WHEN e.vec_id % 4 = 2 THEN 'refactor' ELSE 'config' END", "category"),
    ("CASE WHEN e.vec_id % 7 = 0 THEN NULL ELSE e.vec_id % 10 + 1 END", "complexity"), ("e.label", "repo_id"), ("0.5 + (e.vec_id % 50) / 100.0", "score"), ("e.vec_id % 8", "successes"), ("e.vec_id % 5", "failures"),
    ("CASE WHEN e.vec_id % 20 = 0 AND e.vec_id > 0 THEN e.vec_id - 1 END", "supersedes"), ("d.lang", "lang"), ("d.source", "source"), ("l.quality", "quality"),
]
SOLUTIONS_FROM = "embeddings e JOIN documents d ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = e.vec_id"
USAGE = [("event_id", "log_id"), ("user_id", "solution_id"), ("ts", "ts"), ("CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'success' WHEN 'click' THEN 'partial' WHEN 'error' THEN 'failure' ELSE 'ignored' END", "outcome")]
ERRORS = [("event_id", "seq"), ("ts", "ts"), ("CASE WHEN event_id % 3 = 0 THEN 'build' ELSE 'runtime' END", "error_type"),
          ("concat('Error at line ', CAST(event_id % 40 AS STRING), ' in /usr/src/app', CAST(user_id % 3 AS STRING), '/main.ts: cannot find ''x', CAST(user_id AS STRING), ''' in  module ', CASE WHEN user_id % 4 = 0 THEN 'alpha' WHEN user_id % 4 = 1 THEN 'beta' ELSE 'gamma' END)", "error_message"),
          ("CASE WHEN event_id % 5 = 0 THEN concat('cause ', CAST(user_id AS STRING)) END", "root_cause"), ("CASE WHEN event_id % 11 = 0 THEN concat('fix ', CAST(event_id AS STRING)) END", "fix_applied")]
# A file for each supplier; every 25th is a folder's index and every 25th, one further, a script.
STEM = "CASE WHEN {k} % 25 = 0 THEN concat('src/m', CAST({k} % 5 AS STRING), '/d', CAST({k} AS STRING)) WHEN {k} % 25 = 1 THEN concat('scripts/f', CAST({k} AS STRING)) ELSE concat('src/m', CAST({k} % 5 AS STRING), '/f', CAST({k} AS STRING)) END"
FILE_PATH = "concat({stem}, CASE WHEN {k} % 25 = 0 THEN '/index.ts' ELSE '.ts' END)".replace("{stem}", STEM)
FILES = [("s_suppkey", "file_id"), ("CAST(floor(s_suppkey / 25.0) AS BIGINT) % 4 + 1", "repo_id"), (FILE_PATH.format(k="s_suppkey"), "file_path"), ("s_nationkey", "mtime")]
NAME = "concat(replace({p}name, ' ', '_'), CASE WHEN {p}partkey % 3 < 2 THEN CAST(CAST(floor({p}partkey / 40.0) AS BIGINT) AS STRING) ELSE '' END)"
SYMBOLS = [("p_partkey", "symbol_id"), ("CAST(floor(p_partkey / 20.0) AS BIGINT)", "file_id"), (NAME.format(p="p_"), "name"), ("p_type", "kind"), ("p_size % 2 = 1", "exported"), ("p_size", "line"), ("p_brand", "scope")]
# Every line item is an import: of another file of the supplier's block of five (a circle and its chords), or of a file of
# the next block; some by an alias, some of a package, some with an extension that no file has. No import is of a file
# whose number leaves 17 by 25, nor of the name of a part whose number leaves 5 by 8; whole files are imported of every fourth.
MEANT = "CASE WHEN l.l_linenumber % 3 = 0 AND l.l_suppkey % 25 = 3 THEN l.l_suppkey + 5 ELSE l.l_suppkey - l.l_suppkey % 5 + (l.l_suppkey + 1 + l.l_partkey % 2) % 5 END"
TARGET = f"{MEANT} + CASE WHEN ({MEANT}) % 25 = 17 THEN 1 ELSE 0 END"
UP = "CASE WHEN x.l_suppkey % 25 = 0 THEN '../../../' WHEN x.l_suppkey % 25 = 1 THEN '../' ELSE '../../' END"
SOURCE = f"concat(CASE WHEN x.l_orderkey % 6 = 0 THEN 'lodash' WHEN x.l_orderkey % 6 = 1 AND x.to_file % 25 <> 1 THEN concat('@app', substr({STEM.format(k='x.to_file')}, 4)) WHEN x.l_suppkey % 25 > 1 AND x.to_file % 25 > 1 AND x.l_suppkey % 5 = x.to_file % 5 THEN concat('./f', CAST(x.to_file AS STRING)) ELSE concat({UP}, {STEM.format(k='x.to_file')}) END, CASE WHEN x.l_orderkey % 11 = 0 THEN '.js' ELSE '' END)"
IMPORTS = [("x.l_orderkey * 10 + x.l_linenumber", "import_id"), ("x.l_suppkey", "file_id"), (f"CASE WHEN p_partkey % 8 = 5 THEN '*' ELSE {NAME.format(p='p_')} END", "imported_name"), ("concat('l_', CAST(x.l_partkey % 30 AS STRING))", "local_name"), (SOURCE, "source_path"),
           ("x.l_linenumber = 1 AND x.l_partkey % 9 = 0 AND x.to_file % 4 = 1", "is_default"), ("x.l_linenumber = 2 AND x.l_partkey % 9 = 0 AND x.to_file % 4 = 1", "is_namespace"), ("x.l_linenumber", "line")]
IMPORTS_INNER = f"SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_partkey, {TARGET} AS to_file, p.p_name, p.p_partkey FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"
# Every line item is a line of code too: dynamic imports of one file in fifty, re-exports, names in quotes, decorators, tags.
CODE = """CASE WHEN l.l_linenumber = 1 AND l.l_orderkey % 3 = 0 THEN concat('const m = await import("../m', CAST((l.l_suppkey - l.l_suppkey % 50 + 17) % 5 AS STRING), '/f', CAST(l.l_suppkey - l.l_suppkey % 50 + 17 AS STRING), '")')
 WHEN l.l_linenumber = 2 THEN concat('const r = require("./f', CAST(l.l_suppkey - l.l_suppkey % 50 + 18 AS STRING), '.js")') WHEN l.l_linenumber = 3 THEN concat('export * from "./f', CAST(l.l_suppkey - l.l_suppkey % 75 + 20 AS STRING), '";')
 WHEN l.l_linenumber = 4 AND p.p_partkey % 3 = 0 THEN concat('container.resolve("', {name}, '")') WHEN l.l_linenumber = 5 AND l.l_suppkey % 30 = 2 THEN '@Injectable()' WHEN l.l_linenumber = 6 AND l.l_suppkey % 40 = 3 THEN '/** @public */'
 ELSE concat('total += f(', {name}, ');') END""".replace("{name}", NAME.format(p="p.p_"))
LINES = [("f.repo_id", "repo_id"), ("f.file_path", "file_path"), ("l.l_orderkey * 10 + l.l_linenumber", "line"), (CODE, "text")]
WARNINGS = [("p_partkey", "id"), ("CASE WHEN p_partkey % 5 = 0 THEN 'package' ELSE 'file' END", "type"), ("CASE WHEN p_partkey % 5 = 0 THEN replace(p_name, ' ', '-') WHEN p_partkey % 2 = 0 THEN concat(substr(p_name, 1, 4), '*') ELSE p_name END", "target"),
            ("CASE WHEN p_partkey % 10 = 0 THEN 'npm' END", "ecosystem"), ("CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 4 END", "repo_id"), ("CASE WHEN p_size % 3 = 0 THEN 'block' WHEN p_size % 3 = 1 THEN 'warn' ELSE 'info' END", "severity"), ("p_brand", "reason")]
COMMAND = "CASE WHEN event_id % 8 = 0 THEN concat('npm install -D pkg', CAST(user_id AS STRING), '@5.0.', CAST(event_id % 9 AS STRING), ' @scope/', event_type, '@^1.2 lodash') WHEN event_id % 8 = 1 THEN concat('pip install requests==2.', CAST(event_id % 7 AS STRING)) WHEN event_id % 8 = 2 THEN 'npm i lodash@latest' WHEN event_id % 8 = 3 THEN concat('git commit -m \"', event_type, '\"') WHEN event_id % 8 = 4 THEN concat('cargo add --dev c', CAST(user_id AS STRING)) WHEN event_id % 8 = 5 THEN '  jj describe' WHEN event_id % 8 = 6 THEN 'sudo npm i x' ELSE 'bun add a b@1' END"
PATH = "CASE WHEN event_id % 9 = 0 THEN concat('app/.env.', event_type) WHEN event_id % 9 = 1 THEN concat('keys/k', CAST(user_id AS STRING), '.PEM') WHEN event_id % 9 = 2 THEN concat('srv/secrets/s', CAST(user_id AS STRING)) WHEN event_id % 9 = 3 THEN 'home/.npmrc' WHEN event_id % 9 = 4 THEN concat('db/passwords.', event_type) WHEN event_id % 9 = 5 THEN 'u/.kube/config' WHEN event_id % 9 = 6 THEN '.env.example' ELSE concat('src/', event_type, CAST(user_id AS STRING), '.ts') END"
PROMPT = "concat(CASE WHEN c.turn % 4 = 0 THEN 'Implement OAuth across the entire codebase. ' WHEN c.turn % 4 = 1 THEN 'fix typo in ' WHEN c.turn % 4 = 2 THEN 'what is the React documentation for next.js? see docs. ' ELSE '1. first migrate the schema then test performance! ' END, c.text)"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exprs(columns: list[tuple[str, str]]) -> list[str]:
    return [f"{e} AS {a}" for e, a in columns]


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d, lab = (t(spark, sf_dir, n).alias(a) for n, a in (("embeddings", "e"), ("documents", "d"), ("labels", "l")))
    return e.join(d, F.expr("e.vec_id = d.doc_id")).join(lab, F.expr("l.doc_id = e.vec_id"), "left").selectExpr(*exprs(SOLUTIONS))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("repo_id")).agg(F.min_by("embedding", "vec_id").alias("vector"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").selectExpr(*exprs(USAGE))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").where("event_type = 'error'").selectExpr(*exprs(ERRORS))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "supplier").selectExpr(*exprs(FILES))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").selectExpr(*exprs(SYMBOLS))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "lineitem").alias("l").join(t(spark, sf_dir, "part").alias("p"), F.expr("l.l_partkey = p.p_partkey"))
    placed = lines.selectExpr("l.l_orderkey", "l.l_linenumber", "l.l_suppkey", "l.l_partkey", f"{TARGET} AS to_file", "p.p_name", "p.p_partkey")
    return placed.alias("x").selectExpr(*exprs(IMPORTS))


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "lineitem").alias("l").join(t(spark, sf_dir, "part").alias("p"), F.expr("l.l_partkey = p.p_partkey"))
    return lines.join(files(spark, sf_dir).alias("f"), F.expr("l.l_suppkey = f.file_id")).selectExpr(*exprs(LINES))


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").selectExpr(*exprs(WARNINGS))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = t(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))  # the SQL's concat passes over nulls
    return turns.alias("c").selectExpr("c.conv_id AS conv_id", "c.turn AS turn", f"{PROMPT} AS prompt")


def _cte(name: str, columns: list[tuple[str, str]], source: str, where: str = "") -> str:
    return f"{name} AS (SELECT {', '.join(exprs(columns))} FROM {source}{' WHERE ' + where if where else ''})"


CTES = {
    "solutions": _cte("solutions", SOLUTIONS, SOLUTIONS_FROM),
    "repos": "repos AS (SELECT label AS repo_id, min_by(embedding, vec_id) AS vector FROM embeddings GROUP BY label)",
    "usage": _cte("usage_log", USAGE, "events"),
    "errors": _cte("errors", ERRORS, "events", "event_type = 'error'"),
    "files": _cte("files", FILES, "supplier"),
    "symbols": _cte("symbols", SYMBOLS, "part"),
    "imports": _cte("imports", IMPORTS, f"({IMPORTS_INNER}) x"),
    "lines": _cte("code_lines", LINES, "lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN files f ON l.l_suppkey = f.file_id"),
    "warnings": _cte("warnings", WARNINGS, "part"),
    "prompts": f"prompts AS (SELECT c.conv_id, c.turn, {PROMPT} AS prompt FROM conversations c)",
}


def sql(*tables: str, body: str) -> str:
    """DuckDB text with the projections in front of ``body`` (which may start with CTEs of its own, then SELECT)."""
    return "WITH " + ", ".join(CTES[x] for x in tables) + (", " if not body.lstrip().upper().startswith("SELECT") else " ") + body
