"""Tables of the memory and of the code index, their enumerations, and how to bring data to a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 9

TABLES = {
    "repos": "id string, path string, name string, languages array<string>, frameworks array<string>, dependencies array<string>, patterns array<string>, test_framework string, fingerprint_embedding array<float>, created_at timestamp, updated_at timestamp",
    "solutions": "id string, repo_id string, problem string, problem_embedding array<float>, solution string, scope string, context struct<filesAffected:array<string>>, tags array<string>, score double, uses long, successes long, partial_successes long, failures long, created_at timestamp, updated_at timestamp, last_used_at timestamp, category string, complexity int, prerequisites array<string>, anti_patterns array<string>, code_blocks array<struct<language:string,code:string,description:string>>, related_solutions array<string>, supersedes string",
    "failures": "id string, repo_id string, error_type string, error_message string, error_signature string, error_embedding array<float>, stack_trace string, files_involved array<string>, root_cause string, fix_applied string, prevention string, occurrences long, resolved_at timestamp, created_at timestamp",
    "usage_log": "id long, solution_id string, repo_id string, outcome string, notes string, created_at timestamp",
    "warnings": "id string, type string, target string, ecosystem string, repo_id string, severity string, reason string, created_at timestamp",
    "api_cache": "cache_key string, response string, created_at timestamp",
    "hook_executions": "hook_name string, session_id string, executed_at timestamp",
    "plugin_meta": "key string, value string, updated_at timestamp",
    "repo_files": "id long, repo_id string, file_path string, mtime long, hash string, indexed_at timestamp",
    "symbols": "id long, repo_id string, file_id long, name string, kind string, line int, column int, end_line int, exported boolean, is_default boolean, scope string, signature string",
    "imports": "id long, file_id long, imported_name string, local_name string, source_path string, is_default boolean, is_namespace boolean, is_type boolean, line int",
    "symbol_refs": "id long, symbol_id long, file_id long, line int, column int",
    "dependency_installs": "id long, package_name string, package_version string, ecosystem string, repo_id string, command string, deprecated boolean, cve_cache string, installed_at timestamp",
    "session_summaries": "id string, session_id string, repo_id string, summary string, created_at timestamp",
    "schema_version": "version int, applied_at timestamp",
}

# What the enumerated columns may hold.
ENUMS = {
    "scope": ["global", "stack", "repo"],
    "category": ["bugfix", "feature", "refactor", "config", "pattern", "optimization"],
    "outcome": ["success", "partial", "failure"],
    "error_type": ["runtime", "build", "test", "type", "other"],
    "severity": ["info", "warn", "block"],
    "type": ["file", "package"],
    "ecosystem": ["npm", "pip", "cargo", "go"],
}
DEFAULTS = {"score": 0.5, "uses": 0, "successes": 0, "partial_successes": 0, "failures": 0, "occurrences": 1, "exported": False, "is_default": False, "is_namespace": False, "is_type": False, "deprecated": False}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the table's columns: missing ones as defaults, unknown ones dropped."""
    have = {c.lower(): c for c in df.columns}
    columns = []
    for f in schema(table):
        value = F.col(have[f.name.lower()]).cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
        if f.name in DEFAULTS and not (table == "solutions" and f.name == "failures" and f.name in have):
            value = F.coalesce(value, F.lit(DEFAULTS[f.name]).cast(f.dataType))
        columns.append(value.alias(f.name))
    return df.select(*columns)


def violations(df: DataFrame, limits: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows that break an enumeration or a range, with the column at fault: a check that Parquet itself does not make."""
    rules = {c: ~F.col(c).isin(v) for c, v in (limits or ENUMS).items() if c in df.columns}
    if "complexity" in df.columns:
        rules["complexity"] = ~F.col("complexity").between(1, 10)
    faults = F.array_compact(F.array(*[F.when(r, F.lit(c)) for c, r in rules.items()]))
    return df.withColumn("faults", faults).where(F.size("faults") > 0)


def version_of(schema_versions: DataFrame) -> DataFrame:
    return schema_versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("current")).withColumn("latest", F.lit(VERSION))


def diagnose(tables: dict[str, DataFrame]) -> DataFrame:
    """name, status, message, fixable: presence, columns and orphaned keys of every table."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name in TABLES:
        if name not in tables:
            rows.append((f"table {name}", "warn", "absent", True))
            continue
        missing = [f.name for f in schema(name) if f.name not in tables[name].columns]
        rows.append((f"table {name}", "fail" if missing else "pass", "missing " + ", ".join(missing) if missing else "columns present", bool(missing)))
    out = spark.createDataFrame(rows, "name string, status string, message string, fixable boolean")
    for child, key, parent in (("symbols", "file_id", "repo_files"), ("imports", "file_id", "repo_files"), ("usage_log", "solution_id", "solutions")):
        if child in tables and parent in tables:
            lost = tables[child].join(tables[parent].select(F.col("id").alias(key)), key, "left_anti").agg(F.count("*").alias("n"))
            out = out.unionByName(lost.select(F.lit(f"{child}.{key}").alias("name"), F.when(F.col("n") > 0, "fail").otherwise("pass").alias("status"), F.concat(F.col("n").cast("string"), F.lit(" orphans")).alias("message"), F.lit(True).alias("fixable")))
    return out
