"""Queries on a code index: files (file_id, repo_id, file_path), symbols and imports.

symbols: symbol_id, file_id, name, kind, exported, line, scope. imports: import_id, file_id, imported_name, local_name,
source_path, is_default, is_namespace, is_type, line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.scalar import ascii_fold, loose_like

SCRIPT = r"\.(ts|tsx|js|jsx|mjs)$"


def in_files(rows: DataFrame, files: DataFrame, repo_id=None) -> DataFrame:
    own = files if repo_id is None else files.where(F.col("repo_id") == repo_id)
    return rows.join(own.select("file_id", "repo_id", "file_path"), "file_id")


def find_definitions(symbols: DataFrame, files: DataFrame, name: str, kind: str | None = None, file_path: str | None = None, repo_id=None) -> DataFrame:
    rows = symbols.where(F.col("name") == name)
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    rows = in_files(rows, files, repo_id)
    rows = rows if file_path is None else rows.where(F.col("file_path") == file_path)
    return rows.orderBy(F.col("exported").desc(), "file_path", "line", "symbol_id")


def list_exports(symbols: DataFrame, files: DataFrame, prefix: str | None = None, repo_id=None) -> DataFrame:
    rows = in_files(symbols.where("exported"), files, repo_id)
    rows = rows if prefix is None else rows.where(loose_like(F.col("file_path"), F.lit(prefix + "%")))
    return rows.orderBy("file_path", "line", "symbol_id")


def search_symbols(symbols: DataFrame, files: DataFrame, query: str, limit: int = 30, kind: str | None = None, repo_id=None) -> DataFrame:
    """Substring search: equal names first, then prefixes, then the rest; exported before others, short before long."""
    rows = symbols.where(loose_like(F.col("name"), F.lit(f"%{query}%")))
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    tier = F.when(F.col("name") == query, 0).when(loose_like(F.col("name"), F.lit(query + "%")), 1).otherwise(2)
    return in_files(rows, files, repo_id).withColumn("tier", tier).orderBy("tier", F.col("exported").desc(), F.length("name"), "file_path", "line", "symbol_id").limit(limit)


def file_imports(imports: DataFrame, files: DataFrame, file_path: str, repo_id=None) -> DataFrame:
    return in_files(imports, files.where(F.col("file_path") == file_path), repo_id).orderBy("line", "import_id")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, SCRIPT, ""), "/"), -1)


def path_keys(source: Column) -> Column:
    """Base names that an import path meets: its last part, and the one before a last part ``index``."""
    parts = F.split(source, "/")
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == "index"), F.array(F.element_at(parts, -1), F.get(parts, F.size(parts) - 2))).otherwise(F.array(F.element_at(parts, -1)))


def callers(definitions: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """Importing places of each definition (def_id, name, def_path): by name, or by a default or namespace import of its file.

    The disjunction is a union of two equi-joins, and of the places in one line of one file the first stays.
    """
    placed = in_files(imports, files)
    named = placed.select("import_id", "file_path", "line", "imported_name", "local_name", F.explode(F.array_distinct(F.array("imported_name", "local_name"))).alias("name"))
    by_name = definitions.join(named, "name").select("def_id", "def_path", "import_id", "file_path", "line", "imported_name")
    whole = placed.where(F.col("is_default") | F.col("is_namespace")).select("import_id", "file_path", "line", "imported_name", F.explode(F.array_distinct(path_keys(F.col("source_path")))).alias("base"))
    by_path = definitions.withColumn("base", base_name(F.col("def_path"))).join(whole, "base").select("def_id", "def_path", "import_id", "file_path", "line", "imported_name")
    met = by_name.unionByName(by_path).where(F.col("file_path") != F.col("def_path"))
    first = F.min_by("imported_name", "import_id").alias("imported_name")
    return met.groupBy("def_id", "file_path", "line").agg(first)


def dead_exports(symbols: DataFrame, imports: DataFrame, files: DataFrame, entry: Column | None = None, limit: int | None = 100) -> DataFrame:
    """Exported symbols without a caller, in files that are no entry points: two anti-joins. Without a limit, all of them.

    A file that imports a name counts for all definitions of the name but its own; so a name with one importing
    file is alive everywhere but there. Only (name, smallest and largest importing file) is joined.
    """
    rows = in_files(symbols.where("exported"), files)
    rows = rows if entry is None else rows.where(~entry)
    placed = in_files(imports, files)
    names = placed.select("file_path", F.explode(F.array("imported_name", "local_name")).alias("name")).groupBy("name").agg(F.min("file_path").alias("lo"), F.max("file_path").alias("hi"))
    whole = placed.where(F.col("is_default") | F.col("is_namespace")).select("file_path", F.explode(path_keys(F.col("source_path"))).alias("base")).groupBy("base").agg(F.min("file_path").alias("lo"), F.max("file_path").alias("hi"))
    elsewhere = lambda a: (F.col(f"{a}.lo") != F.col("s.file_path")) | (F.col(f"{a}.hi") != F.col("s.file_path"))
    left = rows.withColumn("base", base_name(F.col("file_path"))).alias("s")
    left = left.join(names.alias("n"), (F.col("s.name") == F.col("n.name")) & elsewhere("n"), "left_anti")
    left = left.join(whole.alias("w"), (F.col("s.base") == F.col("w.base")) & elsewhere("w"), "left_anti")
    return left if limit is None else left.orderBy("file_path", "line", "symbol_id").limit(limit)


def index_status(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """One row: files, symbols, imports, and the latest indexing."""
    one = files.agg(F.count("*").alias("files"), F.max("indexed_at").alias("last_indexed"))
    return one.crossJoin(symbols.agg(F.count("*").alias("symbols"))).crossJoin(imports.agg(F.count("*").alias("imports")))


def diff(scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    """file_path and status of each file: the hash counts only where the modification time is newer."""
    s, x = scanned.select("file_path", F.col("mtime").alias("s_mtime"), F.col("hash").alias("s_hash")), indexed.select("file_path", F.col("mtime").alias("x_mtime"), F.col("hash").alias("x_hash"))
    newer = F.col("s_mtime") > F.col("x_mtime")
    status = F.when(F.col("x_mtime").isNull(), "added").when(F.col("s_mtime").isNull(), "deleted").when(newer & (F.col("x_hash").isNull() | (F.col("s_hash") != F.col("x_hash"))), "modified").otherwise("unchanged")
    return s.join(x, "file_path", "full_outer").select("file_path", status.alias("status"))


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count("*").alias("n"))


def merge_index(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of an index table after a reindex: those of changed or deleted files go, the new ones come. Both have file_path."""
    gone = changes.where(F.col("status").isin("modified", "deleted")).select("file_path")
    return old.join(gone, "file_path", "left_anti").unionByName(new, allowMissingColumns=True)


def suggest_files(paths: DataFrame, query: str, limit: int = 15) -> DataFrame:
    """Distinct paths that hold the query's characters in order, substrings and short paths first. An approximation."""
    import re

    fuzzy = "(?i)" + ".*".join(map(re.escape, query))
    rows = paths.select("file_path").distinct().where(F.col("file_path").rlike(fuzzy))
    return rows.orderBy(~ascii_fold(F.col("file_path")).contains(query.lower()), F.length("file_path"), "file_path").limit(limit)


def top_definition(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The definition that caller search starts from, for every name."""
    order = Window.partitionBy("name").orderBy(F.col("exported").desc(), "file_path", "line", "symbol_id")
    return in_files(symbols, files).withColumn("_n", F.row_number().over(order)).where("_n = 1").select(F.col("symbol_id").alias("def_id"), "name", F.col("file_path").alias("def_path"))
