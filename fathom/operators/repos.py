"""Repositories and metadata: names, upserts, and what goes with a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.hooks import repo_id_of

PRINTS = ["languages", "frameworks", "dependencies", "patterns"]


def repo_name(root: Column, remote: Column) -> Column:
    """The last part of the remote address without .git, else the folder's name."""
    named = F.regexp_extract(remote, r"/([^/]+?)(?:\.git)?$", 1)
    return F.when(named != "", named).otherwise(F.element_at(F.split(F.regexp_replace(root, "/+$", ""), "/"), -1))


def upsert_repos(stored: DataFrame, detected: DataFrame, as_of: Column) -> DataFrame:
    """``stored`` (table repos) after ``detected`` (path, name, PRINTS, test_framework, fingerprint_embedding), by path.

    A known repository keeps its id and changes only where one of its four lists does; a new one is named by its path.
    """
    new = detected.select("path", *[F.col(c).alias("n_" + c) for c in ("name", *PRINTS, "test_framework", "fingerprint_embedding")], F.lit(True).alias("given"))
    both = stored.join(new, "path", "full_outer")
    known, same = F.col("id").isNotNull(), F.lit(True)
    for c in PRINTS:
        same = same & F.col(c).eqNullSafe(F.col("n_" + c))
    changed = F.coalesce("given", F.lit(False)) & (~known | ~same)
    values = {c: F.when(changed, F.col("n_" + c)).otherwise(F.col(c)) for c in ("name", *PRINTS, "test_framework", "fingerprint_embedding")}
    values |= {"id": F.coalesce("id", repo_id_of(F.col("path"))), "updated_at": F.when(changed, as_of).otherwise(F.col("updated_at")), "created_at": F.coalesce("created_at", as_of)}
    return both.select(*[values.get(c, F.col(c)).alias(c) for c in stored.columns])


def clear_repo(files: DataFrame, symbols: DataFrame, imports: DataFrame, repo_id) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, symbols and imports without those of one repository."""
    gone = files.where(F.col("repo_id") == repo_id).select(F.col("id").alias("file_id"))
    return files.where(~F.col("repo_id").eqNullSafe(F.lit(repo_id))), symbols.join(gone, "file_id", "left_anti").select(*symbols.columns), imports.join(gone, "file_id", "left_anti").select(*imports.columns)


def upsert_meta(stored: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """``stored`` (key, value, updated_at) with the pairs of ``new`` (key, value) put in; of equal keys the greatest value."""
    given = new.groupBy("key").agg(F.max("value").alias("n_value"), F.lit(True).alias("given"))
    both = stored.join(given, "key", "full_outer")
    return both.select("key", F.when(F.col("given"), F.col("n_value")).otherwise(F.col("value")).alias("value"), F.when(F.col("given"), as_of).otherwise(F.col("updated_at")).alias("updated_at"))
