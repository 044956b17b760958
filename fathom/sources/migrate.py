"""Versioned steps that bring stored tables to the current schema, one after another and each only once.

Every step is a function of the store that may be run again, and its version is noted when it is done; so a migration that
stopped goes on with the step it stopped in. A store without versions and without tables is fresh: it gets all tables at
once. One with tables but no version is of the first version.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import functions as F

from fathom.sources import schemas
from fathom.sources.store import Store

# Tables of removed features.
REMOVED = ["dreamer_executions", "dreamer_tasks", "background_jobs"]
# The tables that a version brought, and the columns of solutions that one did.
ADDED = {
    2: ["warnings", "dependency_installs"], 3: ["session_summaries", "api_cache"], 4: ["hook_executions", "plugin_meta"], 5: ["repo_files", "symbols", "imports", "symbol_refs"],
}
COLUMNS = {6: ["category", "complexity"], 7: ["prerequisites", "anti_patterns", "code_blocks", "related_solutions", "supersedes"]}


def make(store: Store, names: list[str]) -> None:
    for name in names:
        if store.current(name) is None:
            store.write(name, store.spark.createDataFrame([], schemas.schema(name)))


def add_columns(store: Store, name: str, columns: list[str]) -> None:
    """The named columns of the schema, where the table lacks them: nulls, or empty arrays."""
    df = store.read(name)
    kinds = {f.name: f.dataType for f in schemas.schema(name).fields}
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        store.write(name, df.withColumns({c: (F.array().cast(kinds[c]) if kinds[c].typeName() == "array" else F.lit(None).cast(kinds[c])) for c in lacking}))


def conform_all(store: Store) -> None:
    """Every stored table of the schema with exactly its columns and types; tables that conform are left alone."""
    for name in schemas.TABLES:
        if store.current(name) is not None and [(f.name, f.dataType) for f in store.read(name).schema.fields] != [(f.name, f.dataType) for f in schemas.schema(name).fields]:
            store.write(name, schemas.conform(store.read(name), name))
    make(store, list(schemas.TABLES))


def drop(store: Store, names: list[str]) -> None:
    for name in names:
        store.drop(name)


def steps() -> dict[int, Callable[[Store], None]]:
    """What brings a store to each version from the one before."""
    out: dict[int, Callable[[Store], None]] = {v: lambda s, names=names: make(s, names) for v, names in ADDED.items()}
    out |= {v: lambda s, columns=columns: add_columns(s, "solutions", columns) for v, columns in COLUMNS.items()}
    out[8] = lambda s: drop(s, REMOVED)
    out[schemas.VERSION] = conform_all
    return out


def version(store: Store) -> int:
    """The last version noted; 0 for a fresh store, 1 for one that is older than versions."""
    noted = store.read("schema_version").agg(F.max("version")).first()[0] if store.current("schema_version") else None
    if noted is not None:
        return noted
    return 1 if any(store.current(n) for n in ("solutions", "failures", "repos", "usage_log")) else 0


def migrate(store: Store, clock: Callable[[], datetime] = datetime.now, chain: dict[int, Callable[[Store], None]] | None = None) -> list[int]:
    """Brings the store to the current version; the versions of the steps taken. A newer store is an error."""
    chain = steps() if chain is None else chain
    last, at = max(chain), version(store)
    if at > last:
        raise ValueError(f"the store has version {at}, this code knows {last}")
    pending = [v for v in sorted(chain) if v > at]
    if at == 0:
        make(store, [n for n in schemas.TABLES if n != "schema_version"])
        pending = pending[-1:]
    for v in pending:
        if at:
            chain[v](store)
        row = store.spark.createDataFrame([(v, clock())], "version int, applied_at timestamp")
        store.append("schema_version", schemas.conform(row, "schema_version"))
    return pending
