"""Diagnostics of a store and its configuration: twelve checks, each a row of name, status, message and whether a fix is known."""

from __future__ import annotations

import copy

from fathom.sources import config as C
from fathom.sources import schemas
from fathom.sources.store import Store

# The sections that a configuration must have, and tool names of old versions.
SECTIONS = ["search", "index", "rules", "cache", "sensitive", "permissions", "agents", "delegation"]
OLD_TOOLS = ["warn_add", "warn_remove", "warn_check", "warn_list"]


def checks(store: Store, config: dict, listing: list[str] | None = None, skills: list[str] | None = None) -> list[dict]:
    """The checks in order. ``listing`` has the file names of the project folder, ``skills`` the installed skills."""
    out: list[dict] = []

    def add(name: str, status: str, message: str, fixable: bool = False) -> None:
        out.append({"name": name, "status": status, "message": message, "fixable": fixable})

    there = {n: store.current(n) for n in schemas.TABLES}
    present = [n for n, at in there.items() if at]
    add("Store Directory", "pass" if present else "fail", f"{len(present)} tables" if present else "no tables", not present)
    if not there["schema_version"]:
        add("Database", "fail", "no schema version", True)
    else:
        current = schemas.version_of(store.read("schema_version")).first()["current"]
        missing = [f"{n}.{f.name}" for n in present for f in schemas.schema(n) if f.name not in store.read(n).columns]
        if current < schemas.VERSION or missing:
            add("Database", "warn", f"schema v{current} of v{schemas.VERSION}" + (", missing " + ", ".join(missing[:3]) if missing else ""), True)
        else:
            add("Database", "pass", f"schema v{current}, {store.read('solutions').count()} solutions")
    gone = [s for s in SECTIONS if s not in config]
    add("Configuration", "warn" if gone else "pass", "missing sections: " + ", ".join(gone[:3]) + (f" (+{len(gone) - 3} more)" if len(gone) > 3 else "") if gone else "all sections", bool(gone))
    old = [t for t in C.get(config, "permissions.never", []) if t in OLD_TOOLS]
    add("Config Migration", "warn" if old else "pass", "deprecated tools: " + ", ".join(old) if old else "current tool names", bool(old))
    add("Hook Executions", "pass" if there["hook_executions"] else "warn", "table present" if there["hook_executions"] else "table missing", not there["hook_executions"])
    rules = C.get(config, "rules.rules", [])
    bad = [r for r in rules if not {"event", "pattern", "action"} <= set(r)]
    add("Hooks", "warn" if bad else "pass", f"{len(bad)} rules without event, pattern or action" if bad else f"{len(rules)} rules")
    agents = C.get(config, "agents", {})
    unset = [k for k in ("prefer_index", "prefer_docs") if k not in agents]
    add("Subagent Hooks", "warn" if unset else "pass", "not set: " + ", ".join(unset) if unset else "configured", bool(unset))
    files = store.read("repo_files").count() if there["repo_files"] else 0
    add("Code Index", "pass" if files else "warn", f"{store.read('symbols').count() if there['symbols'] else 0} symbols in {files} files" if files else "repository not indexed")
    add("Repo Detection", "pass" if listing else "warn", f"{len(listing)} files" if listing else "no repository found")
    enabled = C.get(config, "delegation.enabled")
    add("Model Delegation", "warn" if enabled is None else "pass", "not set" if enabled is None else "enabled" if enabled else "disabled", enabled is None)
    add("Skills Directory", "pass" if skills is not None else "warn", f"{len(skills)} skills" if skills is not None else "not found")
    add("File Suggestion", "pass" if C.get(config, "index.suggest") else "warn", "on" if C.get(config, "index.suggest") else "off", not C.get(config, "index.suggest"))
    return out


def fixed(store: Store, config: dict, found: list[dict], clock) -> tuple[list[dict], dict]:
    """The checks after all known fixes, and the configuration that they need: data and settings of the user stay."""
    new = copy.deepcopy(config)
    broken = {c["name"] for c in found if c["status"] != "pass" and c["fixable"]}
    if broken & {"Store Directory", "Database", "Hook Executions"}:
        for name in schemas.TABLES:
            if store.current(name) is None or any(f.name not in store.read(name).columns for f in schemas.schema(name)):
                store.write(name, schemas.conform(store.read(name), name))
        if schemas.version_of(store.read("schema_version")).first()["current"] < schemas.VERSION:
            store.append("schema_version", store.spark.createDataFrame([(schemas.VERSION, clock())], schemas.schema("schema_version")))
    if "Configuration" in broken:
        new = C.merge({s: C.DEFAULTS.get(s, {}) for s in SECTIONS}, new)
    if "Config Migration" in broken:
        never = ["warn" if t in OLD_TOOLS else t for t in C.get(new, "permissions.never", [])]
        new = C.put(new, "permissions.never", list(dict.fromkeys(never)))
    for name, path, value in (("Subagent Hooks", "agents.prefer_index", True), ("Subagent Hooks", "agents.prefer_docs", True), ("Model Delegation", "delegation.enabled", True), ("File Suggestion", "index.suggest", True)):
        if name in broken and C.get(new, path) is None:
            new = C.put(new, path, value)
    return found, new


def healthy(found: list[dict]) -> bool:
    """No check fails."""
    return all(c["status"] != "fail" for c in found)
