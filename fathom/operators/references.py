"""What keeps code alive that no import statement names: an inverted index of the files' lines.

``lines`` has repo_id, file_path, line, text. A posting is a token of one of these kinds:

* dynamic: the file that an ``import(...)`` or ``require(...)`` loads, reexport: one that ``export ... from`` passes on; the
  key is the file's base name, or its folder's for an index file
* string: a quoted string that is a name
* decorator: the name of a decorator that begins a line; tag: a ``@public`` or ``@api`` in a documentation comment

Postings are made by one scan of the lines with column functions and are counted down to the first and the last file of
each key before anything is joined, so a key that every file has is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.codeindex import SCRIPT

# What a reference looks like; the first group is the key.
DYNAMIC = r"""\b(?:import|require)\(\s*['"]([^'"]+)['"]"""
REEXPORT = r"""\bexport\s+(?:\*(?:\s+as\s+[\w$]+)?|(?:type\s+)?\{[^}]*\})\s+from\s+['"]([^'"]+)['"]"""
STRING = r"""['"]([A-Za-z_$][\w$]*)['"]"""
DECORATOR = r"^\s*@([A-Za-z_$][\w$]*)"
TAG = r"^\s*/?\*.*@(public|api)\b"
# Decorators that register what they stand at.
REGISTERING = ["Controller", "Injectable", "Module", "Component", "Directive", "Pipe", "Entity", "Resolver", "Service"]
# Files that are a package's surface, and folders that are.
ROOT_INDEX, PUBLIC_FOLDER = r"^(?:src/)?index\.(?:ts|js)$", r"(?:^|/)(?:public|api)/"


def file_key(path: Column) -> Column:
    """The last part of a path without a script's extension; for an index file, the folder's name."""
    parts = F.split(F.regexp_replace(path, SCRIPT, ""), "/")
    last, before = F.element_at(parts, -1), F.get(parts, F.size(parts) - 2)
    return F.when((last == "index") & (F.size(parts) > 1), before).otherwise(last)


def postings(lines: DataFrame) -> DataFrame:
    """repo_id, kind, key, lo, hi: the first and the last file that has the token."""
    text = F.col("text")
    found = lambda kind, pattern, key=lambda c: c: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), key(x).alias("key")))
    every = F.concat(found("dynamic", DYNAMIC, file_key), found("reexport", REEXPORT, file_key), found("string", STRING), found("decorator", DECORATOR), found("tag", TAG))
    some = lines.where(text.rlike(r"""['"@]"""))
    return some.select("repo_id", "file_path", F.explode(every).alias("p")).groupBy("repo_id", "p.kind", "p.key").agg(F.min("file_path").alias("lo"), F.max("file_path").alias("hi"))


def marked_files(lines: DataFrame) -> DataFrame:
    """repo_id, file_path, decorated, public_doc of the files with a registering decorator or a public tag."""
    hit = F.regexp_extract("text", DECORATOR, 1)
    flagged = lines.select("repo_id", "file_path", hit.isin(REGISTERING).alias("decorated"), F.col("text").rlike(TAG).alias("public_doc"))
    return flagged.where("decorated OR public_doc").groupBy("repo_id", "file_path").agg(F.max("decorated").alias("decorated"), F.max("public_doc").alias("public_doc"))


FLAGS = ["dynamic_import", "reexported", "string_named", "decorated", "public_doc", "public_folder", "root_index", "listed"]


def evidence(rows: DataFrame, lines: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """``rows`` (repo_id, file_path, name, and further columns) with the flags that speak for each.

    dynamic_import and reexported: another file's line loads or passes on a file of this base name; string_named: a line
    of any file has the name in quotes; decorated and public_doc: of the own file; public_folder and root_index: by the
    path; listed: the file is in ``listed`` (repo_id, file_path), such as a package's map of exports. A null name is
    named nowhere.
    """
    posted = postings(lines)
    path = posted.where(F.col("kind").isin("dynamic", "reexport")).groupBy("repo_id", F.col("key").alias("_key"))
    by_path = path.agg(*[f(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{c}") for kind in ("dynamic", "reexport") for c, f in (("lo", F.min), ("hi", F.max))])
    named = posted.where("kind = 'string'").select("repo_id", F.col("key").alias("_name"), F.lit(True).alias("string_named"))
    elsewhere = lambda kind: F.coalesce((F.col(f"{kind}_lo") != F.col("file_path")) | (F.col(f"{kind}_hi") != F.col("file_path")), F.lit(False))
    own = listed.select("repo_id", "file_path", F.lit(True).alias("listed")).distinct() if listed is not None else None
    met = rows.withColumn("_key", file_key(F.col("file_path"))).join(by_path, ["repo_id", "_key"], "left")
    met = met.withColumn("_name", F.col("name")).join(named, ["repo_id", "_name"], "left").join(marked_files(lines), ["repo_id", "file_path"], "left")
    met = met.withColumn("listed", F.lit(False)) if own is None else met.join(own, ["repo_id", "file_path"], "left")
    flags = {
        "dynamic_import": elsewhere("dynamic"), "reexported": elsewhere("reexport"), "public_folder": F.col("file_path").rlike(PUBLIC_FOLDER), "root_index": F.col("file_path").rlike(ROOT_INDEX),
        **{c: F.coalesce(c, F.lit(False)) for c in ("string_named", "decorated", "public_doc", "listed")},
    }
    return met.select(*rows.columns, *[flags[c].alias(c) for c in FLAGS])


def dead_code(dead: DataFrame, orphaned: DataFrame, lines: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Findings for ``review.cleanup_confidence``: id, category, flags, safe.

    ``dead`` has repo_id, file_path, name, id of exports that nothing imports, ``orphaned`` repo_id, file_path, exports, id of
    files. A safety rule excludes what is loaded or named dynamically, what a decorator registers and what is a
    package's surface; re-exports, public folders and tags only lower the confidence, as does a file's dynamic import.
    """
    held = lambda names: F.array_compact(F.array(*[F.when(condition, F.lit(flag)) for flag, condition in names.items()]))
    e = evidence(dead, lines, listed)
    exports = held({"no_callers": F.lit(True), "reexported": F.col("reexported"), "public_folder": F.col("public_folder"), "public_doc": F.col("public_doc"), "underscore": F.col("name").startswith("_")})
    spoken = F.col("dynamic_import") | F.col("string_named") | F.col("decorated") | F.col("root_index") | F.col("listed")
    first = e.select("id", F.lit("dead_export").alias("category"), exports.alias("flags"), spoken.alias("safe"))
    o = evidence(orphaned.withColumn("name", F.lit(None).cast("string")), lines, listed)
    files = held({"no_exports": F.col("exports") == 0, "dynamic_import": F.col("dynamic_import") | F.col("reexported")})
    return first.unionByName(o.select("id", F.lit("orphaned_file").alias("category"), files.alias("flags"), (F.col("decorated") | F.col("root_index") | F.col("listed")).alias("safe")))
