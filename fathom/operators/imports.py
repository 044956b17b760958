"""The import graph: resolution, orphans, cycles, reach and risk."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.scalar import loose_like

EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs"]

# Paths that count as entry points.
ENTRY_POINTS = [
    r"(?:^|/)(index)\.(ts|tsx|js|jsx|mjs)\z", r"^(main|app|server)\.(ts|tsx|js|jsx|mjs)\z", "(?:^|/)bin/", "(?:^|/)scripts/", r"\.config\.(ts|js|mjs|cjs)\z", r"(?:^|/)cli\.(ts|js|mjs)\z",
    "(?:^|/)pages/", "(?:^|/)app/", "(?:^|/)routes/", "(?:^|/)migrations?/", "(?:^|/)seeds?/",
]


def glob_regex(glob: str) -> str:
    """A user's glob as an unanchored regular expression; ``?`` keeps its regular meaning."""
    import re

    return re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", glob).replace("*", "[^/]*")


def is_entry(path: Column, globs: list[str] = ()) -> Column:
    return path.rlike("|".join(f"(?:{p})" for p in [*ENTRY_POINTS, *map(glob_regex, globs)]))


def normalize_path(path: Column) -> Column:
    """Folds ``.`` and ``..``; a ``..`` above the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(folded, "/")


def candidates(from_path: Column, source: Column, aliases: list[tuple[str, str]] = ()) -> Column:
    """File paths that an import may mean, in order: as written, with each extension, and as a folder's index."""
    folder = F.when(from_path.contains("/"), F.regexp_extract(from_path, "^(.*)/[^/]*$", 1)).otherwise("")
    bases = [F.when(source.startswith("."), normalize_path(F.concat(folder, F.lit("/"), source)))]
    for alias, target in aliases:  # alias and target may end in *
        stem, to = alias.removesuffix("*"), target.removesuffix("*")
        hit = source.startswith(stem) if alias.endswith("*") else source == stem
        bases.append(F.when(~source.startswith(".") & hit, normalize_path(F.concat(F.lit(to), F.substring(source, len(stem) + 1, 10_000) if alias.endswith("*") else F.lit("")))))
    ends = ["", *EXTENSIONS, *("/index" + e for e in EXTENSIONS)]
    return F.flatten(F.array_compact(F.array(*[F.when(b.isNotNull(), F.array(*[F.concat(b, F.lit(e)) for e in ends])) for b in bases])))


def resolve(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """import_id, repo_id, from_path, source_path, to_path: the first candidate that is a file of the same repo; others drop out."""
    placed = imports.join(files.select("file_id", "repo_id", F.col("file_path").alias("from_path")), "file_id")
    listed = placed.select("import_id", "repo_id", "from_path", "source_path", F.posexplode(candidates(F.col("from_path"), F.col("source_path"), aliases)).alias("place", "file_path"))
    met = listed.join(files.select("repo_id", "file_path"), ["repo_id", "file_path"])
    return met.groupBy("import_id", "repo_id", "from_path", "source_path").agg(F.min_by("file_path", "place").alias("to_path"))


def edges(imports: DataFrame, files: DataFrame, prefix: str | None = None, aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """Distinct repo_id, src, dst. With a prefix only imports of files under it count, as does their letter case not."""
    once = imports.groupBy("file_id", "source_path").agg(F.min("import_id").alias("import_id"))  # a path means the same in all imports of a file
    own = resolve(once, files, aliases)
    own = own if prefix is None else own.where(loose_like(F.col("from_path"), F.lit(prefix + "%")))
    return own.select("repo_id", F.col("from_path").alias("src"), F.col("to_path").alias("dst")).distinct()


def orphans(files: DataFrame, graph: DataFrame, symbols: DataFrame, prefix: str | None = None, globs: list[str] = (), limit: int | None = 100) -> DataFrame:
    """Files that nothing imports and that are no entry points, with their symbols and exports; all of them without a limit."""
    own = files if prefix is None else files.where(F.col("file_path").startswith(prefix))
    own = own.where(~is_entry(F.col("file_path"), globs))
    free = own.join(graph.select("repo_id", F.col("dst").alias("file_path")).distinct(), ["repo_id", "file_path"], "left_anti")
    counts = symbols.groupBy("file_id").agg(F.count("*").alias("symbols"), F.count_if("exported").alias("exports"))
    counted = free.join(counts, "file_id", "left").select("repo_id", "file_path", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("exports", F.lit(0)).alias("exports"))
    return counted if limit is None else counted.orderBy("file_path").limit(limit)


def dead_code_summary(files: DataFrame, symbols: DataFrame, dead: DataFrame, orphaned: DataFrame, prefix: str | None = None) -> DataFrame:
    """Counts; the prefix narrows the files, not the symbols."""
    own = files if prefix is None else files.where(loose_like(F.col("file_path"), F.lit(prefix + "%")))
    one = own.agg(F.count("*").alias("files_analyzed")).crossJoin(symbols.where("exported").agg(F.count("*").alias("symbols_analyzed")))
    return one.crossJoin(dead.agg(F.count("*").alias("dead_exports"))).crossJoin(orphaned.agg(F.count("*").alias("orphaned_files")))


def cycles_by_search(graph: DataFrame, most_depth: int = 10) -> DataFrame:
    """Cycles that a depth-first search of each strongly connected component finds, from its least file and in the order of
    names: repo_id, cycle (closed), length.

    Components come first, by joins: no edge between them is on a cycle, and files on no cycle never reach a worker. A
    search in order is sequential, so each component is one group; files deeper than ``most_depth`` from its root are
    cut off. Every component of several files within that depth has a cycle in the result.
    """
    from fathom.operators.graphs import inner_edges, strong_components

    inner = inner_edges(graph.select("repo_id", "src", "dst").distinct(), strong_components(graph))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        for s, d in sorted(zip(part["src"], part["dst"], strict=True)):
            near.setdefault(s, []).append(d)
        done: set[str] = set()
        found: dict[tuple, list[str]] = {}
        for root in sorted(near):
            if root in done:
                continue
            path, place, todo = [root], {root: 0}, [iter(near[root])]
            done.add(root)
            while todo:
                following = next(todo[-1], None)
                if following is None:
                    todo.pop()
                    place.pop(path.pop())
                    continue
                if len(path) > most_depth:
                    continue
                if following in place:
                    cycle = path[place[following] :]
                    k = cycle.index(min(cycle))
                    cycle = cycle[k:] + cycle[:k]
                    found.setdefault(tuple(cycle), [*cycle, cycle[0]])
                elif following not in done and following in near:
                    done.add(following)
                    place[following] = len(path)
                    path.append(following)
                    todo.append(iter(near[following]))
        return pd.DataFrame({"repo_id": part["repo_id"].iloc[0], "cycle": list(found.values()), "length": [len(k) for k in found]})

    return inner.groupBy("repo_id", "component").applyInPandas(run, "repo_id long, cycle array<string>, length int")


def all_cycles(graph: DataFrame, most_length: int = 10) -> DataFrame:
    """All simple cycles up to a length: repo_id, cycle (closed), length. Paths grow from their least node only."""
    g = graph.select("repo_id", "src", "dst").distinct().checkpoint()
    paths = g.where(F.col("dst") >= F.col("src")).select("repo_id", F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    found = None
    for _ in range(most_length):
        closed = paths.where(F.col("last") == F.col("first")).select("repo_id", F.col("path").alias("cycle"), (F.size("path") - 1).alias("length"))
        found = closed if found is None else found.unionByName(closed)
        open_paths = paths.where(F.col("last") != F.col("first"))
        step = open_paths.join(g.select("repo_id", F.col("src").alias("last"), "dst"), ["repo_id", "last"])
        step = step.where((F.col("dst") == F.col("first")) | ((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst"))))
        paths = step.select("repo_id", "first", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path")).checkpoint()
        if paths.isEmpty():
            break
    return found.where(F.col("length") <= most_length)


def cycle_summary(cycles: DataFrame) -> DataFrame:
    files = cycles.select(F.explode("cycle").alias("f")).agg(F.countDistinct("f").alias("files"))
    return cycles.agg(F.count("*").alias("cycles"), F.coalesce(F.max("length"), F.lit(0)).alias("longest")).crossJoin(files)


def reverse_reach(graph: DataFrame, targets: DataFrame, most_degree: int = 3, cap: int | None = 50) -> DataFrame:
    """target, file, degree: files that import the targets (target) over at most ``most_degree`` steps, ``cap`` a degree."""
    from pyspark.sql import Window

    back = graph.select(F.col("dst").alias("at"), F.col("src").alias("file")).distinct().checkpoint()
    seen = targets.select("target", F.col("target").alias("file"), F.lit(0).alias("degree"))
    front = seen
    for degree in range(1, most_degree + 1):
        near = front.select("target", F.col("file").alias("at")).join(back, "at").select("target", "file").distinct()
        fresh = near.join(seen.select("target", "file"), ["target", "file"], "left_anti").withColumn("degree", F.lit(degree))
        if cap is not None:
            fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("target").orderBy("file"))).where(F.col("_n") <= cap).drop("_n")
        front = fresh.checkpoint()
        seen = seen.unionByName(front)
    return seen.where("degree > 0")


# Paths of routes and interfaces.
BOUNDARIES = r"(?:^|/)(?:routes?|router|api|endpoints|handlers|controllers)/[^/]*\.[a-z]+$"


def boundaries(targets: DataFrame, reach: DataFrame) -> DataFrame:
    """target of those whose own file or reach is a route or an interface, by the folder's name."""
    every = targets.select("target", F.col("target").alias("file")).unionByName(reach.select("target", "file"))
    return every.where(F.col("file").rlike(BOUNDARIES)).select("target").distinct()


def risk(targets: DataFrame, reach: DataFrame, covered: DataFrame, boundary: DataFrame) -> DataFrame:
    """target, points, risk, score (1 to 10) of each changed file: 10 points for the change, 5, 2 and 1 by degree of reach.

    30 % more where no test covers it (``covered`` lists targets), 50 % more across a service boundary (``boundary``
    likewise), 20 % less where tests alone are reached or changed.
    """
    point = F.when(F.col("degree") == 1, 5).when(F.col("degree") == 2, 2).when(F.col("degree") == 3, 1).otherwise(0)
    test = F.col("file").rlike(r"(?:test|spec)")
    sums = reach.groupBy("target").agg(F.sum(point).alias("more"), F.bool_and(test).alias("tests"))
    flag = lambda df, name: df.select("target", F.lit(True).alias(name)).distinct()
    flags = targets.select("target").distinct().join(sums, "target", "left").join(flag(covered, "covered"), "target", "left").join(flag(boundary, "edge"), "target", "left")
    only = F.coalesce("tests", F.lit(True)) & F.col("target").rlike(r"(?:test|spec)")
    tenths = 10 + F.when(F.col("covered").isNull(), 3).otherwise(0) + F.when(F.col("edge").isNotNull(), 5).otherwise(0) - F.when(only, 2).otherwise(0)
    points = (10 + F.coalesce("more", F.lit(0))) * tenths / 10.0
    scored = flags.select("target", points.alias("points"))
    p = F.col("points")
    level = F.when(p < 20, "low").when(p < 50, "medium").when(p <= 100, "high").otherwise("critical")
    place = F.when(p < 20, F.least(F.lit(3), 1 + F.floor(p * 3 / 20))).when(p < 50, F.least(F.lit(6), 4 + F.floor((p - 20) * 3 / 30))).when(p <= 100, F.least(F.lit(9), 7 + F.floor((p - 50) * 3 / 50))).otherwise(10)
    return scored.select("target", "points", level.alias("risk"), place.cast("int").alias("score"))
