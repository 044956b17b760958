"""Rules, warnings, package audits, caches and run-once ledgers."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.scalar import ascii_fold, glob_to_like, loose_like


def usable_rules(spark: SparkSession, rules: list[dict]) -> list[dict]:
    """Rules whose pattern compiles where it will run, in the JVM, by falling priority, in their order among equals."""
    compiler = spark.sparkContext._jvm.java.util.regex.Pattern
    good = []
    for r in rules:
        try:
            compiler.compile("(?i)" + r["pattern"])
        except (IllegalArgumentException, Py4JJavaError):
            continue
        good.append(r)
    return sorted(good, key=lambda r: -(r.get("priority") or 0))


def evaluate_rules(subjects: DataFrame, rules: list[dict], event: str, subject: str = "subject", id_column: str = "id", keep: bool = False) -> DataFrame:
    """id, matched (rule names in order), blocked, block_message (of the last blocking match) for each subject; with ``keep``,
    behind all columns of ``subjects``.

    ``rules`` (name, event, pattern, action, message, priority, enabled) is a configuration list, so each rule is an
    expression of one pass and nothing is joined.
    """
    chosen = [r for r in usable_rules(subjects.sparkSession, rules) if r.get("enabled", True) and r["event"] == event]
    hits = [F.col(subject).rlike("(?i)" + r["pattern"]) for r in chosen]
    names = F.array_compact(F.array(*[F.when(h, F.lit(r["name"])) for h, r in zip(hits, chosen, strict=True)])) if chosen else F.array().cast("array<string>")
    message: Column = F.lit(None).cast("string")
    blocked: Column = F.lit(False)
    for h, r in zip(hits, chosen, strict=True):
        if r["action"] == "block":
            message = F.when(h, F.lit(r.get("message"))).otherwise(message)
            blocked = blocked | F.coalesce(h, F.lit(False))
    first = subjects.columns if keep else [F.col(id_column)]
    return subjects.select(*first, names.alias("matched"), blocked.alias("blocked"), message.alias("block_message"))


def edit_subject(path: Column, content: Column) -> Column:
    return F.concat_ws("\n", path, content)


SALTS = 64  # ways that targets of wildcards alone are dealt, as they meet every probe


def _runs(text: Column) -> Column:
    """The runs of one, two and three letters of a text, and the empty one."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda k: F.substring(text, k, F.lit(n)))
    return F.concat(of(1), of(2), of(3), F.array(F.lit("")))


def check_warnings(probes: DataFrame, warnings: DataFrame, kind: str = "file", by_severity_rank: bool = False) -> DataFrame:
    """Warnings that meet each probe (probe, repo_id), first those of its repo, then by severity.

    ``warnings``: id, type, target, ecosystem, repo_id, severity, reason. File targets are globs in which ``*`` crosses
    ``/``; package targets are equal names. The severity orders as text unless ``by_severity_rank``.
    """
    own = warnings.where(F.col("type") == kind).withColumnRenamed("repo_id", "w_repo")
    visible = F.col("w_repo").isNull() | (F.col("w_repo") == F.col("repo_id"))
    if kind == "file":  # a target meets probes that hold the first letters, three at most, of its longest part without wildcards
        part = F.array_sort(F.split(ascii_fold(F.col("target")), r"[*?%_]"), lambda a, b: F.length(b) - F.length(a))
        low = ascii_fold(F.col("probe"))
        keyed = probes.withColumn("_gram", F.explode(F.array_distinct(_runs(low))))
        keyed = keyed.withColumn("_salt", F.when(F.col("_gram") == "", F.pmod(F.xxhash64("probe"), F.lit(SALTS))).otherwise(0).cast("int"))
        own = own.withColumn("_gram", F.substring(F.get(part, F.lit(0)), 1, 3))
        own = own.withColumn("_salt", F.explode(F.when(F.col("_gram") == "", F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        met = keyed.join(own, ["_gram", "_salt"]).where(visible & loose_like(F.col("probe"), glob_to_like(F.col("target"))))
    else:
        met = probes.join(own, F.col("probe") == F.col("target")).where(visible)
    severity = F.when(F.col("severity") == "block", 3).when(F.col("severity") == "warn", 2).otherwise(1).desc() if by_severity_rank else F.col("severity").desc()
    order = Window.partitionBy("probe").orderBy(F.col("w_repo").isNull(), F.col("ecosystem").isNull(), severity, "id") if kind == "package" else Window.partitionBy("probe").orderBy(F.col("w_repo").isNull(), severity, "id")
    return met.select("probe", "id", "severity", "target", F.row_number().over(order).alias("place"))


def list_warnings(warnings: DataFrame, kind: str | None = None, repo_id=None) -> DataFrame:
    rows = warnings if kind is None else warnings.where(F.col("type") == kind)
    rows = rows if repo_id is None else rows.where((F.col("repo_id") == repo_id) | F.col("repo_id").isNull())
    return rows.orderBy(F.col("created_at").desc(), "id")


def merge_warnings(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Adds or updates by (type, target, ecosystem, repo_id), where nulls are equal; the stored id stays."""
    keys = ["type", "target", "ecosystem", "repo_id"]
    s, n = stored.alias("s"), new.alias("n")
    match = None
    for k in keys:
        c = F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}"))
        match = c if match is None else match & c
    both = s.join(n, match, "full_outer")
    known, given = F.col("s.id").isNotNull(), F.col("n.id").isNotNull()
    cols = [F.when(known, F.col(f"s.{c}")).otherwise(F.col(f"n.{c}")).alias(c) if c in [*keys, "id", "created_at"] else F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in stored.columns]
    return both.select(*cols)


def remove_warnings(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("id"), "id", "left_anti")


def audit_packages(packages: DataFrame, warnings: DataFrame, advisories: DataFrame) -> DataFrame:
    """package, ecosystem, warnings, advisories (counts), worst, ask of each package: advisories come from a table."""
    own = warnings.where(F.col("type") == "package").groupBy("target").agg(F.count("*").alias("n_warnings"), F.bool_or(F.col("severity") == "block").alias("blocks"))
    known = advisories.groupBy("package", "ecosystem").agg(F.count("*").alias("n_advisories"), F.bool_or(F.col("level") == "critical").alias("critical"))
    joined = packages.join(own, packages.package == own.target, "left").join(known, ["package", "ecosystem"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return joined.select("package", "ecosystem", F.coalesce("n_warnings", F.lit(0)).cast("long").alias("n_warnings"), F.coalesce("n_advisories", F.lit(0)).cast("long").alias("n_advisories"), (yes("blocks") | yes("critical")).alias("ask"))


def package_issues(packages: DataFrame, warnings: DataFrame, advisories: DataFrame, facts: DataFrame, most_bytes: int = 500_000, deprecations: bool = True) -> DataFrame:
    """package, ecosystem, type, severity, detail: a row for each thing that speaks against installing a package.

    ``packages`` has package, ecosystem; ``advisories`` also level; ``facts`` (of npm packages alone) package, deprecated (a
    text or null), size and gzip in bytes. Types: cve (critical ones, and the others, as one row each, with their number),
    warning (the warning's own severity, a block as critical), deprecated (the first 100 letters of its text) and size.
    """
    own = packages.select("package", "ecosystem").distinct()
    row = lambda kind, severity, detail: ["package", "ecosystem", F.lit(kind).alias("type"), severity.alias("severity"), detail.alias("detail")]
    critical = F.lower("level") == "critical"
    counted = own.join(advisories.groupBy("package", "ecosystem", critical.alias("critical")).agg(F.count("*").alias("n")), ["package", "ecosystem"])
    found = counted.select(*row("cve", F.when(F.col("critical"), "critical").otherwise("warn"), F.concat(F.col("n").cast("string"), F.when(F.col("critical"), " critical").otherwise(" of lower levels"))))
    local = warnings.where(F.col("type") == "package").select(F.col("target").alias("package"), F.col("ecosystem").alias("of"), F.col("severity").alias("level"), F.col("reason"))
    warned = own.join(local, "package").where(F.col("of").isNull() | (F.col("of") == F.col("ecosystem")))
    found = found.unionByName(warned.select(*row("warning", F.when(F.col("level") == "block", "critical").otherwise(F.col("level")), F.col("reason"))))
    known = own.where("ecosystem = 'npm'").join(facts, "package")
    if deprecations:
        found = found.unionByName(known.where(F.length("deprecated") > 0).select(*row("deprecated", F.lit("warn"), F.substring("deprecated", 1, 100))))
    kilobytes = lambda c: F.concat(F.floor(F.col(c) / 1024 + 0.5).cast("string"), F.lit(" KB"))
    return found.unionByName(known.where(F.col("size") > most_bytes).select(*row("size", F.lit("info"), F.concat(kilobytes("size"), F.lit(", gzip "), kilobytes("gzip")))))


def cache_get(cache: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """The latest entry of each key that is younger than the time to live."""
    return cache_latest(cache).where(F.col("created_at") > as_of - F.make_interval(hours=F.lit(hours)))


def cache_purge(cache: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """What stays after a purge; an entry exactly as old as the limit stays, though ``cache_get`` no longer sees it."""
    return cache.where(F.col("created_at") >= as_of - F.make_interval(hours=F.lit(hours)))


def cache_latest(cache: DataFrame) -> DataFrame:
    return cache.groupBy("cache_key").agg(F.max_by("response", F.struct("created_at", "seq")).alias("response"), F.max("created_at").alias("created_at"))


def ledger_mark(runs: DataFrame) -> DataFrame:
    """First run of each (hook_name, session_id)."""
    return runs.groupBy("hook_name", "session_id").agg(F.min("executed_at").alias("executed_at"))


def ledger_purge(ledger: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return ledger.where(F.col("executed_at") >= as_of - F.make_interval(days=F.lit(days)))


def ledger_clear(ledger: DataFrame, hook_name: str, session_id=None) -> DataFrame:
    gone = F.col("hook_name") == hook_name
    return ledger.where(~(gone if session_id is None else gone & (F.col("session_id") == session_id)))
