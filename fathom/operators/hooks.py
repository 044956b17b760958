"""The checks that run at events of a session, each as one plan over a table of events: what is allowed, asked or denied.

Every check takes events with an id and gives id, decision (deny, ask, allow, or null for no opinion) and reason. Rules of
the user come first and deny; what follows depends on the event. Rules and categories are configuration and become
expressions of one pass; warnings and advisories are tables and are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import prompts as P
from fathom.operators import rules as R
from fathom.sources.scan import session_indexable

# The tool categories that need no permission.
TOOLS = {
    "core": ["Read", "Glob", "Grep"],
    "web": ["WebFetch", "WebSearch"],
    "memory": ["recall", "status", "reward", "find_definition", "find_callers", "search_symbols", "list_exports", "get_imports", "index_status", "reindex", "doctor"],
    "docs": ["resolve-library-id", "query-docs"],
}


def _ruled(events: DataFrame, rules: list[dict], event: str, subject: Column) -> DataFrame:
    """``events`` with blocked and block_message."""
    found = R.evaluate_rules(events.withColumn("_subject", subject), rules, event, "_subject", keep=True)
    return found.drop("_subject", "matched")


def _repo(events: DataFrame) -> DataFrame:
    return events if "repo_id" in events.columns else events.withColumn("repo_id", F.lit(None).cast("string"))


def permission_request(requests: DataFrame, enabled: list[str] = ("core", "memory"), never: list[str] = (), extra: list[str] = (), read_only: bool = True, tools: dict[str, list[str]] | None = None) -> DataFrame:
    """``requests`` (id, tool): allow, or null where the user is to be asked."""
    approved = P.auto_approved(F.col("tool"), tools or TOOLS, list(enabled), never, extra, read_only)
    return requests.select("id", F.when(approved, "allow").alias("decision"), F.lit(None).cast("string").alias("reason"))


def pre_bash(commands: DataFrame, rules: list[dict], warnings: DataFrame, advisories: DataFrame, suggest_review: bool = True) -> DataFrame:
    """``commands`` (id, command, repo_id): denied by a rule; a commit only gets a review suggested; an installation is asked
    about where a package has a critical or high advisory (package, ecosystem, level) or a blocking warning.
    """
    ruled = _ruled(_repo(commands), rules, "bash", F.col("command"))
    system = P.commit_system(F.col("command")) if suggest_review else F.lit(None).cast("string")
    rows = ruled.select("id", "repo_id", "blocked", "block_message", system.alias("vcs"), P.command_packages(F.col("command")).alias("p"))
    open_rows = rows.where(~F.col("blocked") & F.col("vcs").isNull()).select("id", "repo_id", "p.ecosystem", F.posexplode("p.packages").alias("place", "package"))
    serious = advisories.where(F.upper("level").isin("CRITICAL", "HIGH")).groupBy("package", "ecosystem").agg(F.count("*").alias("n"))
    known = open_rows.join(serious, ["package", "ecosystem"]).select("id", "place", F.lit(0).alias("kind"), F.concat(F.lit("[CVE] "), F.col("n").cast("string"), F.lit(" critical/high CVE(s) found")).alias("issue"))
    own = warnings.where((F.col("type") == "package") & (F.col("severity") == "block")).select(F.col("target").alias("package"), F.col("ecosystem").alias("w_ecosystem"), F.col("repo_id").alias("w_repo"), F.col("reason").alias("why"))
    visible = (F.col("w_repo").isNull() | (F.col("w_repo") == F.col("repo_id"))) & (F.col("w_ecosystem").isNull() | (F.col("w_ecosystem") == F.col("ecosystem")))
    warned = open_rows.join(own, "package").where(visible).select("id", "place", F.lit(1).alias("kind"), F.concat(F.lit("[WARNING] "), F.col("why")).alias("issue"))
    issues = known.unionByName(warned).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "kind", "issue"))), lambda x: x["issue"]), "; ").alias("issues"))
    review = F.concat(F.when(F.col("vcs") == "jj", F.lit("Jujutsu")).otherwise(F.initcap("vcs")), F.lit(" commit: review first"))
    return rows.join(issues, "id", "left").select(
        "id", F.when(F.col("blocked"), "deny").when(F.col("issues").isNotNull(), "ask").alias("decision"),
        F.when(F.col("blocked"), F.col("block_message")).when(F.col("vcs").isNotNull(), review).otherwise(F.col("issues")).alias("reason"),
    )


def _file_warnings(events: DataFrame, warnings: DataFrame, path: str) -> DataFrame:
    """id, n, blocking (reasons of blocking warnings, in order) of the events whose file is warned of."""
    probes = events.select(F.col(path).alias("probe"), "repo_id").distinct()
    met = R.check_warnings(probes.select("probe", "repo_id"), warnings).join(warnings.select("id", F.col("reason").alias("why"), F.col("repo_id").alias("w_repo")), "id")
    hits = events.select(F.col("id").alias("event"), F.col(path).alias("probe"), "repo_id").join(met.withColumnRenamed("id", "warning"), "probe").where(F.col("w_repo").isNull() | (F.col("w_repo") == F.col("repo_id")))
    blocking = F.array_sort(F.collect_set(F.when(F.col("severity") == "block", F.struct("place", "why"))))
    return hits.groupBy(F.col("event").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.transform(blocking, lambda x: x["why"]), "; ").alias("blocking"))


def pre_read(reads: DataFrame, rules: list[dict], warnings: DataFrame, behavior: str = "ask", allowed: list[str] = (), custom: list[str] = (), off: list[str] = ()) -> DataFrame:
    """``reads`` (id, path, repo_id): denied by a rule; a sensitive path or one warned of is denied, asked about or let pass,
    by ``behavior`` (block, ask, warn, disabled)."""
    if behavior not in ("block", "ask", "warn", "disabled"):
        raise ValueError("no such behavior")
    ruled = _ruled(_repo(reads), rules, "read", F.col("path")).withColumn("category", P.sensitive_category(F.col("path"), allowed, custom, off))
    found = ruled.join(_file_warnings(ruled, warnings, "path"), "id", "left")
    hit = (F.col("category").isNotNull() | (F.col("n") > 0)) if behavior != "disabled" else F.lit(False)
    what = {"block": "deny", "ask": "ask"}.get(behavior)
    return found.select(
        "id", F.when(F.col("blocked"), "deny").when(hit, F.lit(what)).alias("decision"),
        F.when(F.col("blocked"), F.col("block_message")).when(hit & F.lit(what is not None), F.coalesce("category", F.lit("warning"))).alias("reason"),
    )


def pre_edit(edits: DataFrame, rules: list[dict], warnings: DataFrame) -> DataFrame:
    """``edits`` (id, path, content, repo_id): denied by a rule on path and content; asked about where a blocking warning meets the path."""
    ruled = _ruled(_repo(edits), rules, "edit", R.edit_subject(F.col("path"), F.coalesce("content", F.lit(""))))
    found = ruled.join(_file_warnings(ruled, warnings, "path"), "id", "left")
    return found.select(
        "id", F.when(F.col("blocked"), "deny").when(F.col("blocking") != "", "ask").alias("decision"),
        F.when(F.col("blocked"), F.col("block_message")).when(F.col("blocking") != "", F.col("blocking")).alias("reason"),
    )


def pre_web(searches: DataFrame) -> DataFrame:
    """``searches`` (id, query, url): a search for the documentation of known libraries is denied in favour of a documentation
    tool; the reason names libraries and topic."""
    text = F.coalesce(F.when(F.col("query") != "", F.col("query")), F.col("url"), F.lit(""))
    rows = searches.select("id", text.alias("t")).select("id", "t", P.libraries_in(F.col("t")).alias("libraries"))
    hit = (F.size("libraries") > 0) & P.is_doc_query(F.col("t"))
    return rows.select("id", F.when(hit, "deny").alias("decision"), F.when(hit, F.concat(F.array_join("libraries", ", "), F.lit(": "), P.topic_of(F.col("t"), F.col("libraries")))).alias("reason"))


def repo_id_of(root: Column) -> Column:
    return F.concat(F.lit("repo_"), F.substring(F.sha2(root.cast("binary"), 256), 1, 8))


def session_start(listing: DataFrame) -> DataFrame:
    """root, repo_id, indexable of each project folder, from its files (root, name)."""
    return session_indexable(listing).select("root", repo_id_of(F.col("root").cast("string")).alias("repo_id"), "indexable")
