"""The tools as methods of one object over a table store: each builds a DataFrame, writers store a new snapshot."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.scalar import cosine, error_signature, normalize_error
from fathom.operators import codeindex, hooks, imports, memory, repos, rules
from fathom.sources import config, doctor, parsers, scan, schemas
from fathom.sources.store import Store


class Engine:
    """``embed`` turns a text into a vector; without it, calls must bring vectors. ``clock`` gives the time of writes."""

    def __init__(self, spark: SparkSession, root: str, embed=None, clock=datetime.now, dimension: int = 384):
        self.spark, self.store, self.embed, self.clock, self.dimension = spark, Store(spark, root), embed, clock, dimension

    def _vector(self, text: str | None, vector) -> list[float]:
        out = list(vector) if vector is not None else list(self.embed(text)) if self.embed else None
        if out is None or len(out) != self.dimension:
            raise ValueError(f"a vector of {self.dimension} numbers is needed")
        return out

    def _check(self, **values) -> None:
        found = config.problems(values, schemas.ENUMS)
        if found:
            raise ValueError(found)

    def _solutions(self) -> DataFrame:
        return self.store.read("solutions")

    def recall(self, text: str | None = None, vector=None, repo_id=None, limit: int = 5, least: float = 0.3, scope=None, category=None, most_complexity=None) -> DataFrame:
        self._check(limit=limit, least=least, scope=scope, category=category, complexity=most_complexity)
        repos = self.store.read("repos").where("fingerprint_embedding IS NOT NULL").select(F.col("id").alias("repo_id"), F.col("fingerprint_embedding").alias("vector"))
        return memory.recall(self._solutions().withColumnRenamed("problem_embedding", "embedding"), repos, self._vector(text, vector), repo_id, limit, least, 0.7, scope, category, most_complexity)

    def recall_with_hints(self, text: str | None = None, vector=None, repo_id=None, **options) -> dict[str, DataFrame]:
        """A recall with the two most related failures and at most three hints on the best match."""
        found = self.recall(text, vector, repo_id, **options)
        failures = self.search_failures(text, vector, 2)
        details = self._solutions().select("id", "anti_patterns", "prerequisites", "complexity")
        best = found.withColumn("rank_key", F.col("similarity") * F.col("score")).orderBy(F.col("rank_key").desc(), "id").limit(1).join(details, "id", "left")
        one = self.spark.range(1).select(F.lit(True).alias("_one")).join(best, F.lit(True), "left")
        return {"solutions": found, "failures": failures, "hints": memory.hints(one, F.lit(not failures.isEmpty()))}

    def record_use(self, matches: DataFrame) -> None:
        delta = memory.usage_delta(matches, F.lit(self.clock()))
        self.store.change("solutions", ["id"], memory.apply_usage(self._solutions().join(delta.select("id"), "id", "left_semi"), delta))

    def remember(self, solution_id: str, problem: str, solution: str, scope: str, vector=None, threshold: float = 0.9, **fields) -> dict:
        """Stores a solution unless one is already as near as ``threshold``; the nearest is named then."""
        self._check(scope=scope, category=fields.get("category"), complexity=fields.get("complexity"))
        query = self._vector(problem, vector)
        old = self._solutions()
        near = memory.search(old, query, 1, threshold, vector="problem_embedding").first()
        if near:
            return {"status": "duplicate", "id": near["id"], "similarity": near["similarity"]}
        if fields.get("supersedes") is not None and old.where(F.col("id") == fields["supersedes"]).isEmpty():
            raise ValueError("what it supersedes does not exist")
        row = {"id": solution_id, "problem": problem, "problem_embedding": query, "solution": solution, "scope": scope, "created_at": self.clock()} | fields
        types = {f.name: f.dataType for f in schemas.schema("solutions")}
        from pyspark.sql.types import StructField, StructType

        new = self.spark.createDataFrame([row], StructType([StructField(k, types[k]) for k in row]))
        self.store.append("solutions", schemas.conform(new, "solutions"))
        return {"status": "stored", "id": solution_id}

    def reward(self, solution_id: str, outcome: str, notes: str | None = None) -> None:
        from fathom.functions.scalar import reward

        self._check(outcome=outcome)
        old = self._solutions()
        if old.where(F.col("id") == solution_id).isEmpty():
            raise ValueError("no such solution")
        hit = F.col("id") == solution_id
        counter = {"success": "successes", "partial": "partial_successes", "failure": "failures"}[outcome]
        new = old.withColumn("score", F.when(hit, reward(F.col("score"), F.lit(outcome))).otherwise(F.col("score"))).withColumn(counter, F.when(hit, F.col(counter) + 1).otherwise(F.col(counter)))
        self.store.change("solutions", ["id"], new.where(hit))
        log = self.spark.createDataFrame([(solution_id, outcome, notes, self.clock())], "solution_id string, outcome string, notes string, created_at timestamp")
        self.store.append("usage_log", schemas.conform(log, "usage_log"))

    def get_solution(self, solution_id: str) -> DataFrame:
        return memory.get_solution(self._solutions(), solution_id)

    def failure(self, kind: str, message: str, root_cause: str | None = None, fix: str | None = None, vector=None, failure_id: str | None = None) -> dict:
        self._check(error_type=kind)
        now = self.clock()
        one = self.spark.createDataFrame([(kind, message)], "error_type string, error_message string").select("error_type", "error_message", error_signature(F.col("error_type"), normalize_error(F.col("error_message"))).alias("s")).first()
        old, hit = self.store.read("failures"), F.col("error_signature") == one["s"]
        if not old.where(hit).isEmpty():
            given = {"root_cause": root_cause, "fix_applied": fix}
            new = old.withColumn("occurrences", F.when(hit, F.col("occurrences") + 1).otherwise(F.col("occurrences")))
            for c, v in given.items():
                new = new.withColumn(c, F.when(hit, F.coalesce(F.lit(v), F.col(c))).otherwise(F.col(c)))
            if fix:
                new = new.withColumn("resolved_at", F.when(hit, F.lit(now)).otherwise(F.col("resolved_at")))
            self.store.change("failures", ["id"], new.where(hit))
            return {"status": "updated", "signature": one["s"]}
        row = self.spark.createDataFrame([(failure_id or "fail_" + one["s"][:8], kind, message, one["s"], self._vector(message, vector), root_cause, fix, now)], "id string, error_type string, error_message string, error_signature string, error_embedding array<float>, root_cause string, fix_applied string, created_at timestamp")
        self.store.append("failures", schemas.conform(row, "failures"))
        return {"status": "stored", "signature": one["s"]}

    def search_failures(self, text: str | None = None, vector=None, limit: int = 3) -> DataFrame:
        return memory.search_failures(self.store.read("failures").withColumnRenamed("error_embedding", "embedding"), self._vector(text, vector), limit)

    def status(self) -> DataFrame:
        return memory.table_counts({n: self.store.read(n) for n in ("solutions", "failures", "repos")})

    def status_report(self, repo_id=None) -> dict[str, DataFrame]:
        """Counts, schema version, the tags used most, the latest solutions, and what is known of the repository."""
        solutions = self._solutions()
        own = self.store.read("repos")
        return {
            "counts": self.status(), "version": schemas.version_of(self.store.read("schema_version")), "tags": memory.top_tags(solutions),
            "recent": memory.recent(solutions.select("id", "problem", "scope", "score", "created_at"), "created_at"),
            "repo": (own if repo_id is None else own.where(F.col("id") == repo_id)).select("name", "languages", "frameworks", "patterns"),
        }

    def session_start(self, listing: DataFrame, version: str) -> DataFrame:
        """Notes the version, and gives root, repo_id and indexable of each project folder (root, name)."""
        new = self.spark.createDataFrame([("install_source", "plugin"), ("version", version)], "key string, value string")
        self.store.write("plugin_meta", repos.upsert_meta(self.store.read("plugin_meta"), new, F.lit(self.clock())))
        return hooks.session_start(listing)

    def put_repos(self, detected: DataFrame) -> None:
        self.store.write("repos", repos.upsert_repos(self.store.read("repos"), detected, F.lit(self.clock())))

    def clear_repo(self, repo_id: str) -> None:
        """Forgets files, symbols and imports of a repository."""
        own = self.store.read("repo_files").where(F.col("repo_id").eqNullSafe(F.lit(repo_id)))
        for name in ("symbols", "imports"):
            if self.store.current(name):
                self.store.change(name, ["file_id"], gone=own.select(F.col("id").alias("file_id")))
        if self.store.current("repo_files"):
            self.store.change("repo_files", ["repo_id"], gone=self.spark.createDataFrame([(repo_id,)], "repo_id string"))

    def warn_check(self, kind: str, target: str, repo_id=None) -> DataFrame:
        self._check(type=kind)
        probe = self.spark.createDataFrame([(target, repo_id)], "probe string, repo_id string")
        return rules.check_warnings(probe, self.store.read("warnings"), kind)

    def warn_add(self, warning_id: str, kind: str, target: str, reason: str, severity: str = "warn", ecosystem=None, repo_id=None) -> None:
        self._check(type=kind, severity=severity, ecosystem=ecosystem)
        row = self.spark.createDataFrame([(warning_id, kind, target, ecosystem, repo_id, severity, reason, self.clock())], schemas.schema("warnings"))
        known = self.store.read("warnings")
        for column, value in (("type", kind), ("target", target), ("ecosystem", ecosystem), ("repo_id", repo_id)):
            known = known.where(F.col(column).eqNullSafe(F.lit(value)))
        self.store.change("warnings", ["id"], rules.merge_warnings(known, row))

    def warn_remove(self, warning_id: str) -> None:
        if self.store.current("warnings"):
            self.store.change("warnings", ["id"], gone=self.spark.createDataFrame([(warning_id,)], "id string"))

    def warn_list(self, kind=None, repo_id=None) -> DataFrame:
        return rules.list_warnings(self.store.read("warnings"), kind, repo_id)

    def doctor(self, settings: dict | None = None, fix: bool = False, listing: list[str] | None = None, skills: list[str] | None = None) -> dict:
        """Twelve checks of store and configuration; with ``fix``, what can be mended is, and the checks are made again."""
        settings = config.DEFAULTS if settings is None else settings
        found = doctor.checks(self.store, settings, listing, skills)
        if fix:
            _, settings = doctor.fixed(self.store, settings, found, self.clock)
            found = doctor.checks(self.store, settings, listing, skills)
        return {"healthy": doctor.healthy(found), "checks": found, "config": settings}

    def diagnose(self) -> DataFrame:
        """Columns and orphaned keys of every table."""
        return schemas.diagnose({n: self.store.read(n) for n in schemas.TABLES if self.store.current(n)})

    # the code index

    def _files(self) -> DataFrame:
        return self.store.read("repo_files").select(F.col("id").alias("file_id"), "repo_id", "file_path")

    def _symbols(self) -> DataFrame:
        return self.store.read("symbols").withColumnRenamed("id", "symbol_id")

    def _imports(self) -> DataFrame:
        return self.store.read("imports").withColumnRenamed("id", "import_id")

    def reindex(self, root: str, repo_id: str, full: bool = False, **options) -> dict:
        """Scans, compares by time and hash, parses what changed, and replaces the rows of those files."""
        seen = scan.scan_files(self.spark, root, **options).cache()
        old = self.store.read("repo_files")
        own = old.where(F.col("repo_id") == repo_id)
        changes = codeindex.diff(seen, own).cache()
        counts = {r["status"]: r["n"] for r in codeindex.diff_summary(changes).collect()}
        if not full and not set(counts) & {"added", "modified", "deleted"}:
            return counts
        fresh = changes.where(F.col("status").isin(*(["added", "modified"] + ["unchanged"] * full))).select("file_path")
        gone = changes.where(F.col("status").isin(*(["modified", "deleted"] + ["unchanged"] * full))).join(own.select("file_path", F.col("id").alias("file_id")), "file_path")
        parsed = parsers.parse_files(seen.join(fresh, "file_path", "left_semi")).cache()
        key = F.xxhash64(F.lit(repo_id), "file_path")
        files = seen.join(fresh, "file_path", "left_semi").select(key.alias("id"), F.lit(repo_id).alias("repo_id"), "file_path", "mtime", "hash", F.lit(self.clock()).alias("indexed_at"))
        symbols = parsers.symbol_rows(parsed).select(F.xxhash64(F.lit(repo_id), "file_path", "line", "column", "name").alias("id"), F.lit(repo_id).alias("repo_id"), key.alias("file_id"), "name", "kind", "line", "column", "exported", "scope")
        found = parsers.import_rows(parsed).select(F.xxhash64(F.lit(repo_id), "file_path", "line", "imported_name", "local_name").alias("id"), key.alias("file_id"), "imported_name", "local_name", "source_path", "is_default", "is_namespace", "is_type", "line")
        for name, by, new in (("symbols", "file_id", symbols), ("imports", "file_id", found), ("repo_files", "id", files)):
            self.store.change(name, [by], schemas.conform(new, name), gone.select(F.col("file_id").alias(by)))
        for df in (seen, changes, parsed):
            df.unpersist()
        return counts

    def index_status(self) -> DataFrame:
        return codeindex.index_status(self.store.read("repo_files"), self._symbols(), self._imports())

    def find_definition(self, name: str, kind=None, file_path=None, repo_id=None) -> DataFrame:
        return codeindex.find_definitions(self._symbols().drop("repo_id"), self._files(), name, kind, file_path, repo_id)

    def list_exports(self, prefix=None, repo_id=None) -> DataFrame:
        return codeindex.list_exports(self._symbols().drop("repo_id"), self._files(), prefix, repo_id)

    def search_symbols(self, text: str, limit: int = 20, kind=None, repo_id=None) -> DataFrame:
        self._check(limit=limit)
        return codeindex.search_symbols(self._symbols().drop("repo_id"), self._files(), text, limit, kind, repo_id)

    def get_imports(self, file_path: str, repo_id=None) -> DataFrame:
        return codeindex.file_imports(self._imports(), self._files(), file_path, repo_id)

    def find_callers(self, name: str, file_path: str | None = None) -> DataFrame:
        """Callers of the name's first definition, or of the given file's symbol if there is none."""
        own = codeindex.top_definition(self._symbols().drop("repo_id").where(F.col("name") == name), self._files())
        if own.isEmpty() and file_path is not None:
            own = self.spark.createDataFrame([(0, name, file_path)], "def_id long, name string, def_path string")
        return codeindex.callers(own, self._imports(), self._files())

    def _graph(self, prefix=None, aliases=()) -> DataFrame:
        return imports.edges(self._imports(), self._files(), prefix, aliases)

    def find_dead_code(self, category: str = "all", prefix=None, entry_points=(), limit: int = 100, aliases=()) -> dict[str, DataFrame]:
        if category not in ("dead_exports", "orphaned_files", "all"):
            raise ValueError("no such category")
        out = {}
        if category != "orphaned_files":
            rows = self._symbols().drop("repo_id")
            files = self._files() if prefix is None else self._files().where(F.col("file_path").startswith(prefix))
            entry = imports.is_entry(F.col("file_path"), entry_points)
            out["dead_exports"] = codeindex.dead_exports(rows.join(files.select("file_id"), "file_id", "left_semi"), self._imports(), self._files(), entry, limit)
        if category != "dead_exports":
            out["orphaned_files"] = imports.orphans(self._files(), self._graph(prefix, aliases), self._symbols(), prefix, entry_points, limit)
        return out

    def dead_code_summary(self, prefix=None, entry_points=(), aliases=()) -> DataFrame:
        """Counts of files and symbols looked at, of dead exports and of orphans, without a limit."""
        found = self.find_dead_code("all", prefix, entry_points, 1 << 30, aliases)
        return imports.dead_code_summary(self._files(), self._symbols(), found["dead_exports"], found["orphaned_files"], prefix)

    def find_circular_deps(self, prefix=None, most_depth: int = 10) -> DataFrame:
        self._check(most_depth=most_depth)
        graph = self._graph(prefix).withColumn("repo_id", F.xxhash64("repo_id"))
        return imports.cycles_by_search(graph, most_depth)

    def circular_summary(self, prefix=None, most_depth: int = 10) -> DataFrame:
        """How many cycles and files in them, and the longest."""
        return imports.cycle_summary(self.find_circular_deps(prefix, most_depth))


def similar(a, b):
    """Cosine of two vector columns."""
    return cosine(a, b)
