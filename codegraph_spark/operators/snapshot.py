"""Snapshots of a project: tables of its functions, types, dependencies and hotspots, what changed between two, and
the summary and manifest made of them.

Frames stay frames; only documents, which are meant to be read by people and agents, become one row of JSON.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.names import MANIFEST_LANGUAGES, is_test_file, language
from . import conventions, rollup
from .graph import cross_file


def _names(df: DataFrame, column: str) -> Column:
    """The names in an array of structs or of names."""
    kind = df.schema[column].dataType
    inside = isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType)
    return F.coalesce(F.transform(column, lambda x: x["name"]) if inside else F.col(column), F.array().cast("array<string>"))


def function_info(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, file, name, line, visibility, params, return_type, complexity, is_async, calls, called_by): lists joined
    by commas, names in full."""
    own = nodes.where("node_kind = 'function' AND complexity IS NOT NULL")
    shown = "return_type_display" if "return_type_display" in nodes.columns else "return_type_debug"
    found = own.join(rollup.callees(nodes, edges), "node_id", "left").join(rollup.callers(nodes, edges), "node_id", "left")
    lists = [F.coalesce(c, F.lit("")).alias(c) for c in ("calls", "called_by")]
    return found.select("node_id", "file", "name", F.col("start_line").alias("line"), "visibility", F.array_join(_names(nodes, "params"), ", ").alias("params"), F.col(shown).alias("return_type"), "complexity", "is_async", *lists)


def type_info(nodes: DataFrame) -> DataFrame:
    """(node_id, file, name, kind, line, fields, visibility)."""
    own = nodes.where("node_kind = 'type'")
    return own.select("node_id", "file", "name", F.col("data_kind").alias("kind"), F.col("start_line").alias("line"), F.array_join(_names(nodes, "fields"), ", ").alias("fields"), "visibility")


def signature() -> Column:
    """What a function looks like in a list of changes."""
    return F.concat("name", F.lit("("), "params", F.lit(") → "), F.coalesce("return_type", F.lit("void")))


def short_signature() -> Column:
    """What a function looks like in a summary."""
    return F.concat(F.when(F.col("is_async"), "async ").otherwise(""), "name", F.lit("("), "params", F.lit(") -> "), F.coalesce("return_type", F.lit("void")))


def short_type() -> Column:
    return F.when(F.col("fields") == "", F.col("name")).otherwise(F.concat("name", F.lit(" { "), "fields", F.lit(" }")))


@dataclass(frozen=True)
class Snapshot:
    """Tables of one state of a project."""

    functions: DataFrame
    types: DataFrame
    dependencies: DataFrame
    hotspots: DataFrame
    overview: DataFrame

    def write(self, folder: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{folder}/{f.name}")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Snapshot | None:
        """The snapshot in a folder, or None if there is none that can be read."""
        try:
            return cls(*(spark.read.parquet(f"{folder}/{f.name}") for f in fields(cls)))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise


def taken(nodes: DataFrame, edges: DataFrame) -> Snapshot:
    hot = rollup.hotspots(nodes, edges).join(nodes.select("node_id", "file", "name", F.col("start_line").alias("line")), "node_id")
    reason = F.when(F.col("reason") == "complexity", F.concat(F.lit("complexity "), F.col("value").cast("string"))).otherwise(F.concat(F.col("value").cast("string"), F.lit(" callers")))
    overview = rollup.overview(nodes).crossJoin(rollup.health(nodes, edges))  # one row each
    return Snapshot(function_info(nodes, edges), type_info(nodes), cross_file(nodes, edges), hot.select("file", "name", "line", reason.alias("reason")), overview)


def _keyed(functions: DataFrame, name: str) -> DataFrame:
    """(file, name, side): the last function of a name in each file."""
    made = F.struct(F.col("line").alias("line"), F.col("node_id").alias("node_id"), signature().alias("signature"))
    return functions.groupBy("file", "name").agg(F.max(made).alias(name))


def function_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, name, line, change, description) of functions as function_info() gives them: added, removed, signature."""
    both = _keyed(old, "old").join(_keyed(new, "new"), ["file", "name"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old.signature") != F.col("new.signature"), "signature")
    text = F.when(change == "signature", F.concat("old.signature", F.lit(" → "), "new.signature")).otherwise(F.coalesce("new.signature", "old.signature"))
    return both.select("file", "name", F.coalesce("new.line", "old.line").alias("line"), change.alias("change"), text.alias("description")).where("change IS NOT NULL")


def _counts(functions: DataFrame, types: DataFrame) -> DataFrame:
    rows = functions.select("file", F.lit(1).alias("f"), F.lit(0).alias("t")).unionByName(types.select("file", F.lit(0).alias("f"), F.lit(1).alias("t")))
    return rows.groupBy("file").agg(F.sum("f").alias("functions"), F.sum("t").alias("types"))


def modified_files(old: Snapshot, new: Snapshot) -> DataFrame:
    """(file): files that are new, or have other numbers of functions or types. Files that are gone are not told."""
    before = _counts(old.functions, old.types).select("file", F.struct("functions", "types").alias("before"))
    return _counts(new.functions, new.types).select("file", F.struct("functions", "types").alias("now")).join(before, "file", "left").where("before IS NULL OR before <> now").select("file")


def dependency_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(dependency, change): those that only one of two lists of dependencies has, by caller and callee."""
    text = F.concat("caller", F.lit("→"), "callee").alias("dependency")
    a, b = old.select(text).distinct(), new.select(text).distinct()
    return b.subtract(a).withColumn("change", F.lit("new")).unionByName(a.subtract(b).withColumn("change", F.lit("lost")))


@dataclass(frozen=True)
class Changes:
    functions: DataFrame
    files: DataFrame
    dependencies: DataFrame
    health_delta: DataFrame

    def empty(self) -> bool:
        return self.functions.isEmpty() and self.files.isEmpty() and self.dependencies.isEmpty() and not self.health_delta.first()[0]


def compared(old: Snapshot, new: Snapshot) -> Changes:
    delta = new.overview.select(F.col("health").alias("now")).crossJoin(old.overview.select(F.col("health").alias("before")))  # one row each
    return Changes(function_changes(old.functions, new.functions), modified_files(old, new), dependency_changes(old.dependencies, new.dependencies), delta.select((F.col("now") - F.col("before")).alias("health_delta")))


def summary_hotspots(found: Snapshot, n: int = 10) -> DataFrame:
    """(text): the first hotspots, by file, line and reason."""
    text = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "name", F.lit(" ("), "reason", F.lit(")"))
    return found.hotspots.orderBy("file", "line", "name", "reason").limit(n).select(text.alias("text"))


def summary_dependencies(found: Snapshot, n: int = 20) -> DataFrame:
    """(text): the first dependencies, by caller and callee."""
    rows = found.dependencies.orderBy("caller", "callee", "from_file", "to_file").limit(n)
    return rows.select(F.concat("caller", F.lit(" -> "), "callee").alias("text"))


def summary_files(found: Snapshot, imports: DataFrame | None = None) -> DataFrame:
    """(file, functions, types, imports): sorted short signatures of each file, joined by line ends; tests are out."""
    rows = found.functions.select("file", short_signature().alias("f"), F.lit(None).cast("string").alias("t"), F.lit(None).cast("string").alias("i"))
    rows = rows.unionByName(found.types.select("file", F.lit(None).cast("string").alias("f"), short_type().alias("t"), F.lit(None).cast("string").alias("i")))
    if imports is not None:
        rows = rows.unionByName(imports.select(F.col("path").alias("file"), F.lit(None).cast("string").alias("f"), F.lit(None).cast("string").alias("t"), F.col("module").alias("i")))
    listed = lambda c, name: F.array_join(F.array_sort(F.collect_list(c)), "\n").alias(name)
    return rows.where(~is_test_file("file")).groupBy("file").agg(listed("f", "functions"), listed("t", "types"), F.array_join(F.array_sort(F.collect_set("i")), "\n").alias("imports"))


#: Rules that every manifest has: (id, text). The texts are this engine's own.
RULES = (
    ("when-to-check", "Run the check once when a change is complete, before it is committed, not after every edit."),
    ("fix-loop", "If the check reports issues, run the fix once; it retries by itself."),
    ("no-infinite-loop", "Never run the check in a loop of your own: work, check, fix if needed, commit."),
    ("no-breaking-without-review", "Do not change signatures of public functions without having that reviewed."),
    ("test-new-functions", "Every new public function has a test at least."),
)


def manifest_rules(nodes: DataFrame, edges: DataFrame, sure: float = 0.9) -> DataFrame:
    """(id, description, severity): the fixed rules, and the conventions that are sure enough."""
    spark = nodes.sparkSession
    fixed = spark.createDataFrame([(*r, "required") for r in RULES], "id string, description string, severity string")
    found = conventions.discovered(nodes, edges).where(F.col("confidence") >= sure)
    own = found.select(F.concat(F.lit("invariant-"), F.substring(F.sha2("description", 256), 1, 12)).alias("id"), "description", F.lit("warning").alias("severity"))
    return fixed.unionByName(own)


def manifest_project(nodes: DataFrame) -> DataFrame:
    """(languages, files, functions, types, high_complexity, health): one row."""
    real = nodes.where(rollup.REAL)
    hard = F.col("complexity") > 15
    n = real.agg(F.array_join(F.array_sort(F.collect_set(language("file", MANIFEST_LANGUAGES, None))), ",").alias("languages"), F.countDistinct("file").alias("files"), F.count_if(F.col("node_kind") == "function").alias("functions"), F.count_if(F.col("node_kind") == "type").alias("types"), F.count_if(hard).alias("high_complexity"))
    return n.withColumn("health", F.lit(100) - F.least(F.col("high_complexity") * 3, F.lit(30)))


# --- what agents ask -----------------------------------------------------------------------------------------------


def file_context(found: Snapshot, path: str) -> DataFrame:
    """The functions of the file whose path ends with ``path`` or is its end; of several, the first."""
    path = path.replace("\\", "/")
    hit = found.functions.where(F.endswith("file", F.lit(path)) | F.endswith(F.lit(path), F.col("file")))
    return hit.join(hit.agg(F.min("file").alias("file")), "file", "left_semi")


def before_edit(found: Snapshot, path: str, name: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(functions, dependencies, warning) of a file, or of its functions of a name."""
    own = file_context(found, path)
    touched = own.select("file").distinct()
    links = found.dependencies
    near = links.join(touched, F.col("from_file") == F.col("file"), "left_semi").unionByName(links.join(touched, F.col("to_file") == F.col("file"), "left_semi")).distinct()
    if name is not None:
        own = own.where(F.contains(F.lower("name"), F.lit(name.lower())))
    many = F.when(F.size(F.split("called_by", ",")) > 3, True)
    warning = own.agg(F.when(F.max(many), "Some functions have many callers. Changes may have wide impact.").alias("warning"))
    return own, near, warning


def plan_change(found: Snapshot, target: str, name: str | None = None, n: int = 10) -> DataFrame:
    """(file, relevance): the files that have most to do with a text. A function whose name holds it, or whose short
    name it holds, counts 10, each callee whose name holds it 5, each function with ``name`` in its name 20."""
    target, lower = target.lower(), F.lower("name")
    own = F.when(F.contains(lower, F.lit(target)) | F.contains(F.lit(target), F.substring_index(lower, "::", -1)), 10).otherwise(0)
    calls = F.size(F.filter(F.split("calls", ","), lambda c: F.contains(F.lower(c), F.lit(target)) & (c != ""))) * 5
    asked = F.when(F.contains(lower, F.lit((name or "").lower())), 20).otherwise(0) if name else F.lit(0)
    rows = found.functions.groupBy("file").agg(F.sum(own + calls + asked).alias("relevance")).where("relevance > 0")
    return rows.orderBy(F.desc("relevance"), "file").limit(n)


# --- tools of a project --------------------------------------------------------------------------------------------

#: By purpose: what to run, and the files or packages of which one is enough; the first that fits counts. Fixed values.
TOOLS = {
    "type_check": (("npx vue-tsc --noEmit", "tsconfig.json & (node_modules/.bin/vue-tsc | node_modules/.bin/vue-tsc.cmd | @vue-tsc)"), ("npx tsc --noEmit", "tsconfig.json | @typescript")),
    "linter": (("npx eslint", ".eslintrc.js | .eslintrc.json | .eslintrc.yml | eslint.config.js | eslint.config.mjs | @eslint"), ("python -m pylint", ".flake8 | .pylintrc | @pylint | @flake8"), ("ruff check", "pyproject.toml & (@ruff | ruff.toml)")),
    "formatter": (("npx prettier --write", ".prettierrc | .prettierrc.json | .prettierrc.js | prettier.config.js | prettier.config.mjs | @prettier"),),
    "test_runner": (("npx vitest run", "vitest.config.ts | vitest.config.js | @vitest"), ("npx jest", "jest.config.js | jest.config.ts | @jest"), ("pytest", "pytest.ini | @pytest"), ("cargo test", "Cargo.toml")),
}


def tooling(files: set[str], packages: set[str]) -> dict[str, str | None]:
    """What to run for each purpose, by the files at a project's root and the packages that it names."""
    there = files | {f"@{p}" for p in packages}

    def holds(rule: str) -> bool:
        return all(any(x.strip() in there for x in part.strip(" ()").split("|")) for part in rule.split("&"))

    return {purpose: next((run for run, rule in ladder if holds(rule)), None) for purpose, ladder in TOOLS.items()}
