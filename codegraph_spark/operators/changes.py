"""Semantic diff of two versions of the functions, and verification: risks, findings, a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the risk score. Fixed values.
WEIGHTS = {"Breaking": 0.25, "SecuritySensitive": 0.20, "NeedsReview": 0.05, "Safe": 0.01}


def function_map(functions: DataFrame) -> DataFrame:
    """The last definition of each short name in a file; placeholders are out."""
    own = functions.where("complexity IS NOT NULL")
    last = own.groupBy("file", "short_name").agg(F.max_by(F.struct(*own.columns), F.struct("start_line", "node_id")).alias("f"))
    return last.select("f.*")


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new structs of each (file, short_name), null where a version has no such function. Of files that only
    one version has, placeholders count as functions, too."""

    def side(own: DataFrame, other: DataFrame, name: str) -> DataFrame:
        alone = own.where("complexity IS NULL").join(other.select("file").distinct(), "file", "left_anti").select(own.columns)
        return function_map(own).unionByName(alone).select("file", "short_name", F.struct(*own.columns).alias(name))

    return side(old, new, "old").join(side(new, old, "new"), ["file", "short_name"], "full")


_FINDING = "array<struct<kind:string,risk:string,description:string>>"


def _finding(when: Column, kind: str, risk: Column, what: Column) -> Column:
    """An array of one finding, or none."""
    made = F.array(F.struct(F.lit(kind).alias("kind"), risk.alias("risk"), what.alias("description")))
    return F.when(F.coalesce(when, F.lit(False)), made).otherwise(F.array().cast(_FINDING))


def _public(side: str, yes: str, no: str) -> Column:
    return F.when(F.col(f"{side}.visibility") == "public", F.lit(yes)).otherwise(F.lit(no))


def _said(*parts: str | Column) -> Column:
    """'name': and then the parts."""
    return F.concat(F.lit("'"), F.col("new.name"), F.lit("': "), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def added() -> Column:
    return _finding(F.col("old").isNull(), "FunctionAdded", _public("new", "NeedsReview", "Safe"), F.concat(F.lit("New function '"), F.col("new.name"), F.lit("'")))


def removed() -> Column:
    return _finding(F.col("new").isNull(), "FunctionRemoved", _public("old", "Breaking", "Safe"), F.concat(F.lit("Removed function '"), F.col("old.name"), F.lit("'")))


def param_count() -> Column:
    a, b = F.size("old.params"), F.size("new.params")
    return _finding(_both() & (a != b), "SignatureChange", _public("new", "Breaking", "NeedsReview"), _said("parameter count changed (", a, " → ", b, ")"))


def param_types() -> Column:
    """A finding for each position whose type differs, where the numbers of parameters agree."""
    same = F.coalesce(_both() & (F.size("old.params") == F.size("new.params")), F.lit(False))
    pairs = F.filter(F.arrays_zip(F.col("old.params").alias("a"), F.col("new.params").alias("b")), lambda p: ~p["a"]["type_debug"].eqNullSafe(p["b"]["type_debug"]))
    risk = _public("new", "Breaking", "NeedsReview")
    made = F.transform(pairs, lambda p: F.struct(F.lit("TypeChange").alias("kind"), risk.alias("risk"), _said("param '", p["b"]["name"], "' type changed").alias("description")))
    return F.when(same, made).otherwise(F.array().cast(_FINDING))


def return_type() -> Column:
    a, b = F.col("old.return_type_debug"), F.col("new.return_type_debug")
    shown = lambda x: F.when(x.isNull(), "None").otherwise(F.concat(F.lit("Some("), x, F.lit(")")))
    return _finding(_both() & ~a.eqNullSafe(b), "SignatureChange", _public("new", "Breaking", "NeedsReview"), _said("return type changed (", shown(a), " → ", shown(b), ")"))


def visibility() -> Column:
    a, b = F.col("old.visibility"), F.col("new.visibility")
    risk = F.when(a == "public", F.lit("Breaking")).when(b == "public", F.lit("NeedsReview")).otherwise(F.lit("Safe"))
    return _finding(_both() & (a != b), "ApiSurfaceChange", risk, _said("visibility changed (", F.initcap(a), " → ", F.initcap(b), ")"))


def complexity(least: int = 3, high: int = 20) -> Column:
    a, b = F.col("old.complexity"), F.col("new.complexity")
    risk = F.when(b > high, F.lit("NeedsReview")).otherwise(F.lit("Safe"))
    by = F.concat(F.when(b > a, F.lit("+")).otherwise(F.lit("")), (b - a).cast("string"))
    return _finding(_both() & (F.abs(b - a) >= least), "ComplexityChange", risk, _said("complexity changed (", a, " → ", b, ", ", by, ")"))


def asyncness() -> Column:
    a, b = F.col("old.is_async"), F.col("new.is_async")
    return _finding(_both() & (a != b), "ControlFlowChange", _public("new", "Breaking", "NeedsReview"), _said("async changed (", a, " → ", b, ")"))


def _both() -> Column:
    return F.col("old").isNotNull() & F.col("new").isNotNull()


RULES = (added, removed, param_count, param_types, return_type, visibility, complexity, asyncness)


def findings(pairs: DataFrame, *rules) -> DataFrame:
    """(file, short_name, line, kind, risk, description) of rules, in one pass over the pairs."""
    found = pairs.select("file", "short_name", F.coalesce("new.start_line", "old.start_line").alias("line"), F.explode(F.concat(*[rule() for rule in rules])).alias("f"))
    return found.select("file", "short_name", "line", "f.kind", "f.risk", "f.description")


def semantic_diff(old: DataFrame, new: DataFrame, rules=RULES) -> DataFrame:
    """Findings of all rules."""
    return findings(paired(old, new), *rules)


def impact_weighted(changes: DataFrame, functions: DataFrame, edges: DataFrame, callers_from: int = 5) -> DataFrame:
    """Findings for public functions that have a finding and more than so many callers within two steps."""
    from .graph import impact

    own = function_map(functions).where("visibility = 'public'").select("node_id", "file", "short_name", "name", F.col("start_line").alias("line"))
    touched = own.join(changes.where("kind NOT IN ('FunctionAdded', 'FunctionRemoved')").select("file", "short_name").distinct(), ["file", "short_name"], "left_semi")
    counted = impact(edges, touched.select(F.col("node_id").alias("root")), 2, reverse=True).groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > callers_from)
    what = F.concat(F.lit("'"), F.col("name"), F.lit("': "), F.col("n").cast("string"), F.lit(" callers affected by above changes"))
    return touched.join(counted, F.col("node_id") == F.col("root")).select("file", "short_name", "line", F.lit("ApiSurfaceChange").alias("kind"), F.lit("NeedsReview").alias("risk"), what.alias("description"))


def tool_findings(errors: DataFrame) -> DataFrame:
    """Findings of checks and tools. errors: (tool, file, line, severity, message)."""
    risk = F.when(F.col("severity") == "error", F.lit("Breaking")).otherwise(F.lit("NeedsReview"))
    what = F.concat(F.lit("["), F.col("tool"), F.lit("] "), F.col("message"))
    return errors.select("file", F.lit(None).cast("string").alias("short_name"), "line", F.lit("ControlFlowChange").alias("kind"), risk.alias("risk"), what.alias("description"))


def violations(scopes: DataFrame, files: DataFrame) -> DataFrame:
    """(file, line, severity, description): conventions whose nodes lie in changed files, a row a node.

    scopes: (description, file, line), the nodes that a convention holds for; files: (file), the changed ones, in either
    of two spellings: one path may be the end of the other. Paths meet under their last part, so this is an equi-join.
    """
    own = scopes.withColumn("path", F.replace("file", F.lit("\\"), F.lit("/"))).withColumn("last", _last("file"))
    changed = files.select(F.replace("file", F.lit("\\"), F.lit("/")).alias("changed"), _last("file").alias("last")).distinct()
    met = own.join(changed, (own["last"] == changed["last"]) & (F.endswith("path", F.col("changed")) | F.endswith("changed", F.col("path"))), "left_semi")
    return met.select("file", "line", F.lit("warning").alias("severity"), F.concat(F.lit("Changed file may affect invariant: "), "description").alias("description"))


def _last(path: str) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def static_findings(functions: DataFrame, files: DataFrame) -> DataFrame:
    """Unsafe functions in changed files."""
    own = functions.where("is_unsafe").join(files, "file", "left_semi")
    what = F.concat(F.lit("Unsafe function '"), "name", F.lit("' — requires careful review"))
    return own.select("file", "short_name", F.col("start_line").alias("line"), F.lit("ControlFlowChange").alias("kind"), F.lit("SecuritySensitive").alias("risk"), what.alias("description"))


def suggested_tests(functions: DataFrame, files: DataFrame) -> DataFrame:
    """Public functions of changed files that should have a test."""
    own = functions.where("visibility = 'public' AND complexity IS NOT NULL").join(files, "file", "left_semi")
    skeleton = F.concat(F.lit("#[test]\nfn test_"), "short_name", F.lit("() {\n    todo!()\n}"))
    return own.select("file", "short_name", F.lit("High").alias("priority"), F.concat(F.lit("Add tests for '"), "name", F.lit("'")).alias("description"), skeleton.alias("skeleton"))


#: What to do about a finding, by kind and risk. Fixed values.
ACTIONS = {
    ("SignatureChange", "Breaking"): "Update all callers or add a backward-compatible wrapper",
    ("FunctionRemoved", "Breaking"): "Verify no external consumers depend on this",
    ("FunctionAdded", "NeedsReview"): "Add tests for the new function",
    ("ComplexityChange", "NeedsReview"): "Consider splitting into smaller functions",
    ("ControlFlowChange", "SecuritySensitive"): "Requires security review",
}


def advised(changes: DataFrame) -> DataFrame:
    """changes with what they are in short, and an action or null."""
    action = F.lit(None).cast("string")
    for (kind, risk), text in ACTIONS.items():
        action = F.when((F.col("kind") == kind) & (F.col("risk") == risk), text).otherwise(action)
    name = F.regexp_extract("description", "^(?:New|Removed) function '(.*)'$", 1)
    numbers = F.regexp_extract("description", r"\((\d+ → \d+), ", 1)
    grown = F.when(F.contains("description", F.lit(", +")), "increased").otherwise("decreased")
    short = F.when(F.col("kind") == "FunctionAdded", F.concat(F.lit("New function "), name)).when(F.col("kind") == "FunctionRemoved", F.concat(F.lit("Removed "), name))
    short = short.when(F.col("kind") == "ComplexityChange", F.concat(F.lit("Complexity "), grown, F.lit(" "), numbers)).otherwise(F.col("description"))
    return changes.select("*", short.alias("short"), action.alias("action"))


def issues_by_file(changes: DataFrame) -> DataFrame:
    """(file, issues, errors, warnings): how many findings each file has, by how bad they are."""
    bad = F.col("risk").isin("Breaking", "SecuritySensitive")
    return changes.groupBy("file").agg(F.count("*").alias("issues"), F.count_if(bad).alias("errors"), F.count_if(F.col("risk") == "NeedsReview").alias("warnings"))


def risk_score(changes: DataFrame, files: DataFrame, violated: bool = False) -> DataFrame:
    """One row: counts by risk, and the weighted score, at most 1."""
    n = {risk: F.count_if(F.col("risk") == risk) for risk in WEIGHTS}
    counts = changes.agg(*[n[risk].alias(risk.lower()) for risk in WEIGHTS])
    number = files.select("file").distinct().agg(F.count("*").alias("changed_files"))
    score = sum((F.col(risk.lower()) * w for risk, w in WEIGHTS.items()), F.col("changed_files") * 0.02 + (0.15 if violated else 0.0))
    return counts.crossJoin(number).withColumn("risk_score", F.round(F.least(score, F.lit(1.0)), 6))


def confidence(files: int, with_base: bool) -> float:
    """How far a verification can be trusted: fully without changes, less without a version to compare with."""
    return 1.0 if not files else 0.85 if with_base else 0.5


def sarif_rows(changes: DataFrame, tool: str = "codegraph") -> DataFrame:
    """SARIF results: rule id, level, text and place."""
    level = F.when(F.col("risk").isin("Breaking", "SecuritySensitive"), "error").when(F.col("risk") == "NeedsReview", "warning").otherwise("note")
    return changes.select(F.concat(F.lit(f"{tool}/"), F.lower(F.replace("kind", F.lit(" "), F.lit("-")))).alias("rule_id"), level.alias("level"), "description", F.replace("file", F.lit("\\"), F.lit("/")).alias("file"), "short_name", F.coalesce("line", F.lit(0)).alias("line"), F.lit(1).alias("col"))
