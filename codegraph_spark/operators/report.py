"""Verification as documents: JSON, SARIF, outputs for build servers, and text.

Documents are one row each and hold every finding, sorted; findings themselves are frames.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import changes as diff
from . import conventions

VERSION = "0.1.0"


@dataclass(frozen=True)
class Verification:
    """changes: findings; violations: conventions that changed files may break; tests: suggestions; files: (file)."""

    changes: DataFrame
    violations: DataFrame
    tests: DataFrame
    files: DataFrame
    with_base: bool = True


def verified(old: DataFrame | None, new: DataFrame, edges: DataFrame, files: DataFrame | None = None, errors: DataFrame | None = None, nodes: DataFrame | None = None, impact_weighting: bool = False) -> Verification:
    """Two versions of functions compared. files: the changed ones, by default those with findings; errors: findings of
    checks and tools; nodes: all nodes of the new state, whose conventions are looked at; old is None without a version
    to compare with."""
    found = diff.semantic_diff(old, new) if old is not None else diff.semantic_diff(new.limit(0), new.limit(0))
    if impact_weighting:
        found = found.unionByName(diff.impact_weighted(found, new, edges))
    files = found.select("file").distinct() if files is None else files
    found = found.unionByName(diff.static_findings(new, files))
    if errors is not None:
        found = found.unionByName(diff.tool_findings(errors))
    scoped = conventions.scopes(new if nodes is None else nodes, edges)
    return Verification(found, diff.violations(scoped, files), diff.suggested_tests(new, files), files, old is not None)


def summary(v: Verification) -> DataFrame:
    """One row: status, risk_score, confidence, total_changes, breaking, needs_review, safe, errors, warnings. Violations
    are warnings, so that the status fails only for violations that are errors."""
    of = lambda risk: F.count_if(F.col("risk") == risk)
    counts = v.changes.agg(F.count("*").alias("total_changes"), of("Breaking").alias("breaking"), of("SecuritySensitive").alias("security"), of("NeedsReview").alias("needs_review"), of("Safe").alias("safe"))
    bad = v.violations.agg(F.count("*").alias("violations"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warned"))
    number = v.files.select("file").distinct().agg(F.count("*").alias("files"))
    one = counts.crossJoin(bad).crossJoin(number)  # one row each
    weights = {"Breaking": "breaking", "SecuritySensitive": "security", "NeedsReview": "needs_review", "Safe": "safe"}
    score = sum((F.col(name) * diff.WEIGHTS[risk] for risk, name in weights.items()), F.col("files") * 0.02 + F.when(F.col("violations") > 0, 0.15).otherwise(0.0))
    sure = F.when(F.col("files") == 0, diff.confidence(0, v.with_base)).otherwise(diff.confidence(1, v.with_base))
    return one.select(
        F.when(F.col("errors") > 0, "fail").otherwise("pass").alias("status"), F.round(F.least(score, F.lit(1.0)), 6).alias("risk_score"), sure.alias("confidence"),
        "total_changes", "breaking", "needs_review", "safe", "errors", (F.col("warned") + F.col("needs_review")).alias("warnings"),
    )


def _list(df: DataFrame, columns: list, name: str) -> DataFrame:
    """One row: the rows of df as a sorted array of structs."""
    return df.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def json_document(v: Verification) -> DataFrame:
    """One row, json: the whole result."""
    line = F.coalesce("line", F.lit(0)).alias("line")
    one = summary(v).crossJoin(_list(v.changes, ["file", line, "kind", "risk", "description"], "semantic_changes"))
    one = one.crossJoin(_list(v.violations, ["file", line, "severity", "description"], "invariant_warnings")).crossJoin(_list(v.tests, ["description", "priority", "skeleton"], "suggested_tests"))
    counts = F.struct("total_changes", "breaking", "needs_review", "safe", "errors", "warnings").alias("summary")
    return one.select(F.to_json(F.struct(F.lit(VERSION).alias("version"), "status", "risk_score", "confidence", counts, "semantic_changes", "invariant_warnings", "suggested_tests")).alias("json"))


def sarif_results(v: Verification, tool: str = "codegraph") -> DataFrame:
    """(rule_id, level, description, file, line, col, kind): findings and violations."""
    own = diff.sarif_rows(v.changes.withColumn("short_name", F.col("kind")), tool).withColumnRenamed("short_name", "kind")
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    more = v.violations.select(F.lit(f"{tool}/invariant-violation").alias("rule_id"), level.alias("level"), "description", F.replace("file", F.lit("\\"), F.lit("/")).alias("file"), F.col("line").alias("line"), F.lit(1).alias("col"), F.lit("InvariantViolation").alias("kind"))
    return own.unionByName(more)


def sarif_document(v: Verification, tool: str = "codegraph") -> DataFrame:
    """One row, sarif: a SARIF 2.1.0 log. A rule's level is the worst that its results have; the rule of violations is
    always there."""
    found = sarif_results(v, tool)
    rank = F.max(F.when(F.col("level") == "error", 3).when(F.col("level") == "warning", 2).otherwise(1))
    always = found.sparkSession.createDataFrame([(f"{tool}/invariant-violation", "InvariantViolation", 2)], "rule_id string, kind string, r int")
    rules = found.groupBy("rule_id", "kind").agg(rank.alias("r")).unionByName(always).groupBy("rule_id", "kind").agg(F.max("r").alias("r"))
    text = F.when(F.col("kind") == "InvariantViolation", "Code change may violate a codebase invariant").otherwise(F.concat(F.lit("Semantic change: "), F.col("kind")))
    level = F.element_at(F.array(F.lit("note"), F.lit("warning"), F.lit("error")), F.col("r"))
    rule = [F.col("rule_id").alias("id"), F.col("kind").alias("name"), F.struct(text.alias("text")).alias("shortDescription"), F.struct(level.alias("level")).alias("defaultConfiguration")]
    region = F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = [F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("description").alias("text")).alias("message"), F.array(place).alias("locations")]
    one = _list(rules, rule, "rules").crossJoin(_list(found, result, "results"))  # one row each
    driver = F.struct(F.lit(tool).alias("name"), F.lit(VERSION).alias("version"), "rules")
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), "results")
    return one.select(F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


# --- text of one summary row ---------------------------------------------------------------------------------------


def percent(x: float) -> str:
    """Whole percents; halves go to the even neighbour."""
    return f"{x * 100:.0f}"


def build_outputs(row: Row) -> dict[str, str]:
    """Texts for build servers by where they belong: key=value output, a dotenv file, a summary in Markdown."""
    values = {"status": row["status"], "risk": percent(row["risk_score"]), "changes": row["total_changes"]}
    table = [("Risk Score", f"**{values['risk']}%**"), ("Changes", values["changes"]), ("Breaking", row["breaking"]), ("Warnings", row["warnings"])]
    mark = "❌ FAIL" if row["status"] == "fail" else "✅ PASS"
    return {
        "output": f"status={values['status']}\nrisk-score={values['risk']}\nchanges={values['changes']}\n",
        "dotenv": "".join(f"CODEGRAPH_{k.upper()}={x}\n" for k, x in values.items()),
        "summary": f"## {mark} verification\n\n| Metric | Value |\n|--------|-------|\n" + "".join(f"| {k} | {x} |\n" for k, x in table) + "\n",
    }


def fails(row: Row, policy: str = "error") -> bool:
    """Whether a build fails: never, with warnings, or with errors."""
    return policy != "never" and (row["status"] == "fail" or (policy == "warning" and row["warnings"] > 0))


def table_text(rows: list[Row], columns: list[str], empty: str = "Nothing found.") -> str:
    """Rows for a terminal, in columns."""
    if not rows:
        return empty
    cells = [columns] + [["" if r[c] is None else str(r[c]) for c in columns] for r in rows]
    wide = [max(len(r[k]) for r in cells) for k in range(len(columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip() for r in cells)


def verify_text(row: Row, findings: list[Row], tests: list[Row] = ()) -> str:
    """A verification for people: the verdict, the findings, and the first five tests that are missing."""
    head = f"{row['status'].upper()}  risk {percent(row['risk_score'])}%  confidence {percent(row['confidence'])}%  {row['breaking']} breaking, {row['needs_review']} to review, {row['safe']} safe"
    body = [f"  {f['risk']:<17} {f['file']}:{f['line'] or 0}  {f['description']}" for f in findings]
    return "\n".join([head, *body, *(f"  test: {t['description']}" for t in list(tests)[:5])])
