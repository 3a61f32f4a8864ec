"""Content checks and readers of other tools' output."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIRS = {")": "(", "]": "[", "}": "{"}
OPENERS = frozenset(PAIRS.values())
#: Tags without an end tag, and root tags that are passed over. Fixed values.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
ROOT_TAGS = frozenset("template script style".split())


_STOPS = re.compile(r"""//[^\n]*|#[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|'(?:\\\n*[^\n]|[^'\\])*(?:'|\\?\n*\Z)|"(?:\\\n*[^\n]|[^"\\])*(?:"|\\?\n*\Z)|`(?:\\\n*[^\n]|[^`\\])*(?:`|\\?\n*\Z)|[()\[\]{}]""", re.S)


def bracket_findings(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(line, column, severity, message): brackets that do not match, outside strings and comments.

    Goes from one bracket to the next; strings and comments, to their end or the text's, are passed over at once.
    """
    stack: list[tuple[str, int, int]] = []
    ends = [m.start() for m in re.finditer("\n", text)]

    def place(at: int) -> tuple[int, int]:
        line = bisect_left(ends, at)
        return line + 1, at - (ends[line - 1] if line else -1)

    for m in _STOPS.finditer(text):
        c = m.group()
        if c in OPENERS:
            stack.append((c, *place(m.start())))
        elif c in PAIRS:
            line, column = place(m.start())
            if not stack:
                yield line, column, "error", f"Unexpected closing '{c}' with no matching opener"
            else:
                opened, *where = stack.pop()
                if opened != PAIRS[c]:
                    yield line, column, "error", f"Mismatched bracket: '{c}' at line {line} closes '{opened}' from line {where[0]}:{where[1]}"
    for opened, line, column in stack:
        yield line, column, "error", f"Unclosed '{opened}' at line {line}:{column}"


_TAG = re.compile(r"<!|</([^>]*)>|<([^\s>/<]*)(?=[\s>/])([^>]*)>?")


def tag_findings(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(line, 0, error, message): tags that an end tag further out closes. Comments and doctypes end their line; tags
    that are open at the end are not reported."""
    stack: list[tuple[str, int]] = []
    for number, line in enumerate(text.split("\n"), 1):
        for m in _TAG.finditer(line.strip()):
            if m.group() == "<!":
                break
            if m[1] is not None:
                name = m[1].strip().lower()
                if name and name in (tag for tag, _ in stack):
                    while (top := stack.pop())[0] != name:
                        yield top[1], 0, "error", f"Unclosed <{top[0]}>"
            else:
                name = m[2].lower()
                if name[:1].isalpha() and name not in VOID_TAGS and not m[3].endswith("/") and (stack or name not in ROOT_TAGS):
                    stack.append((name, number))


def html_attributes(files: DataFrame) -> DataFrame:
    """(path, line, col, severity, message): '/ ' in a line with tags, and values without a name."""
    lines = lines_of(files).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    at = F.instr("text", "/ ")
    before = F.substring_index("text", "/ ", 1)
    tag = (at > 0) & ~F.startswith("text", F.lit("//")) & ~F.startswith("text", F.lit("*")) & F.col("text").rlike("[<>]") & ~F.contains(before, F.lit("//")) & ~F.contains(before, F.lit("<!--"))
    value = F.contains("text", F.lit(' ="')) | F.startswith("text", F.lit('="'))
    row = lambda when, col, message: F.when(when, F.struct(col.alias("col"), F.lit("error").alias("severity"), F.lit(message).alias("message")))
    found = F.array_compact(F.array(row(tag, at, "Malformed tag: '/' followed by space — did you mean '/>' (self-closing)?"), row(value, F.lit(0), "Attribute value without attribute name")))
    return lines.select("path", "line", F.explode(found).alias("f")).select("path", "line", "f.*")


def check_texts(files: DataFrame, check) -> DataFrame:
    """(path, line, col, severity, message) of a check text -> findings, over (path, text) in Arrow batches."""

    def run(batches):
        for batch in batches:
            rows = [(p, *f) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for f in check(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=["path", "line", "col", "severity", "message"])

    return files.select("path", "text").mapInArrow(run, "path string, line int, col int, severity string, message string")


def syntax(files: DataFrame, code: tuple[str, ...], pages: tuple[str, ...] = ("vue", "html")) -> DataFrame:
    """(path, line, col, severity, message) of all checks that a file's extension asks for. files: (path, text, error);
    error is what a parser says of the file, or null; code: the extensions that have a parser."""
    extension = F.substring_index("path", ".", -1)
    known, marked = files.where(extension.isin(*code)), files.where(extension.isin(*pages))
    parsed = known.where("error IS NOT NULL").select("path", F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit("error").alias("severity"), F.concat(F.lit("Parse error: "), "error").alias("message"))
    whole = known.where("error IS NULL")
    return parsed.unionByName(check_texts(whole, bracket_findings)).unionByName(indentation(whole.where(F.endswith("path", F.lit(".py"))))).unionByName(check_texts(marked, tag_findings)).unionByName(html_attributes(marked))


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line, text) for each line, from 1."""
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def indentation(files: DataFrame) -> DataFrame:
    """(path, line, col, severity, message): lines indented by tabs and blanks at once; line 0 for files that have lines
    with tabs and lines with blanks alone. White lines do not count."""
    lead = lines_of(files).where(F.col("text").rlike(r"\S")).withColumn("lead", F.regexp_extract("text", r"^(\s*)", 1))
    tab, blank = F.contains("lead", F.lit("\t")), F.contains("lead", F.lit(" "))
    row = lambda line, col, severity, message: [line.alias("line"), F.lit(col).alias("col"), F.lit(severity).alias("severity"), F.lit(message).alias("message")]
    mixed = lead.where(tab & blank).select("path", *row(F.col("line"), 1, "error", "Mixed tabs and spaces in indentation"))
    both = lead.groupBy("path").agg(F.bool_or(tab).alias("tabs"), F.bool_or(blank & ~tab).alias("blanks")).where("tabs AND blanks")
    return mixed.unionByName(both.select("path", *row(F.lit(0), 0, "warning", "File mixes tab and space indentation")))


def _path(column) -> F.Column:
    return F.replace(column, F.lit("\\"), F.lit("/"))


def _whole(text: F.Column) -> F.Column:
    """A number of plain digits, or 0."""
    return F.coalesce(F.when(text.rlike(r"^\+?\d+$"), text.try_cast("int")), F.lit(0))


def in_files(errors: DataFrame, files: DataFrame) -> DataFrame:
    """Errors of changed files (file); either path may be the end of the other. Paths meet under their last part."""
    last = lambda x: F.substring_index(x, "/", -1)
    changed = files.select(F.col("file").alias("changed")).distinct()
    same = (last(errors["file"]) == last(changed["changed"])) & (F.endswith(errors["file"], changed["changed"]) | F.endswith(changed["changed"], errors["file"]))
    return errors.join(changed, same, "left_semi")


def tsc(lines: DataFrame) -> DataFrame:
    """file(line,col): text of a type checker's output; errors are those whose text begins so. lines: (text)."""
    at = F.instr("text", "): ")
    head, rest = F.substring("text", F.lit(1), at - 1), F.substring("text", at + 3, F.lit(1 << 30))
    place = F.substring_index(head, "(", -1)
    part = lambda k: _whole(F.coalesce(F.get(F.split(place, ","), F.lit(k)), F.lit("")))
    file = F.substring(head, F.lit(1), F.length(head) - F.length(place) - 1)
    found = lines.where((at > 0) & F.contains(head, F.lit("(")))
    return found.select(_path(file).alias("file"), part(0).alias("line"), part(1).alias("col"), F.when(F.startswith(rest, F.lit("error")), "error").otherwise("warning").alias("severity"), rest.alias("message"))


def pylint(lines: DataFrame) -> DataFrame:
    """path:line:col:code:message of a linter's output; every finding is a warning."""
    parts = lines.select(F.transform(F.split("text", ":", 5), lambda x: F.trim(x)).alias("p")).where("size(p) = 5")
    p = lambda k: F.col("p")[k]
    return parts.select(_path(p(0)).alias("file"), _whole(p(1)).alias("line"), _whole(p(2)).alias("col"), F.lit("warning").alias("severity"), F.concat(p(3), F.lit(": "), p(4)).alias("message"))


def eslint(reports: DataFrame) -> DataFrame:
    """(file, line, col, severity, message) of JSON reports (json); severity 0 is out, 2 and more an error."""
    schema = "array<struct<filePath: string, messages: array<struct<line: int, column: int, severity: int, message: string, ruleId: string>>>>"
    files = reports.select(F.explode(F.from_json("json", schema)).alias("f"))
    found = files.select(_path(F.coalesce("f.filePath", F.lit(""))).alias("file"), F.explode("f.messages").alias("m")).where("m.severity > 0")
    text = F.concat(F.coalesce("m.message", F.lit("")), F.lit(" ("), F.coalesce("m.ruleId", F.lit("")), F.lit(")"))
    return found.select("file", F.coalesce("m.line", F.lit(0)).alias("line"), F.coalesce("m.column", F.lit(0)).alias("col"), F.when(F.col("m.severity") >= 2, "error").otherwise("warning").alias("severity"), text.alias("message"))


def py_compile(lines: DataFrame) -> DataFrame:
    """(file, line, col, severity, message): the lines of a compiler's output (file, text) that name an error."""
    from ..functions.names import line_number

    return lines.where(F.contains("text", F.lit("Error"))).select("file", line_number("text").alias("line"), F.lit(0).alias("col"), F.lit("error").alias("severity"), F.trim("text").alias("message"))


def test_failures(lines: DataFrame) -> DataFrame:
    """(run, test_name, file, line, error_type, error_message) of a test runner's output. lines: (run, no, text).

    A line FAILED file::test - message begins a failure; lines after it, up to the next one, may tell its error's type
    and message, and its place; the last of each counts.
    """
    rows = lines.select("run", "no", F.trim("text").alias("t")).withColumn("failed", F.startswith("t", F.lit("FAILED ")))
    told = F.when(F.startswith("t", F.lit("E   ")), F.substring("t", 5, 1 << 30))
    typed = F.when(F.contains(told, F.lit(": ")), told)
    where = F.when(F.contains("t", F.lit(": in test_")), F.trim(F.get(F.split("t", ":", 3), F.lit(1))))
    rows = rows.withColumn("typed", typed).withColumn("plain", F.when(typed.isNull(), told)).withColumn("place", F.when(where.rlike(r"^\d+$"), where.try_cast("int")))
    number = F.sum(F.col("failed").cast("int")).over(Window.partitionBy("run").orderBy("no"))
    rows = rows.withColumn("failure", number).where("failure > 0")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("no")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("no")))
    found = rows.groupBy("run", "failure").agg(F.max(F.when(F.col("failed"), F.substring("t", 8, 1 << 30))).alias("head"), last("typed").alias("typed"), first("plain").alias("plain"), last("place").alias("line"))
    at = F.instr("head", " - ")
    path = F.trim(F.when(at > 0, F.expr("substring(head, 1, instr(head, ' - ') - 1)")).otherwise(F.col("head")))
    message = F.trim(F.when(at > 0, F.expr("substring(head, instr(head, ' - ') + 3)")).otherwise(F.lit("")))
    kind = F.coalesce(F.trim(F.substring_index("typed", ": ", 1)), F.lit("TestFailure"))
    said = F.coalesce(F.trim(F.expr("substring(typed, instr(typed, ': ') + 2)")), F.when(message == "", F.col("plain")), message)
    name = F.when(F.instr(path, "::") > 0, F.expr("substring(path, instr(path, '::') + 2)")).otherwise(F.lit(""))
    return found.withColumn("path", path).select("run", name.alias("test_name"), F.substring_index("path", "::", 1).alias("file"), "line", kind.alias("error_type"), said.alias("error_message"))


def cargo(lines: DataFrame) -> DataFrame:
    """(file, line, col, severity, message) of a build tool's JSON lines (text): compiler messages that are errors or
    warnings, at their first span; without a span, at line 0 of no file. Lines that are no JSON are passed over."""
    schema = "reason string, message struct<level: string, message: string, spans: array<struct<file_name: string, line_start: int, column_start: int>>>"
    found = lines.select(F.from_json("text", schema).alias("j")).where("j.reason = 'compiler-message'").select("j.message.*")
    span = F.try_element_at("spans", F.lit(1))
    return found.where(F.col("level").isin("error", "warning")).select(
        F.coalesce(F.replace(span["file_name"], F.lit("\\"), F.lit("/")), F.lit("")).alias("file"),
        F.coalesce(span["line_start"], F.lit(0)).alias("line"),
        F.coalesce(span["column_start"], F.lit(0)).alias("col"),
        F.col("level").alias("severity"),
        F.coalesce("message", F.lit("")).alias("message"),
    )
