"""The registry of language frontends, and files parsed by them.

A frontend turns (path, text) into a FileGraph. Files are parsed in Arrow batches, one row a file, so a lost executor
costs its files only; nodes, edges and imports are exploded from there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import python_code, rust_code, script_code
from .records import FileGraph


@dataclass(frozen=True)
class Frontend:
    name: str
    extensions: tuple[str, ...]
    parse: Callable[[str, str], FileGraph]


#: The frontends that come along, in the order in which they are asked. Extensions are fixed values.
FRONTENDS = (
    Frontend("rust", ("rs",), rust_code.parse),
    Frontend("typescript", ("ts", "tsx", "js", "jsx", "mts", "mjs"), script_code.parse),
    Frontend("python", ("py", "pyi"), python_code.parse),
)

_PARAM = "struct<name:string,type_debug:string,type_display:string,has_default:boolean>"
_FIELD = "struct<name:string,type_debug:string,visibility:string>"
NODE = f"node_id:bigint,node_kind:string,name:string,short_name:string,file:string,start_line:int,end_line:int,visibility:string,complexity:int,is_async:boolean,is_unsafe:boolean,params:array<{_PARAM}>,return_type_debug:string,return_type_display:string,data_kind:string,fields:array<{_FIELD}>,implements:array<string>,is_constant:boolean,is_mutable:boolean"
EDGE = "src:bigint,dst:bigint,edge_kind:string,condition:string,is_dynamic:boolean,line:int"
IMPORT = "module:string,symbols:array<string>,wildcard:boolean"
CALL = "file string, caller string, callee string, condition string, is_dynamic boolean, line int"
CALL_NAMES, CALL_TYPES = ["file", "caller", "callee", "condition", "is_dynamic", "line"], [*[pa.string()] * 4, pa.bool_(), pa.int32()]
PARSED = f"path string, language string, error string, nodes array<struct<{NODE}>>, edges array<struct<{EDGE}>>, imports array<struct<{IMPORT}>>"


def by_extension(frontends=FRONTENDS) -> dict[str, Frontend]:
    """The first frontend of each extension."""
    found: dict[str, Frontend] = {}
    for frontend in frontends:
        for extension in frontend.extensions:
            found.setdefault(extension, frontend)
    return found


def parse_file(path: str, content: bytes | str, frontends=FRONTENDS) -> FileGraph | None:
    """The graph of one file, or None without a frontend for it. Bytes that are no UTF-8 are replaced."""
    frontend = by_extension(frontends).get(path.rsplit(".", 1)[-1])
    if frontend is None:
        return None
    text = content.decode("utf-8", "replace") if isinstance(content, bytes) else content
    try:
        return frontend.parse(path, text)
    except RecursionError:  # nested deeper than the parser goes
        return FileGraph(path, frontend.name, error="nested too deeply")


def _known(files: DataFrame, frontends) -> DataFrame:
    """(path, content) of the files with a frontend."""
    known = files.where(F.substring_index("path", ".", -1).isin(*by_extension(frontends)) & F.col("content").isNotNull())
    return known.select("path", F.col("content").cast("binary").alias("content"))


def parse_files(files: DataFrame, frontends=FRONTENDS) -> DataFrame:
    """(path, language, error, nodes, edges, imports) of files (path, content), those with a frontend."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(PARSED)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                graph = parse_file(path, content, frontends)
                row = {"path": path, "language": graph.language, "error": graph.error, "nodes": graph.nodes, "edges": graph.edges, "imports": graph.imports}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return _known(files, frontends).mapInArrow(run, schema)


def calls_in(files: DataFrame, frontends=FRONTENDS) -> DataFrame:
    """(file, caller, callee, condition, is_dynamic, line) of files (path, content): the edges with the names of their
    ends, which are nodes of the same file. Files are parsed once and nothing else of them leaves Python."""

    def run(batches):
        for batch in batches:
            columns = [[] for _ in range(6)]
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                graph = parse_file(path, content, frontends)
                names = {n["node_id"]: n["name"] for n in graph.nodes}
                for e in graph.edges:
                    for column, value in zip(columns, (path, names[e["src"]], names[e["dst"]], e["condition"], e["is_dynamic"], e["line"]), strict=True):
                        column.append(value)
                if len(columns[0]) >= 10_000:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, CALL_TYPES)), names=CALL_NAMES)
                    columns = [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, CALL_TYPES)), names=CALL_NAMES)

    return _known(files, frontends).mapInArrow(run, CALL)


def nodes_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.explode("nodes").alias("n")).select("n.*")


def edges_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("edges").alias("e")).select("e.*", F.col("path").alias("file"))


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("imports").alias("i")).select("path", "i.*")
