"""String functions on names and paths, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_test_name(name: str | Column) -> Column:
    """Names that begin with 'test' or hold '::test', in any case."""
    low = F.lower(_col(name))
    return F.startswith(low, F.lit("test")) | F.contains(low, F.lit("::test"))


def is_test_file(path: str | Column) -> Column:
    """Paths of test files by their name or directory."""
    path = _col(path)
    name = F.substring_index(path, "/", -1)
    return F.startswith(name, F.lit("test_")) | F.startswith(name, F.lit("tests_")) | F.contains(name, F.lit(".test.")) | F.contains(name, F.lit(".spec.")) | F.contains(path, F.lit("__tests__"))


def is_snake_case(name: str | Column) -> Column:
    return _col(name).rlike(r"^[\p{Ll}_0-9]+\z")


def is_pascal_case(name: str | Column) -> Column:
    return _col(name).rlike(r"(?s)^\p{Lu}[^_]*\z")


def relative_path(path: str | Column, root: str) -> Column:
    path = _col(path)
    return F.when(F.startswith(path, F.lit(root + "/")), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path)


#: Language names by extension: in snapshots, in manifests (others are left out), in the status. Fixed values.
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "py": "python", "vue": "vue"}
MANIFEST_LANGUAGES = {"rs": "Rust", "ts": "TypeScript", "tsx": "TypeScript", "js": "TypeScript", "jsx": "TypeScript", "py": "Python"}
STATUS_LANGUAGES = MANIFEST_LANGUAGES | {"pyi": "Python"}


def language(path: str | Column, names: dict[str, str] = LANGUAGES, other: str | None = "other") -> Column:
    """The language of a path by its extension, whose case counts."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.substring_index(_col(path), ".", -1)), F.lit(other))


def line_number(text: str | Column) -> Column:
    """The digits after the first 'line ', or 0."""
    return F.coalesce(F.regexp_extract(_col(text), r"line (\d*)", 1).try_cast("int"), F.lit(0))
