"""Types of analysed code: read from their text in a language, shown in two forms.

A type is a tuple: ("primitive", name), ("array" | "optional", inner), ("map" | "result", a, b), ("tuple" | "union",
*parts), ("unit",), ("unresolved", text), ("unknown",).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: How primitives are shown. Fixed values.
PRIMITIVES = {"Bool": "bool", "Int8": "i8", "Int16": "i16", "Int32": "i32", "Int64": "i64", "Uint8": "u8", "Uint16": "u16", "Uint32": "u32", "Uint64": "u64", "Float32": "f32", "Float64": "f64", "String": "string", "Bytes": "bytes"}


@dataclass(frozen=True)
class Spelling:
    """How a language writes types: words for primitives and others, generics by name, brackets of generics, what
    joins unions, and the words that make a union of two optional."""

    words: dict[str, tuple]
    generics: dict[str, str]
    brackets: str
    suffix: str = ""
    union: str = ""
    void: frozenset = frozenset()


def _primitives(**names: str) -> dict[str, tuple]:
    return {word: ("primitive", name) for word, name in names.items()}


#: Fixed values.
SPELLINGS = {
    "rust": Spelling({shown: ("primitive", name) for name, shown in PRIMITIVES.items() if name not in ("String", "Bytes")} | {w: ("primitive", "String") for w in ("String", "&str", "str")} | {"()": ("unit",)}, {"Option": "optional", "Result": "result", "Vec": "array", "HashMap": "map"}, "<>"),
    "typescript": Spelling(_primitives(string="String", number="Float64", boolean="Bool", bool="Bool") | {w: ("unit",) for w in ("void", "undefined", "null", "never")} | {w: ("unknown",) for w in ("any", "unknown")}, {"Array": "array", "Promise": "same", "Map": "map"}, "<>", suffix="[]", union="|"),
    "python": Spelling(_primitives(str="String", int="Int64", float="Float64", bool="Bool", bytes="Bytes") | {"None": ("unit",), "Any": ("unknown",)}, {"list": "array", "List": "array", "dict": "map", "Dict": "map", "Optional": "optional", "tuple": "tuple", "Tuple": "tuple"}, "[]", union="|"),
}


def split_outside(text: str, separator: str) -> list[str]:
    """Parts between separators that stand outside all brackets."""
    parts, depth, begin = [], 0, 0
    for at, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and text[at - 1 : at] not in ("-", "=")))
        if c == separator and depth == 0:
            parts.append(text[begin:at])
            begin = at + 1
    return [p.strip() for p in [*parts, text[begin:]]]


def read(text: str | None, language: str) -> tuple:
    """The type that a text means; what is not known stays as its text."""
    if text is None:
        return ("unknown",)
    how, text = SPELLINGS[language], text.strip().lstrip(":").strip()
    if text in how.words:
        return how.words[text]
    left, right = map(re.escape, how.brackets)
    found = re.fullmatch(rf"(\w+){left}(.*){right}", text, re.S)
    if found and found[1] in how.generics and len(split_outside(text, how.union or "\0")) == 1:
        kind, args = how.generics[found[1]], split_outside(found[2], ",")
        if kind == "same":
            return read(found[2], language)
        if kind in ("array", "optional"):
            return (kind, read(found[2], language))
        if kind == "tuple":
            return (kind, *(read(a, language) for a in args))
        if len(args) >= 2:
            return (kind, read(args[0], language), read(", ".join(args[1:]), language))
    if how.suffix and text.endswith(how.suffix) and len(split_outside(text, "|")) == 1:
        return ("array", read(text[: -len(how.suffix)], language))
    if how.union and len(parts := split_outside(text, how.union)) > 1:
        kinds = [read(p, language) for p in parts]
        real = [k for k in kinds if k != ("unit",)]
        return ("optional", real[0]) if len(kinds) == 2 and len(real) == 1 else ("union", *kinds)
    return ("unresolved", text)


def debug(t: tuple) -> str:
    """The form that predicates and comparisons look at."""
    kind, *parts = t
    if kind == "unresolved":
        return 'Unresolved("' + parts[0].replace("\\", "\\\\").replace('"', '\\"') + '")'
    if kind == "unknown":
        return "Unknown"
    if kind == "unit":
        return "Resolved(Unit)"
    if kind == "primitive":
        return f"Resolved(Primitive({parts[0]}))"
    shown = [debug(p) for p in parts]
    if kind == "map":
        inside = f"Map {{ key: {shown[0]}, value: {shown[1]} }}"
    elif kind == "result":
        inside = f"Result {{ ok: {shown[0]}, err: {shown[1]} }}"
    elif kind in ("tuple", "union"):
        inside = f"{kind.title()}([{', '.join(shown)}])"
    else:
        inside = f"{kind.title()}({shown[0]})"
    return f"Resolved({inside})"


def display(t: tuple) -> str:
    """The form that people read."""
    kind, *parts = t
    if kind == "unresolved":
        return parts[0]
    if kind in ("unknown", "unit"):
        return "unknown" if kind == "unknown" else "void"
    if kind == "primitive":
        return PRIMITIVES[parts[0]]
    shown = [display(p) for p in parts]
    formats = {"array": "{}[]", "optional": "{} | null", "map": "Map<{}, {}>", "result": "Result<{}, {}>"}
    if kind in formats:
        return formats[kind].format(*shown)
    return f"({', '.join(shown)})" if kind == "tuple" else " | ".join(shown)
