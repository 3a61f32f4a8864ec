"""Tokens of languages with braces, and the structure that brackets give them."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_COMMON = r"""(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|$))|(?P<string>{strings})|(?P<number>\d[\w.]*)|(?P<word>[^\W\d][\w$]*|\$[\w$]*{words})|(?P<op>{ops}|[^\s\w])"""
#: Operators of more than one character, longest first; '>>' is two tokens, as it may close two generics.
RUST = re.compile(_COMMON.format(strings=r"""b?r(?P<hash>\#*)"(?:[^"]|"(?!(?P=hash)))*"(?P=hash)|b?"(?:\\.|[^"\\])*"|b?'(?:\\[^\n]{1,10}?|[^'\\\n])'""", words=r"|'[^\W\d]\w*", ops=r"::|->|=>|&&|\|\||\.\.=|\.\.\.?|[!=<]="), re.S)
SCRIPT = re.compile(_COMMON.format(strings=r'''"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`''', words=r"|[#@][^\W\d]\w*", ops=r"=>|&&|\|\||\?\?|\?\.|\.\.\.|[!=<]==?"), re.S)
OPEN, CLOSE = "([{", ")]}"


@dataclass
class Tokens:
    """The tokens of a text without comments: texts, kinds, places, and each bracket's partner (or the end)."""

    text: str
    pattern: re.Pattern
    words: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    places: list[tuple[int, int]] = field(default_factory=list)
    partner: dict[int, int] = field(default_factory=dict)
    balanced: bool = True

    def __post_init__(self):
        self._lines = [m.end() for m in re.finditer("\n", self.text)]
        stack = []
        for m in self.pattern.finditer(self.text):
            kind = m.lastgroup if m.lastgroup != "hash" else "string"
            if kind == "comment":
                continue
            at, word = len(self.words), m.group()
            self.words.append(word)
            self.kinds.append(kind)
            self.places.append(m.span())
            if kind == "op" and word in OPEN:
                stack.append(at)
            elif kind == "op" and word in CLOSE:
                if stack and OPEN.index(self.words[stack[-1]]) == CLOSE.index(word):
                    begin = stack.pop()
                    self.partner[begin], self.partner[at] = at, begin
                else:
                    self.balanced = False
        self.balanced = self.balanced and not stack
        for begin in stack:
            self.partner[begin] = len(self.words)

    def __len__(self) -> int:
        return len(self.words)

    def word(self, at: int) -> str:
        return self.words[at] if 0 <= at < len(self.words) else ""

    def is_name(self, at: int) -> bool:
        return 0 <= at < len(self.words) and self.kinds[at] == "word"

    def line(self, at: int) -> int:
        return bisect_right(self._lines, self.places[min(at, len(self.places) - 1)][0]) + 1

    def source(self, lo: int, hi: int) -> str:
        """The text of tokens lo to hi - 1."""
        return self.text[self.places[lo][0] : self.places[hi - 1][1]] if lo < hi else ""

    def past(self, at: int) -> int:
        """The token after a bracket's partner."""
        return min(self.partner.get(at, at) + 1, len(self.words))

    def past_angles(self, at: int) -> int:
        """The token after a list in angle brackets that begins at ``at``, or ``at`` if none does."""
        depth, k = 0, at
        while k < len(self.words):
            word = self.words[k]
            depth += (word == "<") - (word == ">")
            if depth <= 0:
                return k + 1 if k > at else at
            k = self.past(k) if word in OPEN and self.kinds[k] == "op" else k + 1
        return k

    def until(self, at: int, hi: int, stops: tuple[str, ...]) -> int:
        """The first token from ``at`` on that is one of the stops, outside brackets of all kinds."""
        depth = 0
        while at < hi:
            word = self.words[at]
            if depth <= 0 and word in stops and self.kinds[at] in ("op", "word"):
                return at
            if self.kinds[at] == "op":
                depth += (word == "<") - (word == ">" and depth > 0)
                if word in OPEN:
                    at = self.past(at)
                    continue
            at += 1
        return hi

    def split(self, lo: int, hi: int, separator: str = ",") -> list[tuple[int, int]]:
        """Ranges between separators outside brackets of all kinds."""
        out = []
        while lo < hi:
            end = self.until(lo, hi, (separator,))
            if end > lo:
                out.append((lo, end))
            lo = end + 1
        return out

    def callee_start(self, at: int) -> int:
        """Where the expression begins whose last name is at ``at``: over paths, members, calls and indexes."""
        while self.word(at - 1) in (".", "::", "?."):
            k = at - 2
            while self.word(k) in ("?", "!"):
                k -= 1
            while k >= 0 and self.word(k) in (")", "]") and k in self.partner:
                k = self.partner[k] - 1
            if self.word(k) == ">":  # generics of a path
                depth = 0
                while k >= 0:
                    depth += (self.word(k) == ">") - (self.word(k) == "<")
                    k -= 1
                    if not depth:
                        break
                k -= self.word(k) == "::"
            if not self.is_name(k) and (k < 0 or self.kinds[k] not in ("string", "number")):
                first = k + 1
                return first if self.word(first) in ("(", "[") else at
            at = k
        return at
