"""Search strings: what people type, read into a Match.

    word   wor*   "a phrase"   "a phr"*   one + two (a phrase)   ^first
    a b (both)   a AND b   a OR b   a NOT b   ( ... )
    NEAR(a "b c" d, 5)   text: word   text: ( ... )

NOT binds closest, then AND, then OR; words side by side belong together before any of these.
A string that is none of this is taken word by word, each in quotes; if that says nothing
either, it is an error of the reader's and told so.
"""

from __future__ import annotations

import re

from logloom.plans.search import Match, near, phrase

_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([\w\x1a]+)|([()+*:,^]))')
_BINDING = {"OR": 1, "AND": 2, "NOT": 3}
NEAR_DISTANCE = 10


class QueryError(ValueError):
    """The string is no search query."""


class _Reader:
    def __init__(self, said: str, columns: tuple[str, ...]):
        self.columns, self.at, self.tokens, end = columns, 0, [], 0
        said = said.rstrip()
        while end < len(said):
            found = _TOKEN.match(said, end)
            if not found:
                raise QueryError(f"unexpected {said[end:].strip()[:1]!r}")
            quoted, bare, sign = found.groups()
            self.tokens.append(("string", quoted[1:-1].replace('""', '"')) if quoted is not None else ("bare", bare) if bare else ("sign", sign))
            end = found.end()

    def next_is(self, *signs: str, ahead: int = 0) -> bool:
        at = self.at + ahead
        return at < len(self.tokens) and self.tokens[at][0] == "sign" and self.tokens[at][1] in signs

    def take(self, sign: str) -> None:
        if not self.next_is(sign):
            raise QueryError(f"{sign!r} expected")
        self.at += 1

    def operator(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        return value if kind == "bare" and value in _BINDING else None

    def text_next(self) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "sign" and self.operator() is None

    def expression(self, least: int = 1) -> Match:
        left = self.operand()
        while (op := self.operator()) and _BINDING[op] >= least:
            self.at += 1
            right = self.expression(_BINDING[op] + 1)
            left = left & right if op == "AND" else left | right if op == "OR" else left - right
        return left

    def column(self) -> bool:
        """Whether `name :` comes next; it is taken."""
        if not (self.text_next() and self.next_is(":", ahead=1)):
            return False
        if (name := self.tokens[self.at][1].lower()) not in self.columns:
            raise QueryError(f"no such column: {name}")
        self.at += 2
        return True

    def operand(self) -> Match:
        named = self.column()
        if self.next_is("("):
            self.at += 1
            inner = self.expression()
            self.take(")")
            return inner
        parts = [self.near_or_phrase()]
        while self.text_next() or self.next_is("^"):
            if self.column() and self.next_is("("):
                raise QueryError("AND, OR or NOT expected before (")
            parts.append(self.near_or_phrase())
        if named and not parts:
            raise QueryError("nothing after the column")
        said = [p for p in parts if p.op != "nothing"] or parts[:1]  # words side by side: what holds no word asks for nothing
        out = said[0]
        for p in said[1:]:
            out = out & p
        return out

    def near_or_phrase(self) -> Match:
        if self.text_next() and self.tokens[self.at] == ("bare", "NEAR") and self.next_is("(", ahead=1):
            self.at += 2
            parts, distance = [], NEAR_DISTANCE
            while self.text_next():
                parts.append(self.phrase())
            if self.next_is(","):
                self.at += 1
                number = self.tokens[self.at][1] if self.text_next() else ""
                if not re.fullmatch("[0-9]+", number):
                    raise QueryError("NEAR wants a number after the comma")
                self.at, distance = self.at + 1, int(number)
            self.take(")")
            if not parts:
                raise QueryError("NEAR of nothing")
            return near(*parts, distance=distance)
        first = self.next_is("^")
        self.at += first
        return self.phrase(first)

    def phrase(self, first: bool = False) -> Match:
        words = []
        while True:
            if not self.text_next():
                raise QueryError("a word expected")
            words.append(self.tokens[self.at][1])
            self.at += 1
            prefix = self.next_is("*")
            self.at += prefix
            if not self.next_is("+") or prefix:
                return phrase(*words, prefix=prefix, first=first)
            self.at += 1


def _read(said: str, columns: tuple[str, ...]) -> Match:
    reader = _Reader(said, columns)
    if not reader.tokens:
        raise QueryError("an empty query")
    out = reader.expression()
    if reader.at < len(reader.tokens):
        raise QueryError(f"unexpected {reader.tokens[reader.at][1]!r}")
    return out


def quoted(said: str) -> str:
    """Every word in quotes."""
    return " ".join('"' + w.replace('"', '""') + '"' for w in said.split())


def read(said: str, columns: tuple[str, ...] = ("text",)) -> Match:
    """The Match of a search string, as typed or else word by word; QueryError if it is neither."""
    try:
        return _read(said, columns)
    except QueryError as wrong:
        try:
            return _read(quoted(said), columns)
        except QueryError:
            raise QueryError(f"invalid search query: {said!r} ({wrong})") from None


def with_open_end(said: str) -> str:
    """The last word of a plain query made a prefix, so that a half-typed word lands."""
    said = said.strip()
    if not said or re.search(r'["*:()^]|\b(AND|OR|NOT|NEAR)\b', said) or not re.fullmatch(r"\w+", said.split()[-1], re.ASCII):
        return said
    return " ".join(said.split()) + "*"
