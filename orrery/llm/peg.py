"""A small packrat engine for parsing-expression grammars: every (rule, place) is tried once, and its result kept.

A grammar is a dict of named expressions. An expression is a function (parser, place) -> end or -1; names become spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Expr = Callable[["Parser", int], int]


class Parser:
    def __init__(self, grammar: dict[str, Expr], text: str):
        self.grammar, self.text, self.memo = grammar, text, {}
        self.spans: list[tuple[str, int, int]] = []

    def apply(self, name: str, at: int) -> int:
        found = self.memo.get((name, at))
        if found is None:
            mark = len(self.spans)
            end = self.grammar[name](self, at)
            kept = self.spans[mark:] if end >= 0 else []
            del self.spans[mark:]
            found = self.memo[name, at] = (end, kept)
        end, kept = found
        if end >= 0:
            self.spans.extend(kept)
        return end

    def parse(self, name: str, at: int = 0) -> list[tuple[str, int, int]] | None:
        """Spans of the named parts in the order of the text, or None."""
        self.spans = []
        return self.spans if self.apply(name, at) >= 0 else None


def token(pattern: str, flags: int = 0) -> Expr:
    match = re.compile(pattern, flags).match

    def run(p: Parser, at: int) -> int:
        m = match(p.text, at)
        return m.end() if m else -1

    return run


def rule(name: str) -> Expr:
    return lambda p, at: p.apply(name, at)


def seq(*parts: Expr) -> Expr:
    def run(p: Parser, at: int) -> int:
        mark = len(p.spans)
        for part in parts:
            at = part(p, at)
            if at < 0:
                del p.spans[mark:]
                return -1
        return at

    return run


def first(*parts: Expr) -> Expr:
    """Ordered choice."""

    def run(p: Parser, at: int) -> int:
        for part in parts:
            end = part(p, at)
            if end >= 0:
                return end
        return -1

    return run


def many(part: Expr, least: int = 0) -> Expr:
    def run(p: Parser, at: int) -> int:
        mark, n = len(p.spans), 0
        while True:
            end = part(p, at)
            if end < 0 or end == at:
                break
            at, n = end, n + 1
        if n < least:
            del p.spans[mark:]
            return -1
        return at

    return run


def maybe(part: Expr) -> Expr:
    return first(part, lambda p, at: at)


def ahead(part: Expr, wanted: bool = True) -> Expr:
    """Lookahead: reads nothing."""

    def run(p: Parser, at: int) -> int:
        mark = len(p.spans)
        met = part(p, at) >= 0
        del p.spans[mark:]
        return at if met == wanted else -1

    return run


def span(name: str, part: Expr) -> Expr:
    """Semantic action: keep the source offsets of `part` under a name."""

    def run(p: Parser, at: int) -> int:
        mark = len(p.spans)
        p.spans.append((name, at, -1))
        end = part(p, at)
        if end < 0:
            del p.spans[mark:]
            return -1
        p.spans[mark] = (name, at, end)
        return end

    return run
