"""Incremental matching of one partition's rows in order, for keyed streams."""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from ..plans.ast import ANY, NEXT_MATCH, NEXT_ROW, STRICT, Predicate, Query, Ref, UnsupportedPredicateError

Row = Mapping[str, Any]
Value = Callable[[Mapping[str, Row]], Any]
_COMPARE = {"=": operator.eq, "==": operator.eq, "<>": operator.ne, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def known(value: Any) -> Any:
    """The value, or None for what pandas has in place of null: NaN and NaT.  So NaN counts as null in streams."""
    try:
        return None if value is None or bool(value != value) else value
    except (TypeError, ValueError):
        return value


def _remainder(a: Any, b: Any) -> Any:
    """With the sign of the dividend, as in SQL."""
    return math.fmod(a, b) if isinstance(a, float) or isinstance(b, float) else int(math.copysign(abs(a) % abs(b), a)) if b else None


_ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": lambda a, b: a / b if b else None, "%": lambda a, b: _remainder(a, b) if b else None}


class _Conditions:
    """Recursive descent over the tokens of a condition; what it gives are functions of the variables' rows whose values
    are None for null, with SQL's three-valued AND, OR and NOT."""

    def __init__(self, tokens: Sequence[str | Ref]):
        self.tokens, self.at = [*tokens, ""], 0

    def _next(self) -> str | Ref:
        self.at += 1
        return self.tokens[self.at - 1]

    def _taken(self, *words: str) -> str | None:
        t = self.tokens[self.at]
        if isinstance(t, str) and t.upper() in words:
            self.at += 1
            return t.upper()
        return None

    def whole(self) -> Value:
        out = self.either()
        if self.tokens[self.at] != "" or self.at != len(self.tokens) - 1:
            raise UnsupportedPredicateError(f"{self.tokens[self.at]!r} in a condition between variables of a stream")
        return out

    def either(self) -> Value:
        out = self.both()
        while self._taken("OR"):
            out = (lambda a, b: lambda rows: True if (x := a(rows)) is True or (y := b(rows)) is True else None if x is None or y is None else False)(out, self.both())
        return out

    def both(self) -> Value:
        out = self.negated()
        while self._taken("AND"):
            out = (lambda a, b: lambda rows: False if (x := a(rows)) is False or (y := b(rows)) is False else None if x is None or y is None else True)(out, self.negated())
        return out

    def negated(self) -> Value:
        if self._taken("NOT"):
            inner = self.negated()
            return lambda rows: None if (x := inner(rows)) is None else not x
        return self.compared()

    def compared(self) -> Value:
        left = self.sum()
        if self._taken("IS"):
            no = self._taken("NOT")
            if not self._taken("NULL"):
                raise UnsupportedPredicateError("IS without NULL in a condition between variables of a stream")
            return lambda rows: (left(rows) is not None) if no else (left(rows) is None)
        op = self._taken(*_COMPARE)
        return self._of(_COMPARE[op], left, self.sum()) if op else left

    @staticmethod
    def _of(f: Callable, a: Value, b: Value) -> Value:
        return lambda rows: None if (x := a(rows)) is None or (y := b(rows)) is None else f(x, y)

    def sum(self) -> Value:
        out = self.product()
        while op := self._taken("+", "-"):
            out = self._of(_ARITHMETIC[op], out, self.product())
        return out

    def product(self) -> Value:
        out = self.signed()
        while op := self._taken("*", "/", "%"):
            out = self._of(_ARITHMETIC[op], out, self.signed())
        return out

    def signed(self) -> Value:
        if self._taken("-"):
            inner = self.signed()
            return lambda rows: None if (x := inner(rows)) is None else -x
        self._taken("+")
        return self.single()

    def single(self) -> Value:
        t = self._next()
        if isinstance(t, Ref):
            return lambda rows: known(rows[t.var][t.column.lower()])
        if t == "(":
            inner = self.either()
            if not self._taken(")"):
                raise UnsupportedPredicateError("a parenthesis that is not closed")
            return inner
        constant = {"TRUE": True, "FALSE": False, "NULL": None}
        if t.upper() in constant:
            return lambda rows: constant[t.upper()]
        if re.fullmatch(r"\d+", t):
            return lambda rows: int(t)
        if re.fullmatch(r"(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t):
            return lambda rows: float(t)
        if t.startswith("'") and t.endswith("'") and len(t) > 1:
            text = t[1:-1].replace("''", "'")
            return lambda rows: text
        raise UnsupportedPredicateError(f"{t!r} in a condition between variables of a stream")


def compiled(p: Predicate) -> Callable[[Mapping[str, Row]], bool]:
    """A condition of comparisons, IS NULL, arithmetic, AND, OR and NOT as a function of the variables' rows.

    As in the batch engine, a condition that is null is false, also below NOT; division by zero is null."""
    value = _Conditions(p.expr.tokens).whole()

    def test(rows: Mapping[str, Row]) -> bool:
        try:
            return value(rows) is True
        except TypeError:
            return False

    return test


@dataclass
class Matcher:
    """Partial matches of one partition; ``push`` takes rows in the order of time and ties and gives finished matches.

    ``waiting[k]`` holds the partial matches of k + 1 rows, in the order in which they came about."""

    query: Query
    strategy: str = NEXT_ROW
    waiting: list[list[tuple[int, tuple[Row, ...]]]] = field(default_factory=list)
    heads: int = 0

    def __post_init__(self) -> None:
        self.waiting = self.waiting or [[] for _ in self.query.variables[:-1]]
        self._bind()

    def _bind(self) -> None:
        self.tests = [[compiled(p) for p in self.query.completed_by(v)] for v in self.query.variables]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tests"}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._bind()

    def expire(self, before_us: int) -> None:
        """Forget partial matches that no row at or after this time can finish."""
        self.waiting = [[m for m in level if m[1][0]["__t"] + self.query.window_us >= before_us] for level in self.waiting]

    def push(self, row: Row, flags: Sequence[bool]) -> list[tuple[Row, ...]]:
        q, names, out = self.query, self.query.variables, []
        finished: set[int] = set()
        for k in range(len(names) - 1, 0, -1):
            level, kept = self.waiting[k - 1], []
            for head, rows in level:
                if row["__t"] - rows[0]["__t"] > q.window_us or head in finished:
                    continue
                taken = flags[k] and all(t(dict(zip(names, (*rows, row), strict=False))) for t in self.tests[k])
                if taken and k == len(names) - 1:
                    out.append((*rows, row))
                    if self.strategy == NEXT_ROW:
                        finished.add(head)
                        continue
                elif taken:
                    self.waiting[k].append((head, (*rows, row)))
                if self.strategy == STRICT or (taken and self.strategy == NEXT_MATCH):
                    continue
                kept.append((head, rows))
            self.waiting[k - 1] = kept
        if finished:
            self.waiting = [[m for m in level if m[0] not in finished] for level in self.waiting]
        if flags[0]:
            if len(names) == 1:
                out.append((row,))
            else:
                self.waiting[0].append((self.heads, (row,)))
            self.heads += 1
        return out


__all__ = ["ANY", "Matcher", "NEXT_MATCH", "NEXT_ROW", "STRICT", "compiled"]
