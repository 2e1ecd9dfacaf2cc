"""Parsed sequence queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

ANY, NEXT_ROW, NEXT_MATCH, STRICT = "any_match", "next_row", "next_match", "strict"
STRATEGIES = (ANY, NEXT_ROW, NEXT_MATCH, STRICT)


class QueryError(ValueError):
    """A statement that is not understood."""


class UnsupportedPatternError(QueryError):
    """A pattern outside ``A x*? B y*? C`` and ``A B C``."""


class UnsupportedPredicateError(QueryError):
    """A condition with an aggregate, or one that cannot be split."""


@dataclass(frozen=True)
class Ref:
    """``var.column``"""

    var: str
    column: str


Token = str | Ref


@dataclass(frozen=True)
class Expr:
    """A scalar SQL expression: text tokens with references to variables' columns between them."""

    tokens: tuple[Token, ...]

    @property
    def refs(self) -> tuple[Ref, ...]:
        return tuple(t for t in self.tokens if isinstance(t, Ref))

    @property
    def vars(self) -> frozenset[str]:
        return frozenset(r.var for r in self.refs)

    def sql(self, name: Callable[[Ref], str]) -> str:
        """Spark SQL, with each reference as ``name`` gives it."""
        return " ".join(name(t) if isinstance(t, Ref) else t for t in self.tokens)


@dataclass(frozen=True)
class Predicate:
    """One conjunct.  ``left`` and ``right`` are set for a plain comparison ``left op right``."""

    expr: Expr
    left: Expr | None = None
    op: str | None = None
    right: Expr | None = None

    @property
    def vars(self) -> frozenset[str]:
        return self.expr.vars

    @property
    def is_equality(self) -> bool:
        """An equality whose sides each use one variable, and not the same."""
        return self.op == "=" and len(self.left.vars) == 1 and len(self.right.vars) == 1 and self.left.vars != self.right.vars

    def side(self, var: str) -> Expr:
        return self.left if self.left.vars == {var} else self.right


@dataclass(frozen=True)
class Query:
    """A sequence of single-row variables within a time window (microseconds, both ends included)."""

    table: str
    variables: tuple[str, ...]
    predicates: Mapping[str, tuple[Predicate, ...]]
    window_us: int
    time: str
    ties: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    measures: tuple[tuple[str, Expr], ...] = ()
    contiguous: bool = False
    skip: str = NEXT_ROW
    text: str = field(default="", compare=False)

    def __post_init__(self) -> None:
        if len(set(self.variables)) != len(self.variables):
            raise UnsupportedPatternError("a variable occurs twice")
        if not self.variables:
            raise UnsupportedPatternError("no variable")

    @property
    def all_predicates(self) -> list[Predicate]:
        return [p for v in self.variables for p in self.predicates.get(v, ())]

    def independent(self, var: str) -> list[Predicate]:
        """Conditions on ``var`` alone, wherever they were written."""
        return [p for p in self.all_predicates if p.vars == {var}]

    @property
    def constant(self) -> list[Predicate]:
        return [p for p in self.all_predicates if not p.vars]

    @property
    def dependent(self) -> list[Predicate]:
        return [p for p in self.all_predicates if len(p.vars) > 1]

    def completed_by(self, var: str) -> list[Predicate]:
        """Dependent conditions whose last variable is ``var``."""
        at = self.variables.index(var)
        return [p for p in self.dependent if max(self.variables.index(v) for v in p.vars) == at]

    def between(self, a: str, b: str) -> list[Predicate]:
        """Dependent conditions on just these two variables."""
        return [p for p in self.dependent if p.vars == {a, b}]

    def marker(self, var: str) -> str:
        """head, tail or middle."""
        at = self.variables.index(var)
        return "head" if at == 0 else "tail" if at == len(self.variables) - 1 else "middle"

    def precedes(self, a: str, b: str) -> bool:
        return self.variables.index(a) < self.variables.index(b)

    def projected(self, keep: list[str]) -> Query:
        """The query on a subset of its variables, in its order, with the conditions among them."""
        kept = tuple(v for v in self.variables if v in keep)
        predicates = {v: tuple(p for p in self.predicates.get(v, ()) if p.vars <= set(kept)) for v in kept}
        return Query(self.table, kept, predicates, self.window_us, self.time, self.ties, self.partition_by, (), self.contiguous, self.skip)

    def columns(self, var: str) -> list[str]:
        """Columns of ``var`` that conditions and measures use."""
        exprs = [p.expr for p in self.dependent] + [e for _, e in self.measures]
        return list(dict.fromkeys(r.column for e in exprs for r in e.refs if r.var == var))

    def describe(self) -> str:
        """The chain of states as text."""
        unit = f"{self.window_us} us"
        lines = [f"{'strict' if self.contiguous else 'skip'} sequence within {unit} by {self.time}" + (f", for each {', '.join(self.partition_by)}" if self.partition_by else "")]
        show = lambda r: f"{r.var}.{r.column}"
        for i, v in enumerate(self.variables):
            own = [p.expr.sql(show) for p in self.independent(v)]
            tied = [p.expr.sql(show) for p in self.completed_by(v)]
            lines.append(f"  {i}: {v} [{' AND '.join(own) or 'true'}]" + (f" with {' AND '.join(tied)}" if tied else ""))
        return "\n".join(lines)
