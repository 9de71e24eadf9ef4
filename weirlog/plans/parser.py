"""Rule texts: tokens, syntax trees, byte spans.

A program is a list of clauses `name : head :- body.`; a body holds atoms, negated atoms (`!`),
comparisons and `now(T)`. Variables begin with an ASCII capital, `_` is a wildcard, any other bare word
is a string constant but for true and false. Strings have no escapes. `#` begins a comment.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from functools import cached_property

from weirlog.types import RuleError


class SyntaxProblem(RuleError):
    """A text that is no program."""


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Constant:
    value: object

    @property
    def kind(self) -> str:
        return {bool: "bool", int: "int", float: "double", str: "string"}[type(self.value)]


@dataclass(frozen=True)
class Wildcard:
    pass


@dataclass(frozen=True)
class Aggregate:
    function: str
    variable: str


Term = Variable | Constant | Wildcard | Aggregate


@dataclass(frozen=True)
class Atom:
    predicate: str
    terms: tuple[Term, ...]
    negated: bool = False

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(t.name for t in self.terms if isinstance(t, Variable)))


@dataclass(frozen=True)
class Comparison:
    operator: str
    left: Term
    right: Term
    #: Further operands, as (sign, term), if the right side is a sum.
    rest: tuple[tuple[str, Term], ...] = ()

    @property
    def variables(self) -> list[str]:
        return [t.name for t in (self.left, self.right) if isinstance(t, Variable)]


@dataclass(frozen=True)
class Clock:
    term: Term


Literal = Atom | Comparison | Clock


@dataclass(frozen=True)
class Clause:
    name: str | None
    head: Atom
    body: tuple[Literal, ...]
    #: First and last byte of the clause in the UTF-8 text, half open.
    span: tuple[int, int] = (0, 0)

    @property
    def is_fact(self) -> bool:
        return not self.body

    @cached_property
    def text(self) -> str:
        return clause_text(self)

    def mapped(self, names) -> Clause:
        """The clause with predicates renamed."""
        body = tuple(replace(x, predicate=names(x.predicate)) if isinstance(x, Atom) else x for x in self.body)
        return replace(self, head=replace(self.head, predicate=names(self.head.predicate)), body=body)


AGGREGATES = ("count", "min", "max", "sum")
COMPARISONS = ("=<", ">=", "\\=", "<", ">", "=")
TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
      | "(?P<text>[^"]*)"
      | (?P<number>-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]*)?)
      | (?P<word>[^\W\d]\w*)
      | (?P<mark>:-|=<|>=|\\=|[,().!<>=:+-])""",
    re.X,
)


def number(text: str) -> int | float:
    """An exact 64-bit integer, or a finite double that is not rounded down to zero."""
    if not re.search("[.eE]", text):
        value = int(text)
        if not -(1 << 63) <= value < 1 << 63:
            raise SyntaxProblem(f"bad integer {text}")
        return value
    if not re.fullmatch(r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", text):
        raise SyntaxProblem(f"bad number {text}")
    real = float(text)
    if not math.isfinite(real) or real == 0 and re.search("[1-9]", re.split("[eE]", text)[0]):
        raise SyntaxProblem(f"{text} is beyond the range of a double")
    return real + 0.0


@dataclass(frozen=True)
class Token:
    kind: str
    value: object
    start: int
    end: int


def tokens(text: str) -> list[Token]:
    found, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem("unterminated string" if text[at] == '"' else f"unexpected character {text[at]!r}")
        kind = m.lastgroup
        if kind != "space":
            value = number(m["number"]) if kind == "number" else m[kind]
            found.append(Token(kind, value, m.start(), m.end()))
        at = m.end()
    return found


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.at = text, tokens(text), 0

    def mark(self, ahead: int = 0) -> str | None:
        """The punctuation that comes next, if it is one."""
        i = self.at + ahead
        return self.tokens[i].value if i < len(self.tokens) and self.tokens[i].kind == "mark" else None

    def word(self, ahead: int = 0) -> str | None:
        i = self.at + ahead
        return self.tokens[i].value if i < len(self.tokens) and self.tokens[i].kind == "word" else None

    def take(self) -> Token:
        if self.at == len(self.tokens):
            raise SyntaxProblem("unexpected end of text")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, mark: str) -> None:
        if self.mark() != mark:
            raise SyntaxProblem(f"expected {mark!r}, found {self.tokens[self.at].value if self.at < len(self.tokens) else 'the end'!r}")
        self.at += 1

    def accept(self, mark: str) -> bool:
        self.at += (met := self.mark() == mark)
        return met

    def program(self) -> list[Clause]:
        found = []
        while self.at < len(self.tokens):
            found.append(self.clause())
        return found

    def clause(self) -> Clause:
        start, name = self.tokens[self.at].start, None
        if self.word() is not None and self.mark(1) == ":":
            name = self.take().value
            self.take()
        head, body = self.atom(), ()
        if self.accept(":-"):
            literals = [self.literal()]
            while self.accept(","):
                literals.append(self.literal())
            body = tuple(literals)
        self.expect(".")
        if name is not None and not body:
            raise SyntaxProblem("a fact has no rule name")
        size = lambda stop: len(self.text[:stop].encode())
        return Clause(name, head, body, (size(start), size(self.tokens[self.at - 1].end)))

    def atom(self, negated: bool = False) -> Atom:
        token = self.take()
        if token.kind != "word":
            raise SyntaxProblem(f"expected a relation name, found {token.value!r}")
        return Atom(token.value, self.arguments(), negated)

    def arguments(self) -> tuple[Term, ...]:
        self.expect("(")
        if self.accept(")"):
            return ()  # no relation has this arity: the check refuses it
        terms = [self.term()]
        while self.accept(","):
            terms.append(self.term())
        self.expect(")")
        return tuple(terms)

    def literal(self) -> Literal:
        if self.accept("!"):
            return self.atom(negated=True)
        word = self.word()
        if word is not None and self.mark(1) == "(" and word not in AGGREGATES:
            self.take()
            if word != "now":
                return Atom(word, self.arguments())
            self.take()
            clock = Clock(self.term())
            self.expect(")")
            return clock
        left = self.term()
        if self.mark() not in COMPARISONS:
            raise SyntaxProblem("expected a comparison or an atom")
        operator, right, rest = self.take().value, self.term(), []
        while self.mark() in ("+", "-"):
            rest.append((self.take().value, self.term()))
        return Comparison(operator, left, right, tuple(rest))

    def term(self) -> Term:
        token = self.take()
        if token.kind in ("number", "text"):
            return Constant(token.value)
        if token.kind != "word":
            raise SyntaxProblem(f"expected a term, found {token.value!r}")
        word = token.value
        if word == "_":
            return Wildcard()
        if self.mark() == "(":
            if word not in AGGREGATES:
                raise SyntaxProblem(f"unknown function {word}")
            self.take()
            over = self.take()
            if over.kind != "word" or not is_variable(over.value):
                raise SyntaxProblem(f"{word} takes a variable")
            self.expect(")")
            return Aggregate(word, over.value)
        if word in ("true", "false"):
            return Constant(word == "true")
        return Variable(word) if is_variable(word) else Constant(word)


def is_variable(word: str) -> bool:
    return "A" <= word[0] <= "Z"


def parse(text: str) -> list[Clause]:
    """The clauses of a program text."""
    return _Reader(text).program()


def term_text(term: Term) -> str:
    if isinstance(term, Variable):
        return term.name
    if isinstance(term, Wildcard):
        return "_"
    if isinstance(term, Aggregate):
        return f"{term.function}({term.variable})"
    value = term.value
    if isinstance(value, bool):
        return "true" if value else "false"
    return f'"{value}"' if isinstance(value, str) else double_text(value) if isinstance(value, float) else str(value)


def double_text(value: float) -> str:
    """A decimal that reads back the same, with a point."""
    text = repr(value + 0.0)
    if "." in text:
        return text
    mantissa, mark, exponent = text.partition("e")
    return f"{mantissa}.0{mark}{exponent}"


def literal_text(x: Literal) -> str:
    if isinstance(x, Atom):
        return f"{'!' if x.negated else ''}{x.predicate}({', '.join(map(term_text, x.terms))})"
    if isinstance(x, Clock):
        return f"now({term_text(x.term)})"
    return f"{term_text(x.left)} {x.operator} {term_text(x.right)}" + "".join(f" {s} {term_text(t)}" for s, t in x.rest)


def clause_text(clause: Clause) -> str:
    """The clause in canonical form; parsing it gives the clause again."""
    name = f"{clause.name} : " if clause.name else ""
    body = " :- " + ", ".join(map(literal_text, clause.body)) if clause.body else ""
    return f"{name}{literal_text(clause.head)}{body}."
