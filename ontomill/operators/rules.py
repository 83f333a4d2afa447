"""Horn rules over a triple graph: ``male(?x) ^ hasChild(?x, ?y) -> Father(?x)``.

A body is a conjunctive query: atoms over classes, properties and sameness become tables of their variables, joined on the
variables they share; built-ins become filters or new columns. Rules run to a fixpoint.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontomill.functions.literals import typed
from ontomill.plans.expr import XSD
from ontomill.plans.rounds import durable
from ontomill.sources.graphs import TripleGraph

_ATOM = re.compile(r"\s*([\w:#/.\-]+|<[^<>]+>)\s*\(((?:[^()\"]|\"(?:[^\"\\]|\\.)*\")*)\)\s*")


@dataclass(frozen=True)
class Atom:
    """A predicate's name and its arguments; variables begin with ``?``, literals are quoted or numbers."""

    name: str
    args: tuple[str, ...]

    def __str__(self) -> str:
        return f"{self.name}({', '.join(self.args)})"


@dataclass(frozen=True)
class Rule:
    body: tuple[Atom, ...]
    head: tuple[Atom, ...]

    def __str__(self) -> str:
        return f"{' ^ '.join(map(str, self.body))} -> {' ^ '.join(map(str, self.head))}"


def _atoms(text: str) -> tuple[Atom, ...]:
    out, at = [], 0
    while at < len(text):
        m = _ATOM.match(text, at)
        if not m:
            raise ValueError(f"can't read an atom at {text[at : at + 30]!r}")
        out.append(Atom(m[1].strip("<>"), tuple(a.strip().strip("<>") for a in re.findall(r'"(?:[^"\\]|\\.)*"(?:\^\^[\w:]+)?|[^,]+', m[2]))))
        at = m.end()
        if at < len(text):
            joint = re.compile(r"[\^∧,]").match(text, at)
            if not joint:
                raise ValueError(f"expected ^ at {text[at : at + 10]!r}")
            at = joint.end()
    return tuple(out)


def parse_rule(text: str) -> Rule:
    body, arrow, head = re.sub("→", "->", text).partition("->")
    if not arrow:
        raise ValueError("a rule has an arrow")
    return Rule(_atoms(body.strip()), _atoms(head.strip()))


def _num(c: Column) -> Column:
    """The number that a value stands for; null for a text, and for a value that is no number."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n), n)


def _compared(test: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """Numbers as numbers, texts as texts; a number and a text don't compare."""
    def out(a: Column, b: Column) -> Column:
        x, y = _num(a), _num(b)
        return F.when(x.isNotNull() & y.isNotNull(), test(x, y)).when(x.isNull() & y.isNull(), test(a, b)).otherwise(False)

    return out


#: Built-ins that test their arguments.
TESTS: dict[str, Callable[..., Column]] = {
    "equal": _compared(lambda a, b: a == b), "notEqual": lambda a, b: ~_compared(lambda x, y: x == y)(a, b),
    "lessThan": _compared(lambda a, b: a < b), "lessThanOrEqual": _compared(lambda a, b: a <= b), "greaterThan": _compared(lambda a, b: a > b), "greaterThanOrEqual": _compared(lambda a, b: a >= b),
    "contains": F.contains, "containsIgnoreCase": lambda a, b: F.contains(F.lower(a), F.lower(b)), "startsWith": F.startswith, "endsWith": F.endswith, "stringEqualIgnoreCase": lambda a, b: F.lower(a) == F.lower(b), "matches": F.rlike,
    "isNumeric": lambda a: _num(a).isNotNull(), "isInteger": lambda a: a.rlike(r"^[+-]?\d+$"), "isFloat": lambda a: a.rlike(r"^[+-]?\d*\.\d+"), "isString": lambda a: _num(a).isNull(), "isDate": lambda a: a.try_cast("date").isNotNull(), "isBoolean": lambda a: F.lower(a).isin("true", "false"),
}
#: Built-ins whose first argument is the result of the others.
RESULTS: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: _num(a) + _num(b), "subtract": lambda a, b: _num(a) - _num(b), "multiply": lambda a, b: _num(a) * _num(b), "divide": lambda a, b: F.try_divide(_num(a), _num(b)), "mod": lambda a, b: F.try_mod(_num(a), _num(b)), "pow": lambda a, b: F.pow(_num(a), _num(b)),
    "abs": lambda a: F.abs(_num(a)), "round": lambda a: F.round(_num(a)), "floor": lambda a: F.floor(_num(a)), "ceiling": lambda a: F.ceil(_num(a)), "unaryMinus": lambda a: -_num(a),
    "stringConcat": lambda *xs: F.concat(*xs), "substring": lambda a, b: F.substring(a, b.cast("int") + 1, F.length(a)), "stringLength": F.char_length, "upperCase": F.upper, "lowerCase": F.lower, "normalizeSpace": lambda a: F.trim(F.regexp_replace(a, r"\s+", " ")), "replace": lambda a, b, c: F.regexp_replace(a, b, c),
    "year": lambda a: F.year(a.try_cast("timestamp")), "month": lambda a: F.month(a.try_cast("timestamp")), "day": lambda a: F.dayofmonth(a.try_cast("timestamp")), "hour": lambda a: F.hour(a.try_cast("timestamp")), "minute": lambda a: F.minute(a.try_cast("timestamp")), "second": lambda a: F.second(a.try_cast("timestamp")),
    "addDayTimeDuration": lambda a, b: F.from_unixtime(F.unix_timestamp(a.try_cast("timestamp")) + typed(b, XSD + "duration").cast("long"), "yyyy-MM-dd'T'HH:mm:ss"), "subtractDateTimes": lambda a, b: F.unix_timestamp(a.try_cast("timestamp")) - F.unix_timestamp(b.try_cast("timestamp")),
}


def _value(arg: str) -> Column:
    """A variable's column or a constant."""
    if arg.startswith("?"):
        return F.col(arg[1:])
    m = re.fullmatch(r'"((?:[^"\\]|\\.)*)"(?:\^\^[\w:]+)?', arg)
    return F.lit(re.sub(r"\\(.)", r"\1", m[1]) if m else arg)


class RuleEngine:
    """Evaluates rules; short names are put behind ``namespace``."""

    def __init__(self, graph: TripleGraph, namespace: str = ""):
        self.graph, self.ns = graph, namespace
        self.types = durable(graph.table("class_assertion").select("cls", "ind").distinct())
        data = graph.table("data_assertion").select("p", "s", F.col("lex").alias("o"))
        self.links = durable(graph.table("obj_assertion").select("p", "s", "o").unionAll(data).distinct())

    def full(self, name: str) -> str:
        return name if "://" in name or name.startswith("urn:") else self.ns + name

    def _constant(self, arg: str) -> str:
        plain = arg[0] in '"+-' or arg[0].isdigit() or arg in ("true", "false")
        return re.sub(r'^"|"(\^\^[\w:]+)?$', "", arg) if plain else self.full(arg)

    def table(self, atom: Atom) -> DataFrame:
        """The atom's variables as columns; a constant is a filter, a repeated variable an equality."""
        if atom.name in ("sameAs", "differentFrom"):
            t = self.graph.table("same_as" if atom.name == "sameAs" else "different_from").select("a", "b")
            rows, columns = t.unionAll(t.select("b", "a")).distinct(), ("a", "b")
        elif len(atom.args) == 1:
            below = self.graph.below("sub_class", self.full(atom.name))
            rows, columns = self.types.join(below, F.col("cls") == F.col("sub"), "left_semi"), ("ind",)
        else:
            rows, columns = self.links.where(F.col("p") == self.full(atom.name)), ("s", "o")
        out, seen = [], {}
        for arg, c in zip(atom.args, columns, strict=True):
            if not arg.startswith("?"):
                rows = rows.where(F.col(c) == self._constant(arg))
            elif arg in seen:
                rows = rows.where(F.col(c) == F.col(seen[arg]))
            else:
                seen[arg] = c
                out.append(F.col(c).alias(arg[1:]))
        return rows.select(*out).distinct() if out else rows.select(F.lit(True).alias("__holds")).limit(1)

    def matches(self, rule: Rule) -> DataFrame:
        """The distinct bindings of a body's variables."""
        plain = [a for a in rule.body if a.name.removeprefix("swrlb:") not in TESTS | RESULTS]
        built = [a for a in rule.body if a not in plain]
        rest = [self.table(a) for a in plain]
        if not rest:
            raise ValueError("a body needs an atom over a class or a property")
        out = rest.pop(0)
        while rest:
            # the next atom shares a variable if any does, so no product is formed that the rule doesn't ask for
            k = next((i for i, t in enumerate(rest) if set(t.columns) & set(out.columns)), None)
            if k is None:
                if "__holds" in rest[0].columns:
                    out = out.join(F.broadcast(rest.pop(0)), F.lit(True), "left_semi")
                    continue
                raise ValueError("the atoms of a body are to be connected by variables")
            t = rest.pop(k)
            out = out.join(t, [c for c in t.columns if c in out.columns])
        for atom in sorted(built, key=lambda a: a.name.removeprefix("swrlb:") in TESTS):
            name = atom.name.removeprefix("swrlb:")
            if name in TESTS:
                out = out.where(TESTS[name](*map(_value, atom.args)))
            else:
                value = RESULTS[name](*map(_value, atom.args[1:])).cast("string")
                target = atom.args[0]
                out = out.where(_value(target) == value) if not target.startswith("?") or target[1:] in out.columns else out.withColumn(target[1:], value)
        return out

    def heads(self, rule: Rule) -> tuple[list[DataFrame], list[DataFrame]]:
        found, types, links = self.matches(rule), [], []
        term = lambda arg: F.col(arg[1:]) if arg.startswith("?") else F.lit(self._constant(arg))
        for atom in rule.head:
            if len(atom.args) == 1:
                types.append(found.select(F.lit(self.full(atom.name)).alias("cls"), term(atom.args[0]).alias("ind")))
            else:
                links.append(found.select(F.lit(self.full(atom.name)).alias("p"), term(atom.args[0]).alias("s"), term(atom.args[1]).alias("o")))
        return types, links

    def run(self, rules: list[Rule], max_rounds: int = 30) -> tuple[DataFrame, DataFrame]:
        """Class assertions and links that follow and weren't known, with all rules applied until nothing is new."""
        known_types, known_links = self.types, self.links
        for _ in range(max_rounds):
            types, links = [], []
            for rule in rules:
                t, p = self.heads(rule)
                types, links = types + t, links + p
            new = False
            for name, frames, keys in (("types", types, ["cls", "ind"]), ("links", links, ["p", "s", "o"])):
                if frames:
                    every = frames[0]
                    for f in frames[1:]:
                        every = every.unionAll(f)
                    # a built-in without a result (a division by zero, a text taken for a number) gives no statement
                    fresh = durable(every.dropna().distinct().join(getattr(self, name), keys, "left_anti"))
                    if not fresh.isEmpty():
                        new = True
                        setattr(self, name, durable(getattr(self, name).unionAll(fresh)))
            if not new:
                return self.types.join(known_types, ["cls", "ind"], "left_anti"), self.links.join(known_links, ["p", "s", "o"], "left_anti")
        raise RuntimeError("rules did not settle")
