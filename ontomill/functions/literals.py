"""Typed literals as columns: casts by XSD datatype, facets, and data ranges compiled to predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ontomill.plans import expr as E
from ontomill.plans.expr import XSD, Node

#: Spark type of each XSD datatype's values; a datatype that isn't listed keeps its lexical form.
SPARK_TYPES = {
    **dict.fromkeys(("integer", "int", "long", "short", "byte", "nonNegativeInteger", "nonPositiveInteger", "positiveInteger", "negativeInteger", "unsignedInt", "unsignedLong"), "decimal(38,0)"),
    "decimal": "decimal(38,18)", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "dateTime": "timestamp", "time": "time", "gYear": "int",
}
#: Bounds of the integer types that have one.
SIGNS = {"nonNegativeInteger": ">= 0", "nonPositiveInteger": "<= 0", "positiveInteger": "> 0", "negativeInteger": "< 0"}


def seconds(lex: Column) -> Column:
    """An ISO 8601 day-time duration in seconds; null for anything else."""
    part = lambda unit, after: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(lex, rf"{after}(\d+(?:\.\d+)?){unit}", 1), F.lit("")), F.lit("999999999D999999999")), F.lit(0))
    total = part("D", "P.*?") * 86400 + part("H", "T.*?") * 3600 + part("M", "T.*?") * 60 + part("S", "T.*?")
    return F.when(lex.rlike(r"^-?P(?=.)(?:\d+D)?(?:T(?=.)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?$"), F.when(lex.startswith("-"), -total).otherwise(total))


def typed(lex: Column, datatype: str) -> Column:
    """The value of a lexical form, null where it isn't one of the datatype's; doubles are rounded to 15 decimals, floats to 7."""
    name = datatype.removeprefix(XSD)
    if not datatype.startswith(XSD):
        return lex
    if name == "duration":
        return seconds(lex)
    if name in ("gMonth", "gDay"):
        return F.regexp_extract(lex, r"(\d+)", 1).try_cast("int")
    if name in ("gYearMonth", "gMonthDay"):
        return lex
    kind = SPARK_TYPES.get(name)
    if kind is None:
        return lex
    value = lex.try_cast(kind)
    if name in ("double", "float"):
        value = F.round(value.cast("double"), 15 if name == "double" else 7)
    return F.when(F.expr("true") if name not in SIGNS else _signed(value, SIGNS[name]), value)


def _signed(value: Column, bound: str) -> Column:
    op, _ = bound.split()
    return {">=": value >= 0, "<=": value <= 0, ">": value > 0, "<": value < 0}[op]


@dataclass(frozen=True)
class Value:
    """How to get at a literal: its lexical form, its datatype (a column, or a name if all have one), and its value if it has a column."""

    lex: Column
    datatype: Column | str
    native: Column | None = None

    def of(self, datatype: str) -> Column:
        return self.native if self.native is not None else typed(self.lex, datatype)

    def is_a(self, datatype: str) -> Column:
        if datatype == E.ANY_LITERAL.iri:
            return F.lit(True)
        return F.lit(self.datatype == datatype) if isinstance(self.datatype, str) else self.datatype == datatype


def literal(lex: str, datatype: str) -> Column:
    return typed(F.lit(lex), datatype)


def _facet(v: Value, datatype: str, name: str, bound: str) -> Column:
    if name in (">=", ">", "<=", "<"):
        a, b = v.of(datatype), literal(bound, datatype)
        out = {">=": a >= b, ">": a > b, "<=": a <= b, "<": a < b}[name]
        # Spark orders NaN above all numbers; a literal that isn't a number compares with none
        return out & ~F.isnan(a) if datatype in (XSD + "double", XSD + "float") else out
    if name in ("length", "minLength", "maxLength"):
        n = F.char_length(v.lex)
        return {"length": n == int(bound), "minLength": n >= int(bound), "maxLength": n <= int(bound)}[name]
    if name == "pattern":
        return v.lex.rlike(f"^(?:{bound})$")
    if name == "totalDigits":
        return F.length(F.regexp_replace(v.lex, "[^0-9]", "")) <= int(bound)
    if name == "fractionDigits":
        return F.length(F.regexp_extract(v.lex, r"\.(.*)$", 1)) <= int(bound)
    raise ValueError(f"no facet is called {name}")


def predicate(r: Node, v: Value) -> Column:
    """Whether a literal lies in a data range; never null."""
    if isinstance(r, E.Datatype):
        out = v.is_a(r.iri)
    elif isinstance(r, E.Values):
        out = F.lit(False)
        for x in r.literals:
            same = v.of(x.datatype) == literal(x.lex, x.datatype) if v.native is None or v.datatype == x.datatype else F.lit(False)
            out = out | (v.is_a(x.datatype) & same)
    elif isinstance(r, E.Restricted):
        out = v.is_a(r.datatype)
        for name, bound in r.facets if not (isinstance(v.datatype, str) and v.datatype != r.datatype) else ():
            out = out & _facet(v, r.datatype, name, bound)
    elif isinstance(r, E.Not):
        return ~predicate(r.of, v)
    elif isinstance(r, E.And | E.Or):
        out = F.lit(isinstance(r, E.And))
        for part in r.of:
            out = out & predicate(part, v) if isinstance(r, E.And) else out | predicate(part, v)
    else:
        raise TypeError(f"not a data range: {r}")
    return F.coalesce(out, F.lit(False))
