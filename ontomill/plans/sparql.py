"""Class expressions as SPARQL queries, and as SQL over a triple graph's tables."""

from __future__ import annotations

from itertools import count

from ontomill.plans import expr as E
from ontomill.plans.expr import XSD, All, And, Card, Class, Datatype, HasSelf, Literal, Node, Not, OneOf, Or, Prop, Restricted, Some, Values

_FACETS = {"length": "STRLEN(STR({v})) = {x}", "minLength": "STRLEN(STR({v})) >= {x}", "maxLength": "STRLEN(STR({v})) <= {x}"}


class Sparql:
    """Writes graph patterns; every pattern binds its variable to individuals of the closed world."""

    def __init__(self) -> None:
        self.numbers = count(1)

    def fresh(self) -> str:
        return f"?s_{next(self.numbers)}"

    @staticmethod
    def literal(x: Literal) -> str:
        body = x.lex.replace("\\", "\\\\").replace('"', '\\"')
        return f'"{body}"^^<{x.datatype}>'

    @staticmethod
    def edge(s: str, p: Prop, o: str) -> str:
        return f"{o} <{p.iri}> {s} . " if p.inverse else f"{s} <{p.iri}> {o} . "

    @staticmethod
    def known(v: str) -> str:
        return f"{v} a <{E.OWL}NamedIndividual> . "

    def pattern(self, c: Node, v: str) -> str:
        if c == E.THING:
            return self.known(v)
        if c == E.NOTHING:
            return f"{self.known(v)}FILTER(false) "
        if isinstance(c, Class):
            return f"{v} a/<{E.RDFS}subClassOf>* <{c.iri}> . "
        if isinstance(c, And):
            return "".join(self.pattern(x, v) for x in c.of)
        if isinstance(c, Or):
            return " UNION ".join(f"{{ {self.pattern(x, v)}}}" for x in c.of) + " "
        if isinstance(c, Not):
            return f"{self.known(v)}FILTER NOT EXISTS {{ {self.pattern(c.of, v)}}} "
        if isinstance(c, OneOf):
            return f"VALUES {v} {{ {' '.join(f'<{i}>' for i in c.inds)} }} {self.known(v)}"
        if isinstance(c, HasSelf):
            return self.edge(v, c.prop, v)
        o = self.fresh()
        inner = (lambda: self.condition(c.filler, o)) if E.is_range(c.filler) else (lambda: "" if c.filler == E.THING else self.pattern(c.filler, o))
        if isinstance(c, Some):
            return self.edge(v, c.prop, o) + inner()
        if isinstance(c, All):
            filler = E.negate(c.filler)
            wrong = self.condition(filler, o) if E.is_range(c.filler) else self.pattern(filler, o)
            return f"{self.known(v)}FILTER NOT EXISTS {{ {self.edge(v, c.prop, o)}{wrong}}} "
        if isinstance(c, Card):
            having = {">=": f">= {c.n}", "=": f"= {c.n}", "<=": f"> {c.n}"}[c.op]
            if c.op == ">=" and c.n == 0:
                return self.known(v)
            if c.op == "=" and c.n == 0:
                having = "> 0"
            counted = f"{{ SELECT {v} WHERE {{ {self.edge(v, c.prop, o)}{inner()}}} GROUP BY {v} HAVING (COUNT(DISTINCT {o}) {having}) }} "
            return f"{self.known(v)}MINUS {counted}" if having[0:2] in ("> ",) else counted
        raise TypeError(f"not a class expression: {c}")

    def condition(self, r: Node, v: str) -> str:
        return f"FILTER({self.test(r, v)}) "

    def test(self, r: Node, v: str) -> str:
        if isinstance(r, Datatype):
            return f"isLiteral({v})" if r == E.ANY_LITERAL else f"DATATYPE({v}) = <{r.iri}>"
        if isinstance(r, Values):
            return f"{v} IN ({', '.join(map(self.literal, r.literals))})"
        if isinstance(r, Not):
            return f"!({self.test(r.of, v)})"
        if isinstance(r, And | Or):
            return (" && " if isinstance(r, And) else " || ").join(f"({self.test(x, v)})" for x in r.of)
        if isinstance(r, Restricted):
            return " && ".join([f"DATATYPE({v}) = <{r.datatype}>", *[self.facet(r.datatype, f, x, v) for f, x in r.facets]])
        raise TypeError(f"not a data range: {r}")

    def facet(self, datatype: str, name: str, x: str, v: str) -> str:
        if name in _FACETS:
            return _FACETS[name].format(v=v, x=int(x))
        if name == "pattern":
            return f'REGEX(STR({v}), "^(?:{x})$")'
        if name == "totalDigits":
            return f'STRLEN(REPLACE(STR({v}), "[^0-9]", "")) <= {int(x)}'
        if name == "fractionDigits":
            return f'STRLEN(STRAFTER(STR({v}), ".")) <= {int(x)}'
        return f"{v} {name} {self.literal(Literal(x, datatype))}"


def to_sparql(c: Node, variable: str = "?x", counted: bool = False, among: list[str] | None = None) -> str:
    """A query for an expression's instances, their number, or those among some names."""
    values = f"VALUES {variable} {{ {' '.join(f'<{i}>' for i in among)} }} " if among else ""
    head = f"(COUNT(DISTINCT {variable}) AS ?cnt)" if counted else f"DISTINCT {variable}"
    return f"SELECT {head} WHERE {{ {values}{Sparql().pattern(c, variable)}}}"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: SQL type of a datatype's values.
SQL_TYPES = {"integer": "DECIMAL(38,0)", "int": "DECIMAL(38,0)", "double": "DOUBLE", "float": "DOUBLE", "decimal": "DECIMAL(38,18)", "boolean": "BOOLEAN", "date": "DATE", "dateTime": "TIMESTAMP"}


class Sql:
    """Writes SQL over the tables ``universe(ind)``, ``types(cls, ind)``, ``links(p, s, o)`` and ``vals(p, s, lex, dt)``, which hold what is inherited too."""

    def query(self, c: Node) -> str:
        """A query whose column ``ind`` holds the distinct instances."""
        if c == E.THING:
            return "SELECT ind FROM universe"
        if c == E.NOTHING:
            return "SELECT ind FROM universe WHERE false"
        if isinstance(c, Class):
            return f"SELECT DISTINCT ind FROM types WHERE cls = {_text(c.iri)}"
        if isinstance(c, OneOf):
            return f"SELECT ind FROM universe WHERE ind IN ({', '.join(map(_text, c.inds))})"
        if isinstance(c, And):
            return " INTERSECT ".join(f"({self.query(x)})" for x in c.of)
        if isinstance(c, Or):
            return " UNION ".join(f"({self.query(x)})" for x in c.of)
        if isinstance(c, Not):
            return self.outside(self.query(c.of))
        if isinstance(c, HasSelf):
            return f"SELECT DISTINCT s AS ind FROM links WHERE p = {_text(c.prop.iri)} AND s = o"
        table, s, o, own = ("vals", "s", "lex, dt", "") if E.is_range(c.filler) else ("links", *(("o", "s") if c.prop.inverse else ("s", "o")), "")
        base = f"FROM {table} WHERE p = {_text(c.prop.iri)}"
        test = self.test(c.filler) if table == "vals" else "true" if c.filler == E.THING else f"{o} IN ({self.query(c.filler)})"
        if isinstance(c, Some):
            return f"SELECT DISTINCT {s} AS ind {base} AND ({test})"
        if isinstance(c, All):
            return self.outside(f"SELECT {s} AS ind {base} AND NOT ({test})")
        distinct = "count(DISTINCT (lex, dt))" if table == "vals" else f"count(DISTINCT {o})"
        grouped = lambda having: f"SELECT {s} AS ind {base} AND ({test}) GROUP BY {s} HAVING {distinct} {having}"
        if c.op == ">=":
            return self.query(E.THING) if c.n <= 0 else grouped(f">= {c.n}")
        if c.op == "=" and c.n > 0:
            return grouped(f"= {c.n}")
        return self.outside(grouped(f"> {c.n}"))

    @staticmethod
    def outside(query: str) -> str:
        return f"SELECT ind FROM universe u WHERE NOT EXISTS (SELECT 1 FROM ({query}) x WHERE x.ind = u.ind)"

    def test(self, r: Node) -> str:
        if isinstance(r, Datatype):
            return "true" if r == E.ANY_LITERAL else f"dt = {_text(r.iri)}"
        if isinstance(r, Values):
            return "(" + " OR ".join(f"(dt = {_text(x.datatype)} AND {self.value(x.datatype)} = {self.constant(x.lex, x.datatype)})" for x in r.literals) + ")"
        if isinstance(r, Not):
            return f"NOT coalesce({self.test(r.of)}, false)"
        if isinstance(r, And | Or):
            return "(" + (" AND " if isinstance(r, And) else " OR ").join(self.test(x) for x in r.of) + ")"
        if isinstance(r, Restricted):
            return "coalesce(" + " AND ".join([f"dt = {_text(r.datatype)}", *[self.facet(r.datatype, f, x) for f, x in r.facets]]) + ", false)"
        raise TypeError(f"not a data range: {r}")

    @staticmethod
    def value(datatype: str) -> str:
        kind = SQL_TYPES.get(datatype.removeprefix(XSD))
        return f"try_cast(lex AS {kind})" if kind else "lex"

    @staticmethod
    def constant(x: str, datatype: str) -> str:
        kind = SQL_TYPES.get(datatype.removeprefix(XSD))
        return f"cast({_text(x)} AS {kind})" if kind else _text(x)

    def facet(self, datatype: str, name: str, x: str) -> str:
        if name in ("length", "minLength", "maxLength"):
            return f"length(lex) {dict(length='=', minLength='>=', maxLength='<=')[name]} {int(x)}"
        if name == "pattern":
            return f"regexp_full_match(lex, {_text(x)})"
        if name == "totalDigits":
            return f"length(regexp_replace(lex, '[^0-9]', '', 'g')) <= {int(x)}"
        if name == "fractionDigits":
            return f"length(regexp_extract(lex, '\\.(.*)$', 1)) <= {int(x)}"
        return f"{self.value(datatype)} {name} {self.constant(x, datatype)}"


def to_sql(c: Node) -> str:
    return Sql().query(c)
