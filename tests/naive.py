"""Class expressions over Python sets, as a second opinion."""

import datetime
import math
import re

from ontomill.plans import expr as E


def value(lex, dt):
    kind = dt.removeprefix(E.XSD)
    try:
        if kind == "integer":
            return int(lex)
        if kind == "double":
            return round(float(lex), 15)
        if kind == "date":
            return datetime.date.fromisoformat(lex)
        if kind == "boolean":
            return lex == "true"
    except ValueError:
        return None
    return lex


def holds(r, lex, dt):
    if isinstance(r, E.Datatype):
        return r == E.ANY_LITERAL or r.iri == dt
    if isinstance(r, E.Values):
        return any(x.datatype == dt and value(lex, dt) == value(x.lex, dt) for x in r.literals)
    if isinstance(r, E.Not):
        return not holds(r.of, lex, dt)
    if isinstance(r, E.And | E.Or):
        return (all if isinstance(r, E.And) else any)(holds(x, lex, dt) for x in r.of)
    v = value(lex, dt)
    if dt != r.datatype or v is None:
        return False
    for name, x in r.facets:
        if name in ("<", "<=", ">", ">="):
            b = value(x, dt)
            if isinstance(v, float) and math.isnan(v) or not {"<": v < b, "<=": v <= b, ">": v > b, ">=": v >= b}[name]:
                return False
        elif name == "pattern":
            if not re.fullmatch(x, lex):
                return False
        elif not {"length": len(lex) == int(x), "minLength": len(lex) >= int(x), "maxLength": len(lex) <= int(x)}[name]:
            return False
    return True


class Naive:
    def __init__(self, inds, types, links, values):
        """types: (cls, ind), links: (p, s, o), values: (p, s, lex, dt), all with what is inherited."""
        self.u, self.types, self.links, self.values = set(inds), types, links, values

    def __call__(self, c):
        if c == E.THING:
            return set(self.u)
        if c == E.NOTHING:
            return set()
        if isinstance(c, E.Class):
            return {i for k, i in self.types if k == c.iri}
        if isinstance(c, E.OneOf):
            return set(c.inds) & self.u
        if isinstance(c, E.Not):
            return self.u - self(c.of)
        if isinstance(c, E.And | E.Or):
            sets = list(map(self, c.of))
            return set.intersection(*sets) if isinstance(c, E.And) else set.union(*sets)
        if isinstance(c, E.HasSelf):
            return {s for p, s, o in self.links if p == c.prop.iri and s == o}
        if E.is_range(c.filler):
            pairs = {(s, (lex, dt)) for p, s, lex, dt in self.values if p == c.prop.iri}
            good = {(s, x) for s, x in pairs if holds(c.filler, *x)}
        else:
            f = self(c.filler)
            pairs = {(o, s) if c.prop.inverse else (s, o) for p, s, o in self.links if p == c.prop.iri}
            good = {(s, o) for s, o in pairs if o in f}
        if isinstance(c, E.Some):
            return {s for s, _ in good}
        if isinstance(c, E.All):
            return self.u - {s for s, _ in pairs - good}
        n = {i: sum(s == i for s, _ in good) for i in self.u}
        return {i for i, k in n.items() if {">=": k >= c.n, "<=": k <= c.n, "=": k == c.n}[c.op]}
