"""Rule-based materialisation: the OWL 2 RL consequences of a triple graph, by joins to a fixpoint.

Sound and, for the RL profile's rules listed here, complete; there is no reasoning by cases and there are no unnamed
individuals. What follows from one statement alone (sub-properties, inverses, symmetry, subclasses, domains, ranges) is closed
in the schema, once, and is looked up row by row; only rules over two statements and more (chains, transitive and functional
properties, sameness) run in rounds, semi-naive. No type gives a link, so types come after the links have settled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.plans import expr as E
from ontomill.plans.graph import HELD, connected_components, transitive_closure
from ontomill.operators.retrieval import Reasoner
from ontomill.plans.rounds import dealt, durable, maybe_broadcast, stored
from ontomill.operators.schema import Schema
from ontomill.plans.syntax import parse_dl
from ontomill.sources.graphs import SMALL, SMALL_CLOSURE, TripleGraph, closed_pairs

TYPES, LINKS = ["cls", "ind"], ["p", "s", "o"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames).distinct()


class _Schema:
    """What one statement says: ``turn`` the links that follow from a link (p to q, turned round or not), ``means`` the classes that follow.

    ``turns`` holds the same as ``turn`` by property if the schema is small, else None.
    """

    def __init__(self, graph: TripleGraph):
        t = graph.tables
        inv = t["inverse_prop"].select("p", "q")
        both = inv.unionAll(inv.select("q", "p")).unionAll(t["characteristic"].where("name = 'SymmetricProperty'").select("p", "p")).where("p is not null and q is not null")
        ends = t["domain"].select("p", "cls", F.lit(">").alias("end")).unionAll(t["range"].select("p", "cls", F.lit("<"))).where("p is not null and cls is not null")
        self.turns: dict[str, set[tuple[str, bool]]] | None = None
        self.spoken: list[str] | None = None
        graph.closure("sub_class"), graph.closure("sub_prop")
        above, below = (graph._pairs_of[(name, graph.version)] for name in ("sub_class", "sub_prop"))  # noqa: SLF001
        rows = [df.limit(SMALL + 1).collect() for df in (both, ends)]
        if above is None or below is None or max(map(len, rows)) > SMALL or not self._held(graph, above, below, *rows):
            self._joined(graph, both, ends)

    def _held(self, graph: TripleGraph, above: set, below: set, both: list, ends: list) -> bool:
        """A small schema is closed on the driver; False if its closure is too large."""
        pairs = closed_pairs([(x + a, x + b) for a, b in below for x in "+-"] + [(x + p, y + q) for p, q in both for x, y in ("+-", "-+")])
        if pairs is None:
            return False
        self.turns = {}
        for a, b in pairs:
            if a[0] == "+" and a != b:
                self.turns.setdefault(a[1:], set()).add((b[1:], b[0] == "-"))
        over: dict[str, set[str]] = {}
        for a, b in above:
            over.setdefault(a, set()).add(b)
        said: dict[tuple[str, str], set[str]] = {}
        for p, cls, end in ends:
            said.setdefault((end, p), set()).update({cls, *over.get(cls, ())})
        means = {"=" + a: set(b) for a, b in over.items()}
        lower: dict[str, set[tuple[str, bool]]] = {}
        for of, to in self.turns.items():
            for q, flip in to:
                lower.setdefault(q, set()).add((of, flip))
        under: dict[str, set[str]] = {}
        for a, b in below:
            under.setdefault(b, set()).add(a)
        for (end, p), classes in said.items():
            for of, flip in {(p, False), *lower.get(p, ())}:
                means.setdefault(("<" if end == ">" else ">") + of if flip else end + of, set()).update(classes)
            for of in {p, *under.get(p, ())} if end == ">" else ():
                means.setdefault("." + of, set()).update(classes)
        if sum(map(len, means.values())) > SMALL_CLOSURE:
            self.turns = None
            return False
        self.turn = F.broadcast(graph.spark.createDataFrame([(p, sorted(to)) for p, to in sorted(self.turns.items())], "of string, to array<struct<p: string, flip: boolean>>"))
        self.means = F.broadcast(graph.spark.createDataFrame([(k, sorted(v)) for k, v in sorted(means.items())], "token string, classes array<string>"))
        self.spoken = sorted({k[1:] for k in means if k[0] != "="})
        return True

    def _joined(self, graph: TripleGraph, both: DataFrame, ends: DataFrame) -> None:
        """The same by joins, for a schema of any size."""
        up = graph.schema_edges("sub_prop").select("sub", "sup")
        signed = lambda df, a, b, *signs: [df.select(F.concat(F.lit(x), a).alias("sub"), F.concat(F.lit(y), b).alias("sup")) for x, y in signs]
        edges = reduce(DataFrame.unionAll, [*signed(up, "sub", "sup", "++", "--"), *signed(both, "p", "q", "+-", "-+")])
        found = transitive_closure(edges, "sub", "sup").where("sub like '+%' and sub <> sup")
        self.turn = durable(found.groupBy(F.expr("substring(sub, 2)").alias("of")).agg(F.collect_set(F.struct(F.expr("substring(sup, 2)").alias("p"), F.col("sup").startswith("-").alias("flip"))).alias("to")))
        above = graph.closure("sub_class").select("sub", "sup")
        ends = ends.unionAll(ends.join(above, F.col("cls") == F.col("sub")).select("p", F.col("sup"), "end")).distinct()
        other = F.when(F.col("flip"), F.translate("end", "<>", "><")).otherwise(F.col("end"))
        tokens = [ends.select(F.concat("end", "p").alias("token"), "cls"), self.turn.select("of", F.inline("to")).join(ends, "p").select(F.concat(other, "of"), "cls")]
        values = ends.where("end = '>'").select("p", "cls")
        below = graph.closure("sub_prop").select(F.col("sub").alias("of"), F.col("sup").alias("p"))
        tokens += [values.select(F.concat(F.lit("."), "p"), "cls"), below.join(values, "p").select(F.concat(F.lit("."), "of"), "cls")]
        tokens.append(above.select(F.concat(F.lit("="), "sub"), "sup"))
        self.means = durable(reduce(DataFrame.unionAll, tokens).groupBy("token").agg(F.collect_set("cls").alias("classes")))

    def closed(self, links: DataFrame, props: list[str] | None = None) -> DataFrame:
        """Links and all that each gives by itself, with repeats; of the given properties alone if there are any."""
        if props is not None and self.turns is not None:
            links = links.where(F.col("p").isin(*{*props, *(p for p, to in self.turns.items() if any(q in props for q, _ in to))}))
        own = F.array(F.struct(F.col("p"), F.lit(False).alias("flip")))
        each = links.join(self.turn, F.col("p") == F.col("of"), "left").select("s", "o", F.explode(F.when(F.col("to").isNull(), own).otherwise(F.concat(own, "to"))).alias("t"))
        out = each.select(F.col("t.p").alias("p"), F.when(F.col("t.flip"), F.col("o")).otherwise(F.col("s")).alias("s"), F.when(F.col("t.flip"), F.col("s")).otherwise(F.col("o")).alias("o"))
        return out if props is None else out.where(F.col("p").isin(*props))

    def classes(self, types: DataFrame, links: DataFrame, data: DataFrame, up: DataFrame | None = None) -> DataFrame:
        """``cls, ind``, distinct: stated classes, those above them, and those that links and values say of their ends.

        An individual's classes follow from the set of what is said of it. There are few such sets, so the classes of each set are
        found once and looked up: classes are never sorted or compared individual by individual. ``up`` (node, root) tells
        individuals that are the same, of which the same is said.
        """
        said, values = links, data
        if self.spoken is not None:
            said, values = (x.where(F.col("p").isin(*self.spoken)) for x in (links, data))
        tell = lambda df, mark, of, ind: df.select(F.concat(F.lit(mark), of).alias("token"), F.col(ind).alias("ind"))
        rows = reduce(DataFrame.unionAll, [tell(types, "=", "cls", "ind"), tell(said, ">", "p", "s"), tell(said, "<", "p", "o"), tell(values, ".", "p", "s")])
        n = types.count() + 2 * said.count() + values.count()
        rows = rows.where("token is not null and ind is not null")
        if up is not None:  # few are the same as others: what is said of them alone is copied, before all is dealt once
            of_root = rows.join(up, F.col("ind") == F.col("node")).select("token", "root").distinct()
            rows = rows.unionAll(of_root.join(up, "root").select("token", "node"))
        rows = dealt(rows, n, "ind").distinct()
        met = stored(rows.groupBy("ind").agg(F.sort_array(F.collect_set("token")).alias("tokens")))
        sets = met.select("tokens").distinct()
        own = F.when(F.col("token").startswith("="), F.array(F.expr("substring(token, 2)"))).otherwise(F.array().cast("array<string>"))
        each = sets.select("tokens", F.explode("tokens").alias("token")).join(self.means, "token", "left")
        each = each.select("tokens", F.explode(F.concat(own, F.coalesce("classes", F.array().cast("array<string>")))).alias("cls"))
        known = stored(each.groupBy("tokens").agg(F.collect_set("cls").alias("classes")))
        size = known.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens") + F.size("classes")), F.lit(0))).first()
        return met.join(maybe_broadcast(known, size[0] + size[1], 120), "tokens").select(F.explode("classes").alias("cls"), "ind")


def materialise(graph: TripleGraph, max_rounds: int = 50) -> TripleGraph:
    """The graph with inferred class assertions, links, and same-as pairs.

    Rules: subclasses (also of expressions that can only grow), sub-properties, equivalences, inverses, symmetric and transitive properties, chains, domains and ranges,
    functional and inverse functional properties (individuals become the same), and replacement of same individuals.
    """
    t, schema = graph.tables, _Schema(graph)
    up_prop = graph.closure("sub_prop")
    data = t["data_assertion"].select("p", "s", "lex", "dt")
    data = data.unionAll(data.join(up_prop, data["p"] == up_prop["sub"]).select(F.col("sup").alias("p"), "s", "lex", "dt")).distinct()
    marked = _marked(graph, "TransitiveProperty", "FunctionalProperty", "InverseFunctionalProperty")
    chains, rules = [(r.p, list(r.chain)) for r in graph.table("prop_chain").collect()], complex_rules(graph)
    same = t["same_as"].select("a", "b")
    sure = any(not isinstance(marked[k], list) or marked[k] for k in ("FunctionalProperty", "InverseFunctionalProperty")) or not same.isEmpty()
    # links: what is stated and what rounds add; whatever a link gives by itself is looked up when it is read
    base = t["obj_assertion"].select(*LINKS)
    new, known_same, up, first = base, -1, None, True
    for _ in range(max_rounds):
        fresh = None if first or schema.turns is None else {r.p for r in new.select("p").distinct().limit(SMALL).collect()}
        fresh = None if fresh is None or len(fresh) == SMALL else fresh | {q for p in fresh for q, _ in schema.turns.get(p, ())}
        found = [*_transitive(schema, new, base, marked["TransitiveProperty"], fresh, first), *_chains(schema, chains, new, base, fresh, first)]
        heads = [*marked["TransitiveProperty"], *(p for p, _ in chains)] if isinstance(marked["TransitiveProperty"], list) else None
        # what is known already is looked for among links of the properties that rounds give, and of the same individuals
        known = [schema.closed(base, heads)] if found else []
        if sure:
            every, recent = schema.closed(base), schema.closed(new)
            same = stored(_union([same, *_functional(every, recent, marked["FunctionalProperty"], "s", "o"), *_functional(every, recent, marked["InverseFunctionalProperty"], "o", "s")]))
            now = same.count()
            # links are copied over the same individuals: what is new, or, when more have become the same, all
            if now:
                if now != known_same:
                    up, same = _groups(same, now)
                found += _copied(base if now != known_same else new, up)
                known += [schema.closed(base.join(up.select("node"), F.col(end) == F.col("node"), "left_semi")) for end in "so"]
                known_same = same.count()
        if not found:
            break
        made = reduce(DataFrame.unionAll, found).distinct()
        new = stored(made.join(reduce(DataFrame.unionAll, known), LINKS, "left_anti"))
        if new.isEmpty():
            break
        base, first = base.unionAll(new), False
    else:
        raise RuntimeError("materialisation did not settle")
    n = schema.closed(base).count()
    links = dealt(schema.closed(base), n, *LINKS).distinct()
    types = _types(graph, schema, rules, base, links, data, up, max_rounds)
    inds = reduce(DataFrame.unionAll, [graph.table("individuals").select("ind"), types.select("ind"), base.select("s"), base.select("o"), data.select("s")])
    out = graph.replaced(individuals=dealt(inds, 2 * n, "ind").distinct(), class_assertion=types, obj_assertion=links, data_assertion=data, same_as=same)
    out.complete = True
    return out


def _types(graph: TripleGraph, schema: _Schema, rules: list, base: DataFrame, links: DataFrame, data: DataFrame, up: DataFrame | None, max_rounds: int) -> DataFrame:
    """All class assertions, after the links have settled: in one pass, or in rounds where expressions give classes."""
    t = graph.tables
    types = schema.classes(t["class_assertion"].select(*TYPES), base, t["data_assertion"].select("p", "s"), up)
    if not rules:
        return types
    none = graph.spark.createDataFrame([], "p string, s string, o string")
    types, links = stored(types), stored(links)
    for _ in range(max_rounds):
        given = stored(_union([known.select(F.lit(sup).alias("cls"), "ind") for sup, known in _complex(graph, rules, types, links, data)]))
        new = stored(schema.classes(given, none, none, up).join(types, TYPES, "left_anti"))
        if new.isEmpty():
            return types
        types = stored(types.unionAll(new))
    raise RuntimeError("materialisation did not settle")


def _marked(graph: TripleGraph, *names: str) -> dict[str, list[str] | DataFrame]:
    """The properties of each characteristic, as a list if there are few, else as a column ``m``."""
    said = graph.table("characteristic").where(F.col("name").isin(*names)).select("p", "name")
    rows = said.limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        return {k: said.where(F.col("name") == k).select(F.col("p").alias("m")) for k in names}
    return {k: sorted({r.p for r in rows if r.name == k}) for k in names}


def _of(links: DataFrame, props: list[str] | DataFrame) -> DataFrame:
    return links.where(F.col("p").isin(*props)) if isinstance(props, list) else links.join(props, F.col("p") == F.col("m"), "left_semi")


def _transitive(schema: _Schema, new: DataFrame, base: DataFrame, props: list[str] | DataFrame, fresh: set[str] | None, first: bool) -> list[DataFrame]:
    """New paths of two links over a transitive property, one of them new.

    Only links that begin where another ends can be second; these are picked first, so that a hub's many links are joined with
    the few that go on from it.
    """
    if isinstance(props, list):
        props = [p for p in props if fresh is None or p in fresh]
        if not props:
            return []
        a, b = schema.closed(new, props), schema.closed(base, props)
    else:
        a, b = _of(schema.closed(new), props), _of(schema.closed(base), props)
    out = []
    for left, right in ((a, b),) if first else ((a, b), (b, a)):
        ends = stored(left.select("p", F.col("o").alias("x")).distinct())
        second = stored(right.select("p", F.col("s").alias("x"), "o").join(maybe_broadcast(ends, ends.count(), 160), ["p", "x"], "left_semi").distinct())
        n = second.count()
        if n:
            out.append(left.select("p", "s", F.col("o").alias("x")).join(maybe_broadcast(second, n, 240), ["p", "x"]).select(*LINKS))
    return out


def _chains(schema: _Schema, chains: list[tuple[str, list[str]]], new: DataFrame, base: DataFrame, fresh: set[str] | None, first: bool) -> list[DataFrame]:
    """Links that property chains give over at least one new link; the chains are schema, a join for each step of each.

    A step may be an inverse property, marked with ``^``.
    """
    def step(table: DataFrame, q: str, i: int) -> DataFrame:
        ends = ("o", "s") if q.startswith("^") else ("s", "o")
        return schema.closed(table, [q.lstrip("^")]).select(F.col(ends[0]).alias(f"n{i}"), F.col(ends[1]).alias(f"n{i + 1}"))

    out = []
    for p, chain in chains:
        for at in range(1 if first else len(chain)):  # in the first round all links are new
            if fresh is not None and chain[at].lstrip("^") not in fresh:
                continue
            path = None
            for i, q in enumerate(chain):
                part = step(new if i == at else base, q, i)
                path = part if path is None else path.join(part, f"n{i}").select("n0", f"n{i + 1}").distinct()
            out.append(path.select(F.lit(p).alias("p"), F.col("n0").alias("s"), F.col(f"n{len(chain)}").alias("o")))
    return out


def complex_rules(graph: TripleGraph) -> list[tuple[E.Node, str]]:
    """(expression, class): stated axioms from which an expression's instances are in a named class.

    Only expressions without complements, universals and upper bounds: what they hold of can only grow, so rounds of joins are sound.
    """
    out = []
    for r in graph.table("complex_axiom").where(F.col("kind").isin("SubClassOf", "EquivalentClasses")).collect():
        parts = [parse_dl(x) for x in r.args]
        pairs = [(parts[0], parts[1])] if r.kind == "SubClassOf" else [(a, b) for a in parts for b in parts if a is not b]
        out += [(a, b.iri) for a, b in pairs if isinstance(b, E.Class) and not isinstance(a, E.Class) and grows(a)]
    return out


def grows(c: E.Node) -> bool:
    """Whether more statements can only give an expression more instances."""
    if E.is_range(c):
        return True
    return not isinstance(c, E.Not | E.All) and not (isinstance(c, E.Card) and c.op != ">=") and all(map(grows, E.children(c)))


def _complex(graph: TripleGraph, rules: list[tuple[E.Node, str]], types: DataFrame, links: DataFrame, data: DataFrame) -> list[tuple[str, DataFrame]]:
    if not rules:
        return []
    r = Reasoner(graph.replaced(class_assertion=types, obj_assertion=links, data_assertion=data), subs=False)
    return [(sup, r.instances(c)) for c, sup in rules]


def _functional(links: DataFrame, new: DataFrame, props: list[str] | DataFrame, key: str, value: str) -> list[DataFrame]:
    """Pairs of values that a functional property makes the same: each with the least of its key, so a key gives no square.

    Only keys that a new link touches are looked at.
    """
    if isinstance(props, list) and not props:
        return []
    touched = _of(new, props).select("p", key).distinct()
    own = links.join(touched, ["p", key], "left_semi")
    least = own.groupBy("p", F.col(key).alias("k")).agg(F.min(value).alias("a"), F.max(value).alias("z")).where("a <> z")
    pairs = own.join(least.withColumnRenamed("p", "lp"), (F.col("p") == F.col("lp")) & (F.col(key) == F.col("k"))).where(F.col(value) != F.col("a"))
    return [pairs.select("a", F.col(value).alias("b"))]


def _groups(same: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """``node, root`` of the groups of same individuals, and the pairs of each least one with the others."""
    parts = stored(connected_components(same, "a", "b", at_once=HELD))
    return maybe_broadcast(parts, 2 * rows, 160), parts.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def _copied(links: DataFrame, up: DataFrame) -> list[DataFrame]:
    """Links copied to the least of each group of same individuals and back to its members."""
    s_up = links.join(up, links["s"] == up["node"]).select("p", F.col("root").alias("s"), "o").distinct()
    s_all = s_up.join(up.withColumnRenamed("root", "r"), F.col("s") == F.col("r")).select("p", F.col("node").alias("s"), "o")
    o_up = links.join(up, links["o"] == up["node"]).select("p", "s", F.col("root").alias("o")).distinct()
    o_all = o_up.join(up.withColumnRenamed("root", "r"), F.col("o") == F.col("r")).select("p", "s", F.col("node").alias("o"))
    return [s_all, o_all]  # the least one is a member of its group


def inconsistencies(graph: TripleGraph) -> DataFrame:
    """``rule, subject``: what contradicts the axioms in a materialised graph; empty means that no rule found anything."""
    t = graph.tables
    types, links = t["class_assertion"], t["obj_assertion"]
    marked = _marked(graph, "AsymmetricProperty", "IrreflexiveProperty")
    few = lambda df: rows if len(rows := df.limit(SMALL + 1).collect()) <= SMALL else None

    def twice(rows: DataFrame, column: str, pairs: DataFrame, keys: list[str]) -> DataFrame:
        """Rows with ``a`` of a pair in a column whose keys have a row with ``b``: only rows of the pairs' names meet."""
        known = few(pairs)
        first, second = rows, rows
        if known is not None:
            if not known:
                return rows.limit(0)
            first, second = (rows.where(F.col(column).isin(*{r[i] for r in known})) for i in ("a", "b"))
            pairs = F.broadcast(pairs)
        first = first.join(pairs, F.col(column) == F.col("a")).select(*keys, F.col("b").alias(column))
        return first.join(second, [column, *keys], "left_semi")

    clash = twice(types, "cls", t["disjoint_class"].select("a", "b"), ["ind"])
    one_way = _of(links, marked["AsymmetricProperty"])
    asym = one_way.join(one_way.select("p", F.col("o").alias("s"), F.col("s").alias("o")), LINKS, "left_semi")
    irr = _of(links, marked["IrreflexiveProperty"]).where("s = o")
    dis = twice(links, "p", t["disjoint_prop"].select("a", "b"), ["s", "o"])
    neg = links.join(t["neg_obj_assertion"], LINKS, "left_semi")
    negd = t["data_assertion"].join(t["neg_data_assertion"], ["p", "s", "lex", "dt"], "left_semi")
    same = t["same_as"].select("a", "b")
    both = same.unionAll(same.select("b", "a")).join(t["different_from"], ["a", "b"], "left_semi")
    found = [("nothing", types.where(F.col("cls") == E.NOTHING.iri), "ind"), ("disjoint classes", clash, "ind"), ("asymmetric", asym, "s"), ("irreflexive", irr, "s"), ("disjoint properties", dis, "s"), ("negative assertion", neg, "s"), ("negative assertion", negd, "s"), ("same and different", both, "a")]
    # dealt before they are compared: no task of a scan holds what it finds
    return reduce(DataFrame.unionAll, [df.select(F.lit(rule).alias("rule"), F.col(c).alias("subject")) for rule, df, c in found]).repartition("rule", "subject").distinct()


def is_entailed(graph: TripleGraph, a: E.Axiom) -> bool:
    """Whether an axiom over names follows by the rules; an inconsistent graph entails everything."""
    full = materialise(graph)
    if not inconsistencies(full).isEmpty():
        return True
    name = lambda x: x if isinstance(x, str) else x.iri
    if a.kind == "ClassAssertion":
        ind = a.args[1]
        return a.args[0] == E.THING or not Reasoner(full).among(a.args[0], graph.spark.createDataFrame([(ind,)], "ind string")).isEmpty()
    if a.kind == "ObjectPropertyAssertion":
        p, s, o = a.args
        s, o = (o, s) if p.inverse else (s, o)
        return not full.table("obj_assertion").where((F.col("p") == p.iri) & (F.col("s") == s) & (F.col("o") == o)).isEmpty()
    if a.kind == "DataPropertyAssertion":
        p, s, v = a.args
        return not full.table("data_assertion").where((F.col("p") == name(p)) & (F.col("s") == s) & (F.col("lex") == v.lex) & (F.col("dt") == v.datatype)).isEmpty()
    if a.kind in ("SubClassOf", "SubObjectPropertyOf", "SubDataPropertyOf"):
        sub, sup = map(name, a.args)
        if sub == sup or sup == E.THING.iri or sub == E.NOTHING.iri:
            return True
        edges = graph.closure("sub_class" if a.kind == "SubClassOf" else "sub_prop")
        if not edges.where((F.col("sub") == sub) & (F.col("sup") == sup)).isEmpty():
            return True
        return a.kind == "SubClassOf" and not unsatisfiable_classes(graph).where(F.col("iri") == sub).isEmpty()
    if a.kind in ("EquivalentClasses", "EquivalentObjectProperties", "EquivalentDataProperties"):
        kind = {"C": "SubClassOf", "O": "SubObjectPropertyOf", "D": "SubDataPropertyOf"}[a.kind.removeprefix("Equivalent")[0]]
        return all(is_entailed(graph, E.axiom(kind, x, y)) for x in a.args for y in a.args if x != y)
    if a.kind == "DisjointClasses":
        return all(not Schema(graph).disjoint_classes(name(x)).where(F.col("iri") == name(y)).isEmpty() for q in a.pairwise() for x, y in [q.args])
    if a.kind in ("SameIndividual", "DifferentIndividuals"):
        schema = Schema(full)
        of = schema.same_individuals if a.kind[0] == "S" else schema.different_individuals
        return all(q.args[0] == q.args[1] or not of(q.args[0]).where(F.col("iri") == q.args[1]).isEmpty() for q in a.pairwise())
    raise ValueError(f"no rule decides {a.kind}")


def is_consistent(graph: TripleGraph) -> bool:
    return inconsistencies(materialise(graph)).isEmpty()


def unsatisfiable_classes(graph: TripleGraph) -> DataFrame:
    """``iri``: classes below bottom, or below two disjoint classes."""
    c = graph.closure("sub_class")
    reach = c.unionAll(c.select("sub", F.col("sub").alias("sup"))).distinct()
    d = graph.table("disjoint_class")
    first = reach.join(d, F.col("sup") == F.col("a")).select("sub", "b")
    second = reach.select(F.col("sub").alias("sub2"), F.col("sup").alias("sup2"))
    clash = first.join(second, (F.col("sub") == F.col("sub2")) & (F.col("b") == F.col("sup2"))).select(F.col("sub").alias("iri"))
    own = clash.unionAll(c.where(F.col("sup") == E.NOTHING.iri).select(F.col("sub").alias("iri"))).distinct()
    below = c.join(own, F.col("sup") == F.col("iri"), "left_semi").select(F.col("sub").alias("iri"))
    return own.unionAll(below).where(F.col("iri") != E.NOTHING.iri).distinct()


#: Inferred statements by kind of generator.
GENERATORS = ("InferredClassAssertionAxiomGenerator", "InferredSubClassAxiomGenerator", "InferredDisjointClassesAxiomGenerator", "InferredEquivalentClassAxiomGenerator", "InferredInverseObjectPropertiesAxiomGenerator", "InferredEquivalentDataPropertiesAxiomGenerator", "InferredEquivalentObjectPropertyAxiomGenerator", "InferredSubDataPropertyAxiomGenerator", "InferredSubObjectPropertyAxiomGenerator", "InferredDataPropertyCharacteristicAxiomGenerator", "InferredObjectPropertyCharacteristicAxiomGenerator")


def inferred(graph: TripleGraph, kinds: tuple[str, ...] = GENERATORS) -> DataFrame:
    """``kind, a, b``: statements of the given generators that follow and aren't asserted."""
    t = graph.tables
    objects = t["entity"].where("kind = 'ObjectProperty'").select("iri").unionAll(t["obj_assertion"].select("p")).distinct()
    datas = t["entity"].where("kind = 'DatatypeProperty'").select("iri").unionAll(t["data_assertion"].select("p")).distinct()

    def subs(closure: str, asserted: str, among: DataFrame | None = None) -> DataFrame:
        out = graph.closure(closure).where("sub <> sup").join(t[asserted], ["sub", "sup"], "left_anti")
        out = out if among is None else out.join(among, F.col("sub") == F.col("iri"), "left_semi")
        return out.select(F.col("sub").alias("a"), F.col("sup").alias("b"))

    def equal(closure: str, asserted: str, among: DataFrame | None = None) -> DataFrame:
        c = graph.closure(closure).where("sub < sup")
        back = graph.closure(closure).select(F.col("sup").alias("sub"), F.col("sub").alias("sup"))
        out = c.join(back, ["sub", "sup"], "left_semi").select(F.col("sub").alias("a"), F.col("sup").alias("b"))
        out = out if among is None else out.join(among, F.col("a") == F.col("iri"), "left_semi")
        return out.join(t[asserted].select("a", "b"), ["a", "b"], "left_anti")

    def make(kind: str) -> DataFrame | None:
        if "ClassAssertion" in kind:
            full = materialise(graph).table("class_assertion")
            return full.join(t["class_assertion"], TYPES, "left_anti").select(F.col("ind").alias("a"), F.col("cls").alias("b"))
        if kind.startswith("InferredSubClass"):
            return subs("sub_class", "sub_class")
        if kind.startswith("InferredSub"):
            return subs("sub_prop", "sub_prop", datas if "Data" in kind else objects)
        if "EquivalentClass" in kind:
            return equal("sub_class", "equivalent_class")
        if "Equivalent" in kind:
            return equal("sub_prop", "equivalent_prop", datas if "Data" in kind else objects)
        if "Inverse" in kind:
            return t["inverse_prop"].select(F.col("q").alias("a"), F.col("p").alias("b")).join(t["inverse_prop"].select(F.col("p").alias("a"), F.col("q").alias("b")), ["a", "b"], "left_anti")
        if "Disjoint" in kind:
            c = graph.closure("sub_class")
            reach = c.unionAll(c.select("sub", F.col("sub").alias("sup"))).unionAll(t["disjoint_class"].select(F.col("a").alias("sub"), F.col("a").alias("sup"))).unionAll(t["disjoint_class"].select(F.col("b").alias("sub"), F.col("b").alias("sup"))).distinct()
            left = reach.join(t["disjoint_class"], F.col("sup") == F.col("a")).select(F.col("sub").alias("x"), F.col("b").alias("m"))
            out = left.join(reach, F.col("m") == F.col("sup")).select(F.col("x").alias("a"), F.col("sub").alias("b"))
            return out.join(t["disjoint_class"], ["a", "b"], "left_anti")
        # characteristics pass to equal properties and to inverses (functional to inverse functional)
        among = datas if "Data" in kind else objects
        same = equal("sub_prop", "sub_prop")
        same = same.unionAll(same.select("b", "a"))
        out = t["characteristic"].join(same, F.col("p") == F.col("a")).select(F.col("b").alias("p"), "name")
        return out.join(t["characteristic"], ["p", "name"], "left_anti").join(among, F.col("p") == F.col("iri"), "left_semi").select(F.col("p").alias("a"), F.col("name").alias("b"))

    unknown = set(kinds) - set(GENERATORS)
    if unknown:
        raise ValueError(f"no generator is called {', '.join(sorted(unknown))}")
    return _union([make(k).select(F.lit(k).alias("kind"), "a", "b") for k in kinds])


def justifications(graph: TripleGraph, sub: str, sup: str, n: int = 10) -> list[tuple[tuple[str, str], ...]]:
    """At most ``n`` minimal sets of asserted subclass edges from which ``sub`` ⊑ ``sup`` follows: the simple paths, shortest first.

    Paths are grown level by level by joins; each level keeps the paths that don't turn back, and those that arrived leave.
    """
    t = graph.tables
    edges = t["sub_class"].unionAll(t["equivalent_class"].select("a", "b")).unionAll(t["equivalent_class"].select("b", "a")).distinct()
    useful = transitive_closure(edges, "sub", "sup").where(F.col("sup") == sup).select(F.col("sub").alias("ok")).unionAll(graph.spark.range(1).select(F.lit(sup).alias("ok"))).distinct()
    step = durable(edges.join(useful, F.col("sup") == F.col("ok"), "left_semi").select(F.col("sub").alias("at"), F.col("sup").alias("to")))
    paths = graph.spark.range(1).select(F.array(F.lit(sub)).alias("path"))
    out: list[tuple[tuple[str, str], ...]] = []
    while len(out) < n:
        grown = paths.join(step, F.element_at("path", -1) == F.col("at")).where(~F.array_contains("path", F.col("to"))).select(F.concat("path", F.array("to")).alias("path"))
        grown = durable(grown)
        done = grown.where(F.element_at("path", -1) == sup).orderBy("path").limit(n - len(out)).collect()
        out += [tuple(zip(r.path, r.path[1:], strict=False)) for r in done]
        paths = grown.where(F.element_at("path", -1) != sup)
        if paths.isEmpty():
            break
    return out


def type_justifications(graph: TripleGraph, ind: str, cls: str, n: int = 10) -> list[tuple]:
    """At most ``n`` sets of an assertion and subclass edges from which an individual's class follows."""
    own = [r.cls for r in graph.table("class_assertion").where(F.col("ind") == ind).select("cls").distinct().orderBy("cls").collect()]
    out: list[tuple] = [(("type", ind, cls),)] if cls in own else []
    for c in own:
        if len(out) < n and c != cls:
            out += [(("type", ind, c), *path) for path in justifications(graph, c, cls, n - len(out))]
    return out[:n]


def contrast(graph: TripleGraph, cls: str, fact: str, foil: str) -> dict[str, list]:
    """What speaks for ``cls`` at ``fact`` and not at ``foil``: statements shared by both, those of the fact alone, and those missing at the foil."""
    def said(ind: str) -> DataFrame:
        t = graph.tables
        types = t["class_assertion"].where(F.col("ind") == ind).select(F.lit("type").alias("p"), F.col("cls").alias("x"))
        return types.unionAll(t["obj_assertion"].where(F.col("s") == ind).select("p", F.col("o").alias("x"))).unionAll(t["data_assertion"].where(F.col("s") == ind).select("p", F.col("lex").alias("x"))).distinct()

    a, b = said(fact), said(foil)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    reasons = type_justifications(graph, fact, cls, 1)
    needed = [r for r in (reasons[0] if reasons else ())]
    return {"common": rows(a.join(b, ["p", "x"], "left_semi")), "different": rows(a.join(b, ["p", "x"], "left_anti")), "conflict": rows(b.join(a, ["p", "x"], "left_anti")), "foil_mapping": [tuple(foil if x == fact else x for x in r) for r in needed]}
