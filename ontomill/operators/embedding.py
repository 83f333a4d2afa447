"""Retrieval over embeddings: a link is believed if its score reaches a threshold.

Entities and relations have vectors; a link's score is the logistic of the trilinear product of head, relation and tail. The
query side is one head (or a bounded list of them), so scoring is one pass over the entities with the query's vector as a
constant; no pair of entities is formed without being asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontomill.plans import expr as E
from ontomill.plans.expr import Prop
from ontomill.sources.graphs import Data, Edges, Ext, Graph

TYPE, SUB = E.RDF + "type", E.RDFS + "subClassOf"
#: Queries of one scoring pass at most; more are scored in several passes.
PER_PASS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _constant(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def similar(vectors: DataFrame, query: list[float], gamma: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, score`` of the vectors whose cosine with the query is ``gamma`` or more; null vectors are left out."""
    score = cosine(F.col(vec_col), _constant(query))
    return vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), score.alias("score")).where(F.col("score") >= gamma)


class EmbeddingGraph(Graph):
    """A graph whose links are predicted from vectors; ``entities`` and ``relations``: id, vec."""

    KIND = ""

    def __init__(self, entities: DataFrame, relations: DataFrame, gamma: float = 0.5, individuals: DataFrame | None = None):
        self.entities = entities.where("id is not null and vec is not null").select("id", "vec")
        self.relations, self.gamma = relations, gamma
        self._individuals = individuals

    def _vectors(self, table: DataFrame, ids: list[str]) -> dict[str, list[float]]:
        return {r.id: list(r.vec) for r in table.where(F.col("id").isin(*ids)).select("id", "vec").collect()}

    def predict(self, h: list[str] | None = None, r: str | None = None, t: list[str] | None = None) -> DataFrame:
        """``known, found, score`` for links with one open end: heads given and tails found, or the other way round.

        Unknown names give nothing.
        """
        if r is None or (h is None) == (t is None):
            raise ValueError("a relation and exactly one end are to be given")
        empty = self.entities.select(F.col("id").alias("known"), F.col("id").alias("found"), F.lit(0.0).alias("score")).limit(0)
        relation = self._vectors(self.relations, [r])
        frames = []
        given = sorted(set(h or t or []))
        for at in range(0, len(given) if relation else 0, PER_PASS):
            known = self._vectors(self.entities, given[at : at + PER_PASS])
            if known:
                queries = F.array(*[F.struct(F.lit(k).alias("known"), _constant([a * b for a, b in zip(v, relation[r], strict=True)]).alias("q")) for k, v in sorted(known.items())])
                rows = self.entities.select("id", "vec", F.explode(queries).alias("x"))
                score = 1 / (1 + F.exp(-dot(F.col("vec"), F.col("x.q"))))
                frames.append(rows.select(F.col("x.known").alias("known"), F.col("id").alias("found"), score.alias("score")).where(F.col("score") >= self.gamma))
        return reduce(DataFrame.unionAll, frames) if frames else empty

    def universe(self) -> dict[str, Ext]:
        if self._individuals is not None:
            return {self.KIND: Ext(df=self._individuals.select(F.col("ind").alias("k")).where("k is not null").distinct())}
        found = self.predict(t=[E.OWL + "NamedIndividual"], r=TYPE).select(F.col("found").alias("k")).distinct()
        return {self.KIND: Ext(df=found)}

    def class_extension(self, iri: str, subs: bool = True) -> dict[str, Ext]:
        names, new = {iri}, {iri}
        while subs and new:  # predicted subclasses, breadth first; a name is asked about once
            found = {r.found for r in self.predict(t=sorted(new), r=SUB).select("found").distinct().collect()}
            new = found - names
            names |= new
        return {self.KIND: Ext(df=self.predict(t=sorted(names), r=TYPE).select(F.col("found").alias("k")).distinct())}

    def edges(self, prop: Prop, subs: bool = True) -> list[Edges]:
        """All predicted links of a property: every individual is asked for its tails, in a join on blocks of the individuals.

        A block holds about ``PER_PASS`` heads however many there are, and each tail goes to each block. Meant for graphs whose
        individuals are a stated query set; ``linked_to`` asks about few.
        """
        inds = self.universe()[self.KIND].keys()
        relation = self._vectors(self.relations, [prop.iri])
        if not relation:
            return []
        heads = self.entities.join(inds, F.col("id") == F.col("k"), "left_semi")
        scaled = heads.select(F.col("id").alias("s"), F.zip_with("vec", _constant(relation[prop.iri]), lambda a, b: a * b).alias("q"))
        n = max(1, -(-inds.count() // PER_PASS))
        blocks = scaled.groupBy((F.pmod(F.xxhash64("s"), F.lit(n))).alias("block")).agg(F.collect_list(F.struct("s", "q")).alias("qs"))
        tails = heads.select(F.col("id").alias("o"), "vec").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        pairs = tails.join(blocks, "block").select("o", "vec", F.explode("qs").alias("x"))
        links = pairs.where(1 / (1 + F.exp(-dot(F.col("vec"), F.col("x.q")))) >= self.gamma).select(F.col("x.s").alias("s"), "o")
        e = Edges(self.KIND, self.KIND, links, F.col("s"), F.col("o"), unique=True)
        return [e.flipped() if prop.inverse else e]

    def linked_to(self, inds: list[str], prop: Prop) -> DataFrame:
        """``known, found, score`` for some individuals; an inverse property swaps the ends."""
        return self.predict(t=inds, r=prop.iri) if prop.inverse else self.predict(h=inds, r=prop.iri)

    def data(self, iri: str, subs: bool = True) -> list[Data]:
        raise NotImplementedError("embeddings say nothing of literals")

    def key_of(self, ind: str) -> tuple[str, object]:
        return self.KIND, ind

    def name_of(self, kind: str, key: Column) -> Column:
        return key

    # schema by prediction

    def sub_classes(self, iri: str) -> DataFrame:
        return self.predict(t=[iri], r=SUB).select(F.col("found").alias("iri")).where(F.col("iri") != iri)

    def super_classes(self, iri: str) -> DataFrame:
        return self.predict(h=[iri], r=SUB).select(F.col("found").alias("iri")).where(F.col("iri") != iri)

    def sub_properties(self, prop: Prop) -> DataFrame:
        """Properties below; of an inverse, the inverses of those below the named one (column ``inverse`` says so)."""
        return self.predict(t=[prop.iri], r=E.RDFS + "subPropertyOf").select(F.col("found").alias("iri"), F.lit(prop.inverse).alias("inverse"))

    def super_properties(self, prop: Prop) -> DataFrame:
        return self.predict(h=[prop.iri], r=E.RDFS + "subPropertyOf").select(F.col("found").alias("iri"), F.lit(prop.inverse).alias("inverse"))

    def domains(self, iri: str) -> DataFrame:
        return self.predict(h=[iri], r=E.RDFS + "domain").select(F.col("found").alias("iri"))

    def ranges(self, iri: str) -> DataFrame:
        return self.predict(h=[iri], r=E.RDFS + "range").select(F.col("found").alias("iri"))

    def about(self, ind: str, relations: list[str]) -> DataFrame:
        """``p, found, score``: everything predicted of an individual over the given relations."""
        return reduce(DataFrame.unionAll, [self.predict(h=[ind], r=r).select(F.lit(r).alias("p"), "found", "score") for r in relations])
