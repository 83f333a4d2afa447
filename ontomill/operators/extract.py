"""Graphs from texts: chunks, statements of each chunk by an extractor, merging, clustering, and axioms.

The extractor is any function from a text to statements; it runs in Arrow batches next to the data. Without a language model
the rule-based one below is used, which reads simple sentences; merging and everything after it is DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.functions.text import chunked, guessed_datatype, snake_case, type_name
from ontomill.plans import expr as E
from ontomill.plans.ship import arrow_rows, ship
from ontomill.sources.graphs import TripleGraph

#: Texts above these lengths are cut into chunks, and summarised first.
CHUNK_ABOVE, SUMMARISE_ABOVE = 4000, 8000
CHUNK_SIZE, CHUNK_OVERLAP = 6000, 300
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
# a name's words are parted by one blank each: a word of capitals is read in one way alone, not in as many as it has cuts
_FACT = re.compile(r"^([A-Z][\w'-]*(?:\s[A-Z][\w'-]*)*\s?)\s+((?:is|was|has|had|are|were|[a-z]+s|[a-z]+ed)(?:\s+(?:a|an|the|in|of|by|to|at|on|with|for))*)\s++(.+?)[.!?]?$")


@dataclass(frozen=True)
class Statement:
    subject: str
    predicate: str
    object: str


def simple_statements(text: str) -> list[Statement]:
    """Statements of sentences of the form: capitalised name, verb, rest."""
    out = []
    for sentence in _SENTENCE.split(text):
        m = _FACT.match(sentence.strip())
        if m and len(m[3]) <= 120:
            out.append(Statement(m[1].strip(), re.sub(r"(?<!\s)\s+(?:a|an|the)$", "", m[2].strip()), re.sub(r"^(?:a|an|the)\s+", "", m[3].strip())))
    return out


def first_sentences(text: str, limit: int = SUMMARISE_ABOVE) -> str:
    """A plain summary: whole sentences from the start and the end, up to a length."""
    if len(text) <= limit:
        return text
    parts = _SENTENCE.split(text)
    head, tail, used = [], [], 0
    i, j = 0, len(parts) - 1
    while i <= j:
        for take, bag in ((i, head), (j, tail)):
            if i <= j and used + len(parts[take]) + 1 <= limit:
                bag.append(parts[take])
                used += len(parts[take]) + 1
                i, j = (i + 1, j) if bag is head else (i, j - 1)
            else:
                return " ".join(head + tail[::-1])
    return " ".join(head + tail[::-1])


def statements(docs: DataFrame, extractor: Callable[[str], list[Statement]] = simple_statements, id_col: str = "doc_id", text_col: str = "text", strategy: str = "paragraph") -> DataFrame:
    """``id, chunk_no, pos, subject, predicate, object`` of every chunk of every text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos, texts = batch.columns
            for first in range(0, batch.num_rows, 500):
                found = [(i, k, s.subject, s.predicate, s.object) for i in range(first, min(first + 500, batch.num_rows)) for k, s in enumerate(extractor(texts[i].as_py()))]
                if found:
                    at, pos, *said = zip(*found, strict=True)
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays([ids.take(at), nos.take(at), pa.array(pos, pa.int32()), *(pa.array(x, pa.string()) for x in said)], ["id", "chunk_no", "pos", "subject", "predicate", "object"])

    kind = docs.schema[id_col].dataType.simpleString()
    chunks = chunked(docs, CHUNK_SIZE, CHUNK_OVERLAP, strategy, id_col, text_col).select("id", "chunk_no", "chunk")
    return arrow_rows(chunks, rows, f"id {kind}, chunk_no int, pos int, subject string, predicate string, object string")


def merged(rows: DataFrame, keys: list[str], order: list[str], case_sensitive: bool = False) -> DataFrame:
    """One row of each group that is equal but for case, the first in order, by a map-side combined aggregate."""
    by = [F.col(k) if case_sensitive else F.lower(F.col(k)) for k in keys]
    first = F.min_by(F.struct(*keys), F.struct(*order, *keys)).alias("x")
    return rows.groupBy(*[c.alias(f"k{i}") for i, c in enumerate(by)]).agg(first).select("x.*")


def entities(found: DataFrame) -> DataFrame:
    """``entity, n``: subjects and objects, merged but for case, the spelling that occurs most."""
    every = found.select(F.col("subject").alias("entity")).unionAll(found.select("object"))
    n = every.groupBy("entity").agg(F.count("*").alias("n"))
    return n.groupBy(F.lower("entity").alias("key")).agg(F.max_by("entity", F.struct("n", "entity")).alias("entity"), F.sum("n").alias("n")).select("entity", "n")


def clustered(names: DataFrame, column: str) -> DataFrame:
    """``name, canonical``: names equal but for case, punctuation and a plural ``s`` go to the shortest of them."""
    key = F.regexp_replace(snake_case(F.col("name")), "s$", "")
    n = names.select(F.col(column).alias("name")).distinct().withColumn("key", key)
    best = n.groupBy("key").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("canonical"))
    return n.join(best, "key").select("name", "canonical")


def coherent(scored: DataFrame, least: int = 3) -> DataFrame:
    """Statements whose ``score`` is ``least`` or more."""
    return scored.where(F.col("score") >= least)


def axioms(found: DataFrame, namespace: str) -> TripleGraph:
    """Statements as a graph: ``is`` gives types; a predicate any of whose objects is a subject gives links, others give literals."""
    name = lambda c: F.concat(F.lit(namespace), snake_case(F.col(c)))
    f = merged(found, ["subject", "predicate", "object"], ["id", "chunk_no", "pos"])
    types = f.where("lower(predicate) in ('is', 'was', 'are', 'were')").select(F.concat(F.lit(namespace), type_name(F.col("object"))).alias("cls"), name("subject").alias("ind"))
    rest = f.where("lower(predicate) not in ('is', 'was', 'are', 'were')")
    known = f.select(F.lower("subject").alias("known")).distinct()
    hit = rest.join(known, F.lower(F.col("object")) == F.col("known"), "left")
    links = hit.groupBy("predicate").agg(F.bool_or(F.col("known").isNotNull()).alias("links"))
    rest = rest.join(links, "predicate")
    obj = rest.where("links").select(name("predicate").alias("p"), name("subject").alias("s"), name("object").alias("o"))
    data = rest.where("not links").select(name("predicate").alias("p"), name("subject").alias("s"), F.col("object").alias("lex"), guessed_datatype(F.col("object")).alias("dt"))
    inds = f.select(name("subject").alias("ind")).unionAll(obj.select("o")).distinct()
    entity = types.select(F.col("cls").alias("iri"), F.lit("Class").alias("kind")).distinct()
    return TripleGraph(found.sparkSession, {"individuals": inds, "class_assertion": types.distinct(), "obj_assertion": obj.distinct(), "data_assertion": data.distinct(), "entity": entity})


class Pipeline:
    """Texts to a graph: long texts summarised if asked, chunks, statements, canonical relations, a score's threshold, axioms."""

    def __init__(self, namespace: str, extractor: Callable[[str], list[Statement]] = simple_statements, summarise: bool = False, scorer: Callable[[DataFrame], DataFrame] | None = None):
        self.namespace, self.extractor, self.summarise, self.scorer = namespace, extractor, summarise, scorer

    def run(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> TripleGraph:
        if self.summarise:
            ship(docs.sparkSession)

            def short(texts: pd.Series) -> pd.Series:
                return texts.map(lambda t: first_sentences(t or ""))

            docs = docs.withColumn(text_col, F.pandas_udf(short, "string", F.PandasUDFType.SCALAR)(F.col(text_col)))
        found = statements(docs, self.extractor, id_col, text_col)
        names = clustered(found, "predicate").withColumnRenamed("name", "predicate")
        found = found.join(names, "predicate").drop("predicate").withColumnRenamed("canonical", "predicate")
        if self.scorer:
            found = coherent(self.scorer(found))
        return axioms(found, self.namespace)


THING = E.THING
