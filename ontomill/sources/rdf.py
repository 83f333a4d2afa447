"""RDF files as triples and triples as graph tables, and back.

N-Triples and N-Quads are read and written line by line on all tasks, and so are Turtle, TriG, RDF/XML and JSON-LD whose lines are
statements of their own, as ``save`` writes them. Documents whose statements span lines are parsed a file a row; there a file is
the unit of work, so big graphs belong in lines. A graph's triples are stored once, apart by the table that they go to.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import reduce
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.plans import expr as E
from ontomill.plans.rounds import checkpoint_dir
from ontomill.plans.ship import arrow_rows, ship
from ontomill.sources import owl_rdf
from ontomill.sources.graphs import TABLES, TripleGraph

SCHEMA = "s string, p string, o string, o_kind string, dt string, lang string"
_TERM = r"(<[^<>\s]*>|_:\S+)"
_LITERAL = r'"([^"\\]*(?:\\.[^"\\]*)*)"(?:\^\^<([^<>\s]*)>|@([A-Za-z0-9\-]+))?'
_TRIPLE = rf"^\s*{_TERM}\s+(<[^<>\s]*>)\s+(?:{_TERM}|{_LITERAL})\s*"
_LINE = _TRIPLE + r"(?:<[^<>\s]*>\s*|_:\S+\s*)?\.\s*(?:#.*)?$"
_TURTLE_LINE = _TRIPLE + r"\.\s*(?:#.*)?$"
_GRAPH_LINE = r"^\s*GRAPH\s+<[^<>\s]*>\s*\{(.*)\}\s*$"


def _unescaped(text: Column) -> Column:
    c = text
    for code, sign in (("\\\\n", "\n"), ("\\\\r", "\r"), ("\\\\t", "\t"), ("\\\\b", "\b"), ("\\\\f", "\f"), ('\\\\"', '"'), ("\\\\'", "'")):
        c = F.regexp_replace(c, rf"(?<!\\)((?:\\\\)*){code}", "$1" + sign)
    # codes are rare: only such rows take the slow way
    c = F.when(c.rlike(_CODE), F.aggregate(F.sequence(F.lit(1), F.size(F.split(c, r"\\[uU]"))), c, _one_code)).otherwise(c)
    return F.when(text.contains("\\"), F.regexp_replace(c, r"\\\\", r"\\")).otherwise(text)


_CODE = r"(?<!\\)(?:\\\\)*\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"


def _one_code(text: Column, _: Column) -> Column:
    """The first code that no backslash escapes, wherever it stands, replaced by its character."""
    code = F.regexp_extract(text, _CODE, 1)
    sign = F.decode(F.unhex(F.lpad(F.substring(code, 2, 8), 8, "0")), "UTF-32")
    # a sign that means something in a replacement is escaped there
    shown = F.when(sign.isin("\\", "$"), F.concat(F.lit("\\"), sign)).otherwise(sign)
    return F.when(code == "", text).otherwise(F.regexp_replace(text, F.concat(F.lit(r"(?<!\\)((?:\\\\)*)\\"), code), F.concat(F.lit("$1"), shown)))


def _plain(term: Column) -> Column:
    return F.when(term.startswith("<"), F.substring(term, F.lit(2), F.length(term) - 2)).otherwise(term)


def _parts(line: Column, pattern: str = _LINE) -> Column:
    """Subject, predicate, object, datatype, language and text of a statement, by one match; of other lines an array of one.

    A line holds no line break, so the parts may be joined by one.
    """
    return F.split(F.regexp_replace(line, pattern, "$1\n$2\n$3\n$5\n$6\n$4"), "\n", 6)


def _statements(lines: DataFrame) -> DataFrame:
    """Triples of the lines' ``parts``; other lines are left out."""
    g = lambda i: F.col("parts")[i]
    is_literal = g(2) == ""
    return lines.where(F.size("parts") == 6).select(
        _plain(g(0)).alias("s"),
        _plain(g(1)).alias("p"),
        F.when(is_literal, _unescaped(g(5))).otherwise(_plain(g(2))).alias("o"),
        F.when(is_literal, "lit").when(g(2).startswith("_:"), "bnode").otherwise("iri").alias("o_kind"),
        F.when(is_literal, F.when(g(3) != "", g(3)).when(g(4) != "", E.RDF + "langString").otherwise(E.XSD + "string")).alias("dt"),
        F.nullif(g(4), F.lit("")).alias("lang"),
    )


def _blank(line: Column) -> Column:
    return line.rlike(r"^\s*(#.*)?$")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: lines of N-Triples or N-Quads files that are neither statements nor comments nor blank."""
    return spark.read.text(path).where(~F.col("value").rlike(_LINE) & ~_blank(F.col("value")))


def read_ntriples(spark: SparkSession, path: str, strict: bool = False, graphs: bool = False) -> DataFrame:
    """Triples of N-Triples or N-Quads files; comments and blank lines are left out.

    Lines that aren't statements are left out too (``bad_lines`` lists them), or with ``strict`` end the query with an error
    that names the first. With ``graphs`` a line may stand in a block ``GRAPH <name> { ... }`` of its own.
    """
    value = F.regexp_replace("value", _GRAPH_LINE, "$1") if graphs else F.col("value")
    lines = spark.read.text(path).select(value.alias("value"))
    if strict:
        said = F.raise_error(F.concat(F.lit("no statement: "), F.col("value")))
        lines = lines.where(~_blank(F.col("value"))).select(F.when(F.col("value").rlike(_LINE), F.col("value")).otherwise(said.cast("string")).alias("value"))
    return _statements(lines.select(_parts(F.col("value")).alias("parts")))


def _line(t: DataFrame) -> Column:
    def term(c: str) -> Column:
        return F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))

    text = F.col("o")  # only literals are escaped
    for sign, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).when(F.col("dt") == E.XSD + "string", "").otherwise(F.concat(F.lit("^^<"), F.col("dt"), F.lit(">")))
    obj = F.when(F.col("o_kind") == "lit", F.concat(F.lit('"'), text, F.lit('"'), F.coalesce(tail, F.lit("")))).otherwise(term("o"))
    return F.concat_ws(" ", term("s"), term("p"), obj)


_TURTLE = re.compile(r'\s*(?:#[^\n]*\n\s*)*(?:(?P<iri><[^<>\s]*>)|(?P<long>"""(?:[^\\]|\\.)*?""")|(?P<lit>"(?:[^"\\\n]|\\.)*")|(?P<lang>@[A-Za-z][A-Za-z0-9\-]*)|(?P<dt>\^\^)|(?P<num>[+-]?(?:\d+\.\d*|\.?\d+)(?:[eE][+-]?\d+)?)|(?P<mark>[;,.\[\](){}])|(?P<name>_:[\w\-.]*\w|(?:[\w\-.]*\w)?:(?:[\w\-.%]*[\w\-%])?|a\b|true\b|false\b|PREFIX\b|BASE\b|GRAPH\b))')


def parse_turtle(text: str, file: str = "") -> list[tuple]:
    """Triples of a Turtle document: prefixes, ``a``, lists by ``;`` and ``,``, blank nodes in brackets, collections."""
    prefixes, base, out, at, blank = {}, "", [], 0, 0
    tokens: list[tuple[str, str]] = []
    end = len(text.rstrip())
    while at < end:
        m = _TURTLE.match(text, at)
        if not m:
            if not text[at:].strip() or text[at:].lstrip().startswith("#"):
                break
            raise ValueError(f"{file}: can't read {text[at : at + 30]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    k = 0

    def fresh() -> str:
        nonlocal blank
        blank += 1
        return f"_:b{zlib.crc32(file.encode())}x{blank}"

    def text_of(raw: str) -> str:
        body = raw[3:-3] if raw.startswith('"""') else raw[1:-1]
        return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}.get(m[1]) or (chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else m[1]), body, flags=re.DOTALL)

    def iri(kind: str, raw: str) -> str:
        if kind == "iri":
            return raw[1:-1] if ":" in raw else base + raw[1:-1]
        head, _, tail = raw.partition(":")
        return raw if head == "_" else prefixes[head] + tail

    def node() -> tuple:
        nonlocal k
        kind, raw = tokens[k]
        k += 1
        if kind in ("lit", "long"):
            if k < len(tokens) and tokens[k][0] == "lang":
                k += 1
                return text_of(raw), "lit", E.RDF + "langString", tokens[k - 1][1][1:]
            if k < len(tokens) and tokens[k][0] == "dt":
                k += 2
                return text_of(raw), "lit", iri(*tokens[k - 1]), None
            return text_of(raw), "lit", E.XSD + "string", None
        if kind == "num":
            return raw, "lit", E.XSD + ("double" if "e" in raw.lower() else "decimal" if "." in raw else "integer"), None
        if raw in ("true", "false"):
            return raw, "lit", E.XSD + "boolean", None
        if raw == "[":
            b = fresh()
            if tokens[k][1] != "]":
                predicates(b)
            k += 1
            return b, "bnode", None, None
        if raw == "(":
            items = []
            while tokens[k][1] != ")":
                items.append(node())
            k += 1
            rest = (E.RDF + "nil", "iri", None, None)
            for item in reversed(items):
                b = fresh()
                out.append((b, E.RDF + "first", *item))
                out.append((b, E.RDF + "rest", *rest))
                rest = (b, "bnode", None, None)
            return rest
        name = iri(kind, raw)
        return name, "bnode" if name.startswith("_:") else "iri", None, None

    def predicates(s: str) -> None:
        nonlocal k
        while True:
            kind, raw = tokens[k]
            k += 1
            p = E.RDF + "type" if raw == "a" else iri(kind, raw)
            while True:
                out.append((s, p, *node()))
                if tokens[k][1] != ",":
                    break
                k += 1
            while tokens[k][1] == ";":
                k += 1
            if tokens[k][1] in (".", "]", "}"):
                return

    while k < len(tokens):
        word = tokens[k][1]
        if word in ("@prefix", "PREFIX"):
            prefixes[tokens[k + 1][1][:-1]] = tokens[k + 2][1][1:-1]
            k += 3
        elif word in ("@base", "BASE"):
            base = tokens[k + 1][1][1:-1]
            k += 2
        elif word in ("GRAPH", "{", "}"):  # a graph's name is left out, as that of a quad is
            k += 1
        else:
            s = node()[0]
            if tokens[k][1] not in (".", "{"):
                predicates(s)
        if k < len(tokens) and tokens[k][1] == ".":
            k += 1
    return out


def parse_rdfxml(text: str, file: str = "") -> list[tuple]:
    """Triples of an RDF/XML document: node and property elements, attributes, resources, typed and nested nodes, collections."""
    rdf, xml = f"{{{E.RDF}}}", "{http://www.w3.org/XML/1998/namespace}"
    root, out, blank = ET.fromstring(text), [], 0
    base = root.get(xml + "base", "")

    def full(x: str) -> str:
        return x if ":" in x else base + x if x.startswith("#") or not base else base.rstrip("#") + "#" + x

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1)

    def fresh() -> str:
        nonlocal blank
        blank += 1
        return f"_:x{zlib.crc32(file.encode())}x{blank}"

    def node(el: ET.Element) -> str:
        s = full(el.get(rdf + "about")) if el.get(rdf + "about") is not None else full("#" + el.get(rdf + "ID")) if el.get(rdf + "ID") else "_:" + el.get(rdf + "nodeID") if el.get(rdf + "nodeID") else fresh()
        if el.tag != rdf + "Description":
            out.append((s, E.RDF + "type", name(el.tag), "iri", None, None))
        for a, v in el.attrib.items():
            if not a.startswith((rdf, xml)):
                out.append((s, name(a), v, "lit", E.XSD + "string", None))
        for child in el:
            prop(s, child)
        return s

    def prop(s: str, el: ET.Element) -> None:
        p, parse = name(el.tag), el.get(rdf + "parseType")
        resource, ref = el.get(rdf + "resource"), el.get(rdf + "nodeID")
        if resource is not None:
            out.append((s, p, full(resource), "iri", None, None))
        elif ref is not None:
            out.append((s, p, "_:" + ref, "bnode", None, None))
        elif parse == "Collection":
            rest = E.RDF + "nil"
            for item in reversed([node(x) for x in el]):
                b = fresh()
                out.append((b, E.RDF + "first", item, "bnode" if item.startswith("_:") else "iri", None, None))
                out.append((b, E.RDF + "rest", rest, "bnode" if rest.startswith("_:") else "iri", None, None))
                rest = b
            out.append((s, p, rest, "bnode" if rest.startswith("_:") else "iri", None, None))
        elif parse == "Resource":
            b = fresh()
            out.append((s, p, b, "bnode", None, None))
            for x in el:
                prop(b, x)
        elif len(el):
            o = node(el[0])
            out.append((s, p, o, "bnode" if o.startswith("_:") else "iri", None, None))
        else:
            lang = el.get(xml + "lang")
            out.append((s, p, el.text or "", "lit", el.get(rdf + "datatype") or (E.RDF + "langString" if lang else E.XSD + "string"), lang))

    for el in root if root.tag == rdf + "RDF" else [root]:
        node(el)
    return out


def parse_jsonld(text: str, file: str = "") -> list[tuple]:
    """Triples of JSON-LD: one document, or one a line; expanded names, ``@context`` with a vocabulary, prefixes and terms, ``@graph``, lists, nested nodes."""
    out, blank = [], 0
    try:
        docs = [json.loads(text)]
    except ValueError:
        docs = [json.loads(line) for line in text.splitlines() if line.strip()]

    def full(x: str, context: dict) -> str:
        term = context.get(x)
        if isinstance(term, dict):
            term = term.get("@id")
        if term:
            return full(term, {k: v for k, v in context.items() if k != x})
        head, colon, tail = x.partition(":")
        if colon and isinstance(context.get(head), str) and not tail.startswith("//"):
            return context[head] + tail
        return x if colon else context.get("@vocab", "") + x

    def fresh() -> str:
        nonlocal blank
        blank += 1
        return f"_:j{zlib.crc32(file.encode())}x{blank}"

    def say(s: str, p: str, v, context: dict) -> None:  # noqa: ANN001
        out.append((s, p, *value(v, p, context)))

    def value(v, p: str, context: dict) -> tuple:  # noqa: ANN001
        if isinstance(v, dict) and "@list" in v:
            rest = (E.RDF + "nil", "iri", None, None)
            for item in reversed(v["@list"]):
                b = fresh()
                out.append((b, E.RDF + "first", *value(item, p, context)))
                out.append((b, E.RDF + "rest", *rest))
                rest = (b, "bnode", None, None)
            return rest
        if isinstance(v, dict) and "@value" in v:
            lex, lang = v["@value"], v.get("@language")
            plain = lex if isinstance(lex, str) else json.dumps(lex)
            kind = E.RDF + "langString" if lang else full(v["@type"], context) if v.get("@type") else typed(lex)
            return plain, "lit", kind, lang
        if isinstance(v, dict):
            o = node(v, context)
            return o, "bnode" if o.startswith("_:") else "iri", None, None
        return v if isinstance(v, str) else json.dumps(v), "lit", typed(v), None

    def typed(v) -> str:  # noqa: ANN001
        return E.XSD + ("boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "double" if isinstance(v, float) else "string")

    def node(d: dict, context: dict) -> str:
        own = d.get("@context") or {}
        for c in own if isinstance(own, list) else [own]:
            context = context | (c if isinstance(c, dict) else {})
        s = full(d["@id"], context) if "@id" in d else fresh()
        for key, values in d.items():
            for v in values if isinstance(values, list) else [values]:
                if key == "@type":
                    out.append((s, E.RDF + "type", full(v, context), "iri", None, None))
                elif key == "@graph":
                    node(v, context)
                elif key[0] != "@":
                    term = context.get(key)
                    if isinstance(v, str) and isinstance(term, dict) and "@type" in term:
                        v = {"@id": v} if term["@type"] == "@id" else {"@value": v, "@type": term["@type"]}
                    say(s, full(key, context), v, context)
        return s

    for doc in docs:
        for d in doc if isinstance(doc, list) else [doc]:
            node(d, {})
    return out


PARSERS = {"turtle": parse_turtle, "rdfxml": parse_rdfxml, "jsonld": parse_jsonld}
FORMATS = {"nt": "ntriples", "ntriples": "ntriples", "nq": "ntriples", "nquads": "ntriples", "ttl": "turtle", "turtle": "turtle", "owl": "rdfxml", "rdf": "rdfxml", "xml": "rdfxml", "rdfxml": "rdfxml", "trig": "trig", "n3": "turtle", "jsonld": "jsonld", "json": "jsonld"}


_QUOTED = r"(?:\"[^\"<]*\"|'[^'<]*')"
_XML_OPEN, _XML_END = f'<rdf:RDF xmlns:rdf="{E.RDF}">', "</rdf:RDF>"
_XML_LINE = rf"^<rdf:Description rdf:(?:about|nodeID)={_QUOTED}><q:([^\s<>/=]+) xmlns:q={_QUOTED}(?: (?:rdf:(?:resource|nodeID|datatype)|xml:lang)={_QUOTED})?(?:/>|>[^<]*</q:\1>)</rdf:Description>$"


def _is_lined(spark: SparkSession, path: str, fmt: str) -> bool:
    """Whether every line of the files is a statement (or node object) of its own, as ``save`` writes them.

    The first lines are asked alone, so that a document that spans lines is found out without reading it twice.
    """
    value = F.col("value")
    if fmt in ("turtle", "trig"):
        good = _blank(value) | ((F.size(_parts(value, _TURTLE_LINE)) == 6) if fmt == "turtle" else value.rlike(_GRAPH_LINE) & (F.size(_parts(F.regexp_replace(value, _GRAPH_LINE, "$1"), _TURTLE_LINE)) == 6))
    elif fmt == "rdfxml":
        good = value.isin(_XML_OPEN, _XML_END) | value.rlike(_XML_LINE)
    else:
        good = value.rlike(r"^\s*$") | F.try_parse_json(value).isNotNull()
    lines = spark.read.text(path)
    return lines.limit(100).where(~good).isEmpty() and lines.where(~good).isEmpty()


def _read_lined(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Triples of files whose lines stand by themselves, by all tasks."""
    if fmt in ("turtle", "trig"):
        return read_ntriples(spark, path, graphs=fmt == "trig")
    names = ["s", "p", "o", "o_kind", "dt", "lang"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                values = part.column(1).to_pylist()
                if fmt == "rdfxml":
                    out = parse_rdfxml("".join([_XML_OPEN, *[v for v in values if v not in (_XML_OPEN, _XML_END)], _XML_END]))
                else:  # blank nodes without a name take the line's place
                    files = part.column(0).to_pylist()
                    out = [t for k, (file, v) in enumerate(zip(files, values, strict=True)) if v.strip() for t in parse_jsonld(v, f"{file} {no + k}")]
                    no += len(values)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names)

    place = F.concat_ws(" ", F.input_file_name(), F.spark_partition_id())
    return arrow_rows(spark.read.text(path).select(place.alias("place"), "value"), rows, SCHEMA)


def read_triples(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Triples of RDF files; the format is taken from the path's ending if not given."""
    fmt = FORMATS.get((fmt or path.rsplit(".", 1)[-1]).lower())
    if fmt is None:
        raise ValueError(f"unknown format of {path}")
    if fmt == "ntriples":
        return read_ntriples(spark, path)
    if _is_lined(spark, path, fmt):
        return _read_lined(spark, path, fmt)
    if fmt == "trig":
        fmt = "turtle"
    ship(spark)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, text in zip(batch["path"], batch["value"], strict=True):
                out = PARSERS[fmt](text, file)
                for at in range(0, len(out), 10_000):
                    yield pd.DataFrame(out[at : at + 10_000], columns=["s", "p", "o", "o_kind", "dt", "lang"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(rows, SCHEMA)


#: Predicate of each table of pairs, with the table's columns.
PAIRS = {
    "sub_class": (E.RDFS + "subClassOf", "sub", "sup"), "sub_prop": (E.RDFS + "subPropertyOf", "sub", "sup"), "inverse_prop": (E.OWL + "inverseOf", "p", "q"), "domain": (E.RDFS + "domain", "p", "cls"), "range": (E.RDFS + "range", "p", "cls"),
    "disjoint_class": (E.OWL + "disjointWith", "a", "b"), "equivalent_class": (E.OWL + "equivalentClass", "a", "b"), "equivalent_prop": (E.OWL + "equivalentProperty", "a", "b"), "disjoint_prop": (E.OWL + "propertyDisjointWith", "a", "b"),
    "same_as": (E.OWL + "sameAs", "a", "b"), "different_from": (E.OWL + "differentFrom", "a", "b"),
}
CHARACTERISTICS = ("FunctionalProperty", "InverseFunctionalProperty", "SymmetricProperty", "AsymmetricProperty", "TransitiveProperty", "ReflexiveProperty", "IrreflexiveProperty")
ENTITIES = ("Class", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "NamedIndividual", "Ontology", "Datatype")
ANNOTATIONS = (E.RDFS + "label", E.RDFS + "comment", E.RDFS + "seeAlso", E.RDFS + "isDefinedBy", E.OWL + "versionInfo")


#: What a triple is to a graph; rows with blank nodes, and those of no table, have roles of their own.
ROLES = ("blank", "type", "pair", "note", "link", "value", "other")


def _stored(triples: DataFrame) -> tuple[DataFrame, DataFrame, Callable[[str], DataFrame]]:
    """The triples, those without blank nodes, and those of a role, from one copy that is stored apart by role."""
    p, kind = F.col("p"), F.coalesce(F.col("o_kind"), F.lit(""))
    reserved = [q for q, _, _ in PAIRS.values()] + [E.OWL + "imports", E.RDF + "first", E.RDF + "rest", *owl_rdf.BUILT]
    role = F.when(F.coalesce(F.col("s").startswith("_:"), F.lit(True)) | (kind == "bnode") | p.isNull(), "blank").when(p == E.RDF + "type", "type").when(p.isin(*[q for q, _, _ in PAIRS.values()]), "pair")
    role = role.when(p.isin(*ANNOTATIONS), "note").when(p.isin(*reserved), "other").when(kind == "iri", "link").when(kind == "lit", "value").otherwise("other")
    number = F.create_map(*[F.lit(x) for i, r in enumerate(ROLES) for x in (r, i)])
    at = f"{checkpoint_dir(triples.sparkSession)}/triples-{uuid.uuid4().hex}"
    triples.select("s", "p", "o", "o_kind", "dt", "lang", number[role].alias("role")).write.partitionBy("role").parquet(at)
    kept = triples.sparkSession.read.schema(f"{SCHEMA}, role int").parquet(at)
    of = lambda name: kept.where(F.col("role") == ROLES.index(name)).drop("role")
    return kept.drop("role"), kept.where(F.col("role") != 0).drop("role"), of


def graph_of(triples: DataFrame) -> TripleGraph:
    """Triples sorted into a graph's tables by their predicates.

    Blank nodes that build class expressions, lists and negative assertions become rows of the tables of complex axioms;
    individuals without a name stay out of the tables. The triples are read (and parsed) once and stored by role; a table reads
    the roles that it is made of.
    """
    spark = triples.sparkSession
    triples, named, role = _stored(triples)
    types = role("type")
    entity = types.where(F.col("o").isin(*[E.OWL + x for x in ENTITIES])).select(F.col("s").alias("iri"), F.expr(f"substring(o, {len(E.OWL) + 1})").alias("kind")).distinct()
    schema_terms = F.col("o").startswith(E.OWL) & (F.col("o") != E.OWL + "Thing") | F.col("o").startswith(E.RDFS) | F.col("o").startswith(E.RDF)
    tables = {name: role("pair").where((F.col("p") == p) & (F.col("o_kind") == "iri")).select(F.col("s").alias(a), F.col("o").alias(b)) for name, (p, a, b) in PAIRS.items()}
    tables |= {
        "entity": entity,
        "individuals": entity.where("kind = 'NamedIndividual'").select(F.col("iri").alias("ind")),
        "class_assertion": types.where(~schema_terms).select(F.col("o").alias("cls"), F.col("s").alias("ind")),
        "obj_assertion": role("link").select("p", "s", "o"),
        "data_assertion": role("value").select("p", "s", F.col("o").alias("lex"), "dt"),
        "characteristic": types.where(F.col("o").isin(*[E.OWL + x for x in CHARACTERISTICS])).select(F.col("s").alias("p"), F.expr(f"substring(o, {len(E.OWL) + 1})").alias("name")),
        "annotation": role("note").where("o_kind = 'lit'").select("s", "p", F.col("o").alias("value")),
        "iri_annotation": role("note").where("o_kind = 'iri'").select("s", "p", F.col("o").alias("value")),
        "language": named.where("lang is not null").select("p", "s", F.col("o").alias("lex"), "lang"),
    }
    if not role("blank").where(F.col("s").startswith("_:")).isEmpty() or not triples.where(F.col("p").isin(E.OWL + "hasKey", E.OWL + "disjointUnionOf")).isEmpty():
        tables |= owl_rdf.read(triples, tables)
    return TripleGraph(spark, tables)


def triples_of(graph: TripleGraph) -> DataFrame:
    """A graph's tables as distinct triples."""
    t = graph.tables
    null = F.lit(None).cast("string")

    def iri(df: DataFrame, s: str, p: Column, o: Column) -> DataFrame:
        return df.select(F.col(s).alias("s"), p.alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), null.alias("dt"), null.alias("lang"))

    frames = [iri(t[name], a, F.lit(p), F.col(b)) for name, (p, a, b) in PAIRS.items()]
    frames.append(iri(t["entity"], "iri", F.lit(E.RDF + "type"), F.concat(F.lit(E.OWL), "kind")))
    frames.append(iri(t["individuals"], "ind", F.lit(E.RDF + "type"), F.lit(E.OWL + "NamedIndividual")))
    frames.append(iri(t["class_assertion"], "ind", F.lit(E.RDF + "type"), F.col("cls")))
    frames.append(iri(t["characteristic"], "p", F.lit(E.RDF + "type"), F.concat(F.lit(E.OWL), "name")))
    frames.append(iri(t["obj_assertion"], "s", F.col("p"), F.col("o")))
    said = t["language"].select(F.col("p").alias("p2"), F.col("s").alias("s2"), F.col("lex").alias("lex2"), "lang").distinct()
    tagged = (F.col("p") == F.col("p2")) & (F.col("s") == F.col("s2")) & (F.col("o") == F.col("lex2"))
    values = t["data_assertion"].select("s", "p", F.col("lex").alias("o"), "dt").unionAll(t["annotation"].select("s", "p", "value", F.lit(E.XSD + "string")))
    notes = F.col("p").isin(*ANNOTATIONS)
    plain = values.where((F.col("dt") != E.RDF + "langString") & ~notes | F.col("dt").isNull())
    spoken = values.where((F.col("dt") == E.RDF + "langString") | notes).join(said, tagged, "left")
    dt = F.when(F.col("lang").isNotNull(), E.RDF + "langString").otherwise(F.col("dt"))
    frames.append(plain.select("s", "p", "o", F.lit("lit").alias("o_kind"), "dt", null.alias("lang")))
    frames.append(spoken.select("s", "p", "o", F.lit("lit").alias("o_kind"), dt.alias("dt"), "lang"))
    frames.append(iri(t["iri_annotation"], "s", F.col("p"), F.col("value")))
    frames.append(owl_rdf.written(graph))
    return reduce(DataFrame.unionByName, frames).where("s is not null and o is not null").distinct()


def save(graph: TripleGraph, path: str, fmt: str = "ntriples", context: str = "urn:graph") -> None:
    """Writes a graph as a folder of part files: ntriples, nquads, turtle, n3, trig, functional, dl, jsonld or rdfxml (a document a part)."""
    if fmt in ("functional", "dl"):
        axiom_lines(graph, fmt).write.text(path)
        return
    t = triples_of(graph)
    if fmt == "trig":
        t.select(F.concat(F.lit(f"GRAPH <{context}> {{ "), _line(t), F.lit(" . }")).alias("value")).write.text(path)
    elif fmt in ("ntriples", "nquads"):
        tail = " ." if fmt == "ntriples" else f" <{context}> ."
        t.select(F.concat(_line(t), F.lit(tail)).alias("value")).write.text(path)
    elif fmt in ("turtle", "n3"):  # a statement a line is Turtle too; subjects are grouped within a part
        t.sortWithinPartitions("s", "p").select(F.concat(_line(t), F.lit(" .")).alias("value")).write.text(path)
    elif fmt == "jsonld":  # a statement a node object: objects of one node may repeat, so a hub isn't gathered
        tagged = F.when(F.col("lang").isNull(), F.col("dt"))
        value = F.when(F.col("o_kind") == "lit", F.to_json(F.struct(F.col("o").alias("@value"), tagged.alias("@type"), F.col("lang").alias("@language")))).otherwise(F.to_json(F.struct(F.col("o").alias("@id"))))
        quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":(.*)\}$', 1)
        t.select(F.concat(F.lit('{"@id":'), quoted("s"), F.lit(","), quoted("p"), F.lit(":["), value, F.lit("]}")).alias("value")).write.text(path)
    elif fmt == "rdfxml":
        ship(graph.spark)
        t.sortWithinPartitions("s").mapInPandas(_xml_parts, "value string").write.text(path)
    else:
        raise ValueError(f"can't write {fmt}")


#: Functional and DL notation of a row of each table; the columns stand in braces.
NOTATIONS = {
    "sub_class": ("SubClassOf({sub} {sup})", "{sub} ⊑ {sup}"), "equivalent_class": ("EquivalentClasses({a} {b})", "{a} ≡ {b}"), "disjoint_class": ("DisjointClasses({a} {b})", "{a} ⊓ {b} ⊑ ⊥"),
    "sub_prop": ("SubObjectPropertyOf({sub} {sup})", "{sub} ⊑ {sup}"), "equivalent_prop": ("EquivalentObjectProperties({a} {b})", "{a} ≡ {b}"), "disjoint_prop": ("DisjointObjectProperties({a} {b})", "{a} ⊓ {b} ⊑ ⊥"), "inverse_prop": ("InverseObjectProperties({p} {q})", "{p} ≡ {q}⁻"),
    "domain": ("ObjectPropertyDomain({p} {cls})", "∃ {p}.⊤ ⊑ {cls}"), "range": ("ObjectPropertyRange({p} {cls})", "⊤ ⊑ ∀ {p}.{cls}"), "same_as": ("SameIndividual({a} {b})", "{a} = {b}"), "different_from": ("DifferentIndividuals({a} {b})", "{a} ≠ {b}"),
    "class_assertion": ("ClassAssertion({cls} {ind})", "{cls}({ind})"), "obj_assertion": ("ObjectPropertyAssertion({p} {s} {o})", "{p}({s}, {o})"), "data_assertion": ("DataPropertyAssertion({p} {s} {literal})", "{p}({s}, {literal})"),
}


def axiom_lines(graph: TripleGraph, notation: str = "functional") -> DataFrame:
    """``value``: an axiom a line, in functional or DL notation."""
    frames = []
    for table, forms in NOTATIONS.items():
        df = graph.table(table)
        quoted = F.concat(F.lit('"'), F.replace(F.replace(F.col("lex"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"^^<'), F.col("dt"), F.lit(">")) if table == "data_assertion" else None
        parts = []
        for i, piece in enumerate(re.split(r"[{}]", forms[notation == "dl"])):
            if piece:
                parts.append(F.lit(piece) if i % 2 == 0 else quoted if piece == "literal" else F.concat(F.lit("<"), F.col(piece), F.lit(">")))
        frames.append(df.select(F.concat(*parts).alias("value")))
    return reduce(DataFrame.unionAll, frames).where("value is not null").distinct()


def _xml_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One RDF/XML document for a task's rows."""
    opened = False
    for batch in batches:
        lines = [_xml_line(*row) for row in batch[["s", "p", "o", "o_kind", "dt", "lang"]].itertuples(index=False)]
        if lines:
            yield pd.DataFrame({"value": lines if opened else [_XML_OPEN, *lines]})
            opened = True
    if opened:
        yield pd.DataFrame({"value": [_XML_END]})


_BREAKS = {"\n": "&#10;", "\r": "&#13;"}


def _xml_line(s: str, p: str, o: str, kind: str, dt: str | None, lang: str | None) -> str:
    cut = max(p.rfind("#"), p.rfind("/"), p.rfind(":")) + 1
    about = f"rdf:nodeID={quoteattr(s[2:])}" if s.startswith("_:") else f"rdf:about={quoteattr(s)}"
    tag = f"q:{p[cut:]} xmlns:q={quoteattr(p[:cut])}"
    if kind == "lit":
        extra = f" xml:lang={quoteattr(lang)}" if lang else f" rdf:datatype={quoteattr(dt)}"
        body = f"<{tag}{extra}>{escape(o, _BREAKS)}</q:{p[cut:]}>"
    else:
        body = f"<{tag} " + (f"rdf:nodeID={quoteattr(o[2:])}" if o.startswith("_:") else f"rdf:resource={quoteattr(o)}") + "/>"
    return f"<rdf:Description {about}>{body}</rdf:Description>"


def load(spark: SparkSession, path: str, fmt: str | None = None) -> TripleGraph:
    """An ontology from RDF files."""
    return graph_of(read_triples(spark, path, fmt))


def empty(spark: SparkSession) -> TripleGraph:
    """A graph without statements."""
    return TripleGraph(spark)


__all__ = ["TABLES", "empty", "graph_of", "load", "parse_rdfxml", "parse_turtle", "read_ntriples", "read_triples", "save", "triples_of"]
