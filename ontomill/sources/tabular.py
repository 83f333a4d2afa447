"""CSV and JSON as graphs and back, and text files as documents."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontomill.functions.text import column_name, guessed_datatype
from ontomill.plans.expr import XSD
from ontomill.plans.ship import ship
from ontomill.sources.graphs import TripleGraph

_DATATYPES = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime"}


def numbered(table: DataFrame) -> DataFrame:
    """``table`` with ``__row``, each row's place: partitions are counted in one pass, a row adds those before its own.

    The table of counts has a row for each partition of the input, so it is broadcast.
    """
    placed = table.withColumn("__id", F.monotonically_increasing_id()).withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn("__row", F.col("__before") + F.col("__at")).drop("__id", "__part", "__at", "__before")


def rows_to_graph(table: DataFrame, namespace: str, key: str | None = None) -> TripleGraph:
    """Every row an individual, every column a data property, every cell that isn't null a typed literal.

    A row's name is ``namespace`` and its ``key`` column, or its place in the table if no key is named (see ``numbered``).
    """
    spark = table.sparkSession
    columns = table.columns
    keyed, key = (table, key) if key else (numbered(table), "__row")
    cells = []
    for c in columns:
        kind = table.schema[c].dataType.simpleString()
        dt = XSD + ("decimal" if kind.startswith("decimal") else _DATATYPES.get(kind, "string"))
        lex = F.date_format(F.col(f"`{c}`"), "yyyy-MM-dd'T'HH:mm:ss") if dt == XSD + "dateTime" else F.col(f"`{c}`").cast("string")
        cells.append(F.struct(F.concat(F.lit(namespace), column_name(F.lit(c))).alias("p"), lex.alias("lex"), F.lit(dt).alias("dt")))
    name = F.concat(F.lit(namespace), F.col(f"`{key}`").cast("string"))
    data = keyed.select(name.alias("s"), F.explode(F.array(*cells)).alias("x")).select("x.p", "s", "x.lex", "x.dt").where("lex is not null")
    return TripleGraph(spark, {"individuals": keyed.select(name.alias("ind")), "data_assertion": data})


def read_csv(spark: SparkSession, path: str, namespace: str, key: str | None = None, schema: str | None = None) -> TripleGraph:
    """A CSV file with a header as a graph; without a schema the types are inferred, which reads the file once more."""
    reader = spark.read.option("header", True)
    return rows_to_graph(reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path), namespace, key)


def graph_to_rows(graph: TripleGraph, properties: list[str] | None = None) -> DataFrame:
    """A row for each individual with data and a column for each data property; several values of one keep the least; ``nan`` counts as missing."""
    data = graph.table("data_assertion").where("lower(lex) <> 'nan'").withColumn("p", F.regexp_extract("p", r"([^/:#]*)$", 1))
    if properties is None:
        properties = sorted(r.p for r in data.select("p").distinct().collect())
    return data.groupBy(F.col("s").alias("ind")).pivot("p", properties).agg(F.min("lex"))


def write_csv(graph: TripleGraph, path: str) -> None:
    graph_to_rows(graph).write.option("header", True).csv(path)


QUADRUPLES = "graphs array<struct<quadruples: array<struct<subject: string, predicate: string, object: string>>>>"


def quadruples_to_graph(quads: DataFrame, namespace: str) -> TripleGraph:
    """Statements (subject, predicate, object) as a graph: a predicate links individuals if any of its objects is a subject, else it holds literals, whose types are guessed."""
    name = lambda c: F.concat(F.lit(namespace), F.regexp_replace(F.trim(c), r"\s+", "_"))
    q = quads.select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o")).where("s is not null and p is not null and o is not null").distinct()
    subjects = q.select(F.col("s").alias("known")).distinct()
    links = q.join(subjects, q["o"] == F.col("known"), "left").groupBy("p").agg(F.bool_or(F.col("known").isNotNull()).alias("links"))
    q = q.join(links, "p")
    obj = q.where("links").select(name(F.col("p")).alias("p"), name(F.col("s")).alias("s"), name(F.col("o")).alias("o"))
    dt = F.when(F.col("o").try_cast("bigint").isNotNull() & F.col("o").rlike(r"^\s*[+-]?\d+\s*$"), XSD + "integer").when(F.col("o").try_cast("double").isNotNull(), XSD + "double").otherwise(XSD + "string")
    data = q.where("not links").select(name(F.col("p")).alias("p"), name(F.col("s")).alias("s"), F.col("o").alias("lex"), dt.alias("dt"))
    inds = obj.select(F.col("s").alias("ind")).unionAll(obj.select("o")).unionAll(data.select("s")).distinct()
    return TripleGraph(quads.sparkSession, {"individuals": inds, "obj_assertion": obj, "data_assertion": data})


def read_quadruples(spark: SparkSession, path: str, namespace: str) -> TripleGraph:
    """A JSON file ``{graphs: [{quadruples: [{subject, predicate, object}]}]}`` as a graph."""
    flat = spark.read.schema(QUADRUPLES).option("multiLine", True).json(path).select(F.explode("graphs").alias("g")).select(F.explode("g.quadruples").alias("q"))
    return quadruples_to_graph(flat.select("q.*"), namespace)


def guessed_literals(texts: DataFrame, column: str) -> DataFrame:
    """``texts`` with ``dt``, the datatype that a value's form suggests."""
    return texts.withColumn("dt", guessed_datatype(F.col(column)))


# ---- text files


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def html_to_text(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    return " ".join(parser.parts)


def rtf_to_text(rtf: str) -> str:
    """Plain text of RTF: groups of fonts, colours and pictures dropped, paragraphs to newlines, codes to characters."""
    rtf = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|pict)(?:[^{}]|\{[^{}]*\})*\}", "", rtf)
    rtf = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), rtf)
    rtf = re.sub(r"\\u(-?\d+)\s?\??", lambda m: chr(int(m[1]) % 65536), rtf)
    rtf = re.sub(r"\\(?:par|line)\b ?", "\n", rtf)
    rtf = re.sub(r"\\[a-zA-Z]+-?\d* ?", "", rtf)
    return re.sub(r"[{}]", "", rtf).strip()


def docx_to_text(data: bytes) -> str:
    """The paragraphs of a DOCX file."""
    import xml.etree.ElementTree as ET

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ET.fromstring(zipfile.ZipFile(BytesIO(data)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def decoded(data: bytes) -> str:
    for encoding in ("utf-8", "cp1252", "latin-1"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return ""


def pdf_to_text(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("reading PDF needs the pypdf package") from e
    return "\n".join(page.extract_text() or "" for page in PdfReader(BytesIO(data)).pages)


def text_of_file(name: str, data: bytes) -> str:
    """A file's text by its name's ending."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind in ("html", "htm"):
        return html_to_text(decoded(data))
    if kind == "rtf":
        return rtf_to_text(decoded(data))
    if kind == "docx":
        return docx_to_text(data)
    return pdf_to_text(data) if kind == "pdf" else decoded(data)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of text, HTML, RTF, DOCX and PDF files, a row a file."""
    ship(spark)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [text_of_file(p, bytes(d)) for p, d in zip(batch["path"], batch["content"], strict=True)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, text string")


def html_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, text`` of pages by a real HTML parser, in Arrow batches; ``functions.text.html_text`` is the plain-expression form."""
    ship(pages.sparkSession)

    def rows(html: pd.Series) -> pd.Series:
        return html.map(html_to_text)

    return pages.select(F.col(id_col).alias("id"), F.pandas_udf(rows, "string", F.PandasUDFType.SCALAR)(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))


def typed_columns(table: DataFrame, casts: dict[str, str]) -> DataFrame:
    """``table`` with columns tried as other types; what doesn't fit becomes null."""
    def tried(c: str) -> Column:
        return F.col(c).try_cast(casts[c])

    return table.withColumns({c: tried(c) for c in casts})


def save_expressions(spark: SparkSession, expressions: list, path: str) -> None:
    """Class expressions as rows ``i, dl, manchester``."""
    from ontomill.plans.syntax import render_dl, render_manchester

    rows = [(i, render_dl(c, lambda x: f"<{x}>"), render_manchester(c, lambda x: f"<{x}>")) for i, c in enumerate(expressions)]
    spark.createDataFrame(rows, "i int, dl string, manchester string").write.json(path)


def select_remote(spark: SparkSession, endpoint: str, sparql: str, timeout: float = 60) -> DataFrame:
    """The rows that a SPARQL endpoint answers, every value as text; the answer is one response, bounded by the endpoint."""
    import json
    import urllib.parse
    import urllib.request

    request = urllib.request.Request(endpoint, urllib.parse.urlencode({"query": sparql}).encode(), {"Accept": "application/sparql-results+json"})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        answer = json.load(response)
    names = answer["head"]["vars"]
    rows = [tuple(b[n]["value"] if n in b else None for n in names) for b in answer["results"]["bindings"]]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
