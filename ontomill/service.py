"""Front ends: a command line for inference, and a small HTTP service over a loaded graph."""

from __future__ import annotations

import argparse
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ontomill.operators import materialise
from ontomill.operators.retrieval import Reasoner
from ontomill.operators.schema import Schema
from ontomill.plans.syntax import parse_dl, parse_manchester
from ontomill.sources import rdf
from ontomill.sources.graphs import TripleGraph

#: Rows of one answer; ``next`` in the answer says that there are more.
PAGE = 10_000


def answer(graph: TripleGraph, path: str, body: dict) -> dict:
    """The answer to one request: instances, classes, object_properties, data_properties, individuals, abox, tbox, infer_axioms.

    Answers come in order, a page at a time; where ``next`` is true, the same request with ``after`` set to the last result goes on.
    """
    schema = Schema(graph)
    if path == "/instances":
        parse = parse_manchester if body.get("syntax") == "manchester" else parse_dl
        df = Reasoner(graph).instances(parse(body["expression"], body.get("namespace", "")))
    elif path == "/classes":
        df = schema.classes()
    elif path in ("/object_properties", "/data_properties"):
        df = schema.properties(path[1:].split("_")[0])
    elif path == "/individuals":
        df = graph.universe_frame()
    elif path in ("/abox", "/tbox"):
        df = rdf.triples_of(graph)
        assertion = (df.o_kind == "lit") | ~(df.p.startswith("http://www.w3.org/2000/01/rdf-schema#") | df.p.startswith("http://www.w3.org/2002/07/owl#") | df.o.startswith("http://www.w3.org/2002/07/owl#"))
        df = df.where(assertion if path == "/abox" else ~assertion)
    elif path == "/infer_axioms":
        df = materialise.inferred(graph, tuple(body.get("types") or materialise.GENERATORS))
    else:
        raise KeyError(path)
    if (after := body.get("after")) is not None:
        known = [after[c] for c in df.columns] if isinstance(after, dict) else [after]
        df = df.where(F.struct(*df.columns) > F.struct(*[F.lit(v).alias(c) for c, v in zip(df.columns, known, strict=True)]))
    rows = df.orderBy(*df.columns).limit(PAGE + 1).collect()
    return {"results": [r.asDict() if len(r) > 1 else r[0] for r in rows[:PAGE]], "next": len(rows) > PAGE}


def serve(graph: TripleGraph, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server of ``answer`` by POST of JSON; the caller runs and closes it."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                code, out = 200, answer(graph, self.path, body)
            except KeyError as e:
                code, out = 404, {"error": f"no such service or field: {e}"}
            except (ValueError, TypeError) as e:
                code, out = 400, {"error": str(e)}
            data = json.dumps(out, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST  # noqa: N815

        def log_message(self, *args) -> None:  # noqa: ANN002
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main(argv: list[str] | None = None) -> None:
    """``python -m ontomill.service GRAPH --out FOLDER``: writes the inferred statements; ``--serve PORT`` answers requests."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("graph")
    p.add_argument("--format")
    p.add_argument("--out")
    p.add_argument("--types", nargs="*", default=None)
    p.add_argument("--serve", type=int)
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    graph = rdf.load(spark, args.graph, args.format)
    if args.out:
        materialise.inferred(graph, tuple(args.types or materialise.GENERATORS)).write.parquet(args.out)
    if args.serve:
        serve(graph, port=args.serve).serve_forever()


if __name__ == "__main__":
    main()
