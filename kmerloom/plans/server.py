"""The facade over HTTP: POST /search and /align, GET /column_labels and /stats, all in JSON; and a client of it.

The server is the driver: each request is a thread that submits Spark jobs, and only results bounded by the
request's number of labels come back to it. A request that is not well formed is answered with status
400 and ``error``; an unknown path with 404.
"""

from __future__ import annotations

import json
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread
from urllib.error import HTTPError
from urllib.parse import parse_qs, urlparse
from urllib.request import Request, urlopen

from pyspark.sql import functions as F

from ..functions.text import label_json
from ..operators.align import top
from .api import TOP_LABELS, BadRequest, Service

FLAGS = ("with_signature", "abundance_sum", "query_counts", "query_coords")
# The names that results have in the service's JSON.
_SHOWN = {"matches": "kmer_count", "total": "kmer_count", "abundances": "kmer_abundances", "coords": "kmer_coords", "mask": "signature", "score": "score"}


def _value(body: dict, name: str, default, kind: type):
    """A field of the request; a bool is no number, and a whole number does for a float."""
    x = body.get(name, default)
    if kind is float and type(x) is int:
        x = float(x)
    if x is not None and type(x) is not kind:
        raise BadRequest(f"{name} must be of type {kind.__name__}")
    return x


def search(service: Service, body: dict) -> list[dict]:
    """For each sequence its description and results, best first."""
    fasta = _value(body, "FASTA", "", str)
    found = service.search(
        fasta, _value(body, "top_labels", TOP_LABELS, int), _value(body, "discovery_fraction", 0.7, float),
        _value(body, "graphs", None, list), **{f: _value(body, f, False, bool) for f in FLAGS},
    )
    values = [c for c in _SHOWN if c in found.columns]
    rows: dict[int, list] = {}
    for x in found.withColumn("_j", label_json("label")).withColumn("properties", F.to_json("_j.properties")).withColumn("sample", F.col("_j.sample")).drop("_j").collect():
        rows.setdefault(x.query_id, []).append(x)
    order = lambda x: (*(-(x[c] or 0) for c in ("matches", "total") if c in values), x["graph"], x["label"])
    out = []
    for q in service.queries(fasta).orderBy("query_id").collect():
        results = [{"sample": x["sample"], **({"properties": json.loads(x["properties"])} if x["properties"] not in (None, "{}") else {}), **{_SHOWN[c]: x[c] for c in values if x[c] is not None}} for x in sorted(rows.get(q.query_id, []), key=order)]
        out.append({"seq_description": q["name"], "results": results})
    return out


def align(service: Service, body: dict) -> list[dict]:
    """For each sequence its description and alignments, best first."""
    fasta, graph = _value(body, "FASTA", "", str), _value(body, "graph", None, str)
    if graph is None:
        if len(service.graphs) != 1:
            raise BadRequest("name the graph to align to")
        graph = next(iter(service.graphs))
    found = service.align(fasta, graph, _value(body, "both_strands", False, bool), min_match=_value(body, "min_exact_match", 0.0, float))
    rows: dict[int, list] = {}
    for x in top(found, _value(body, "max_alternative_alignments", 1, int)).collect():
        rows.setdefault(x.query_id, []).append({"score": x.score, "sequence": x.sequence, "cigar": x.cigar, "orientation": x.orientation, "matches": x.matches})
    return [{"seq_description": q["name"], "alignments": sorted(rows.get(q.query_id, []), key=lambda a: -a["score"])} for q in service.queries(fasta).orderBy("query_id").collect()]


def column_labels(service: Service, asked: dict[str, list[str]]) -> list[str]:
    return sorted(x.label for x in service.column_labels(asked.get("graphs")).select("label").distinct().collect())


def stats(service: Service, asked: dict[str, list[str]]) -> dict:
    names = asked.get("graphs") or list(service.indexes)
    return {n: service.stats(n) for n in names}


_POSTS = {"/search": search, "/align": align}
_GETS = {"/column_labels": column_labels, "/stats": stats}


class _Handler(BaseHTTPRequestHandler):
    service: Service

    def _answer(self, routes: dict, argument) -> None:
        route = routes.get(urlparse(self.path).path)
        try:
            if route is None:
                status, out = 404, {"error": "no such path"}
            else:
                status, out = 200, route(self.service, argument())
        except (BadRequest, json.JSONDecodeError, UnicodeDecodeError) as e:
            status, out = 400, {"error": str(e)}
        except Exception as e:  # a failed job ends its request, not the server
            status, out = 500, {"error": f"{type(e).__name__}: {e}"}
        data = json.dumps(out).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_POST(self) -> None:
        content = self.rfile.read(int(self.headers.get("Content-Length") or 0))

        def body() -> dict:
            x = json.loads(content)
            if not isinstance(x, dict):
                raise BadRequest("the request must be an object")
            return x

        self._answer(_POSTS, body)

    def do_GET(self) -> None:
        self._answer(_GETS, lambda: parse_qs(urlparse(self.path).query))

    def log_message(self, *_) -> None:
        pass


def serve(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server in a thread of its own, on a free port if none is given; ``shutdown`` ends it."""
    server = ThreadingHTTPServer((host, port), type("Handler", (_Handler,), {"service": service}))
    Thread(target=server.serve_forever, daemon=True).start()
    return server


@dataclass
class Client:
    """Asks one server and returns its JSON; an answer of another status is a BadRequest or a RuntimeError."""

    url: str
    timeout: float = 600.0

    def _ask(self, path: str, body: dict | None = None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urlopen(Request(f"{self.url}{path}", data, {"Content-Type": "application/json"}), timeout=self.timeout) as answer:
                return json.load(answer)
        except HTTPError as e:
            error = json.load(e).get("error", "")
            raise (BadRequest(error) if e.code == 400 else RuntimeError(f"status {e.code}: {error}")) from None

    @staticmethod
    def _fasta(sequences: str | list[str]) -> str:
        return "".join(f">{i}\n{s}\n" for i, s in enumerate([sequences] if isinstance(sequences, str) else sequences))

    def search(self, sequences: str | list[str], align_first: str | None = None, **fields) -> list[dict]:
        """align_first: a graph; its best paths are searched instead of the sequences, which themselves are where there is none."""
        if align_first is not None:
            every = [sequences] if isinstance(sequences, str) else sequences
            found = self.align(every, graph=align_first)
            best = [x["alignments"][0] if x["alignments"] else None for x in found]
            out = self.search([b["sequence"] if b else s for b, s in zip(best, every, strict=True)], **fields)
            return [r | ({"best_alignment": b} if b else {}) for r, b in zip(out, best, strict=True)]
        return self._ask("/search", {"FASTA": self._fasta(sequences), **fields})

    def align(self, sequences: str | list[str], **fields) -> list[dict]:
        return self._ask("/align", {"FASTA": self._fasta(sequences), **fields})

    def column_labels(self) -> list[str]:
        return self._ask("/column_labels")

    def stats(self) -> dict:
        return self._ask("/stats")


@dataclass
class Clients:
    """Several servers by name, asked side by side."""

    servers: dict[str, Client]
    workers: int = 8

    def submit(self, sequences: str | list[str], **fields) -> dict[str, Future]:
        """A future for each server."""
        pool = ThreadPoolExecutor(self.workers)
        out = {n: pool.submit(c.search, sequences, **fields) for n, c in self.servers.items()}
        pool.shutdown(wait=False)
        return out

    def search(self, sequences: str | list[str], **fields) -> dict[str, list[dict]]:
        return {n: f.result() for n, f in self.submit(sequences, **fields).items()}
