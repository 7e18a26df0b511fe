"""An HTTP interface over a warm session: /health /sources /stats /compare /ask /product."""

from __future__ import annotations

import json
from dataclasses import asdict, replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pricewright import vocabulary as v
from pricewright.plans.answer import Offer
from pricewright.plans.engine import Engine

OFFER_FIELDS = ("source", "source_name", "source_kind", "url", "title", "colorway", "style_code", "currency", "list_price", "shipping", "fees", "in_stock", "condition", "sizes", "size_prices")


def offer_json(o: Offer) -> dict:
    return {k: o.row[k] for k in OFFER_FIELDS} | {"price": o.unit_price, "from_price": o.row["price"], "total": o.total, "discount_pct": o.discount, "premium_pct": o.premium}


def respond(engine: Engine, path: str, q: dict[str, str]) -> tuple[int, dict]:
    if path == "/health":
        return 200, {"status": "ok"}
    if path == "/sources":
        return 200, {"sources": [{"key": s[0], "name": s[1], "kind": s[6]} for s in v.SITES]}
    if path == "/stats":
        return 200, engine.catalog.stats()
    if path in ("/compare", "/ask"):
        if not q.get("q"):
            return 400, {"error": "q is missing"}
        limit = int(q.get("limit", 3))
        spec = engine.understand(q["q"])
        spec = replace(spec, size=q.get("size", "") or spec.size, condition=q.get("condition", "") or spec.condition)
        if path == "/ask":
            return 200, json.loads(engine.answer(q["q"], limit, spec).to_json())
        spec, found = engine.compare(q["q"], spec, limit)
        return 200, {"spec": asdict(spec), "products": [{"key": p.key, "name": p.name, "offers": [offer_json(o) for o in p.eligible(spec)]} for p in found]}
    if path == "/product":
        if not q.get("code"):
            return 400, {"error": "code is missing"}
        rows, tail = engine.product(q["code"])
        found = [r.asDict() for r in rows.drop("vector", "raw").collect()]
        return (200, {"listings": found, "history": [r.asDict() for r in tail.collect()]}) if found else (404, {"error": "no such code"})
    return 404, {"error": "not found"}


def build_server(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            at = urlsplit(self.path)
            try:
                status, body = respond(engine, at.path, {k: x[0] for k, x in parse_qs(at.query).items()})
            except Exception as e:  # a request must not end the server
                status, body = 500, {"error": str(e)}
            raw = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> None:
    with build_server(engine, host, port) as s:
        s.serve_forever()
