"""Commands: sources, ingest, compare, ask, product, deals, stats, chat, serve."""

from __future__ import annotations

import argparse
import json
import re
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from pricewright import vocabulary as v
from pricewright.functions.text import brand_of
from pricewright.operators.offers import Spec
from pricewright.plans.answer import render
from pricewright.plans.engine import Engine, sticky
from pricewright.session import build
from pricewright.sources.listings import sources


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="pricewright", description=__doc__)
    out.add_argument("--catalog", default="catalog")
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("sources")
    ingest = sub.add_parser("ingest")
    ingest.add_argument("--fixtures", default="fixtures")
    ingest.add_argument("--sites", nargs="*")
    ingest.add_argument("--query", action="append")
    for name in ("compare", "ask"):
        p = sub.add_parser(name)
        p.add_argument("question", nargs="+")
        p.add_argument("--limit", type=int, default=3)
        p.add_argument("--size", default="")
        p.add_argument("--condition", default="", choices=("", "new", "used"))
        p.add_argument("--no-shipping", action="store_true")
        p.add_argument("--json", action="store_true")
    sub.add_parser("product").add_argument("code")
    d = sub.add_parser("deals")
    d.add_argument("--min-pct", type=float, default=10)
    d.add_argument("--brand", default="")
    d.add_argument("--limit", type=int, default=20)
    sub.add_parser("stats")
    sub.add_parser("chat")
    s = sub.add_parser("serve")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--port", type=int, default=8000)
    return out


def spec_of(engine: Engine, args: argparse.Namespace) -> Spec:
    spec = engine.understand(" ".join(args.question))
    return replace(spec, size=args.size or spec.size, condition=args.condition or spec.condition, include_shipping=spec.include_shipping and not args.no_shipping)


def by_size(prices: dict[str, float] | None) -> dict[str, float]:
    """A price curve in the order of sizes as numbers; sizes that are none come last, by name."""
    number = re.compile(r"\d+(?:\.\d+)?")
    return dict(sorted((prices or {}).items(), key=lambda x: (0, float(x[0]), "") if number.fullmatch(x[0]) else (1, 0.0, x[0])))


def canonical_brand(spark: SparkSession, text: str) -> str:
    from pyspark.sql import functions as F

    return spark.range(1).select(brand_of(F.lit(text))).first()[0] if text else ""


def chat(engine: Engine, lines=sys.stdin, out=sys.stdout) -> None:
    """Questions line by line; `/size 10`, `/condition used`, `/brand nike`, `/shipping off`, `/limit 5` hold until `/clear`."""
    held: dict = {}
    limit = 3
    for line in map(str.strip, lines):
        if line in ("/quit", "/exit"):
            return
        if line == "/clear":
            held.clear()
        elif line.startswith("/"):
            key, _, value = line[1:].partition(" ")
            if key == "limit":
                limit = int(value)
            elif key == "shipping":
                held["include_shipping"] = value != "off"
            elif key in ("size", "condition"):
                held[key] = value
            elif key == "brand":
                held["brands"] = (canonical_brand(engine.spark, value),)
            else:
                print("unknown command", file=out)
        elif line:
            print(engine.answer(line, limit, sticky(engine.understand(line), held)).text, file=out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    if args.command == "sources":
        for key, name, home, *_, kind in v.SITES:
            print(f"{key:14}{name:16}{kind:8}{home}", file=out)
        return 0
    engine = Engine(spark or build(), args.catalog)
    if args.command == "ingest":
        print(json.dumps(engine.ingest(sources(engine.spark, args.sites, folder=args.fixtures), args.query)), file=out)
    elif args.command in ("compare", "ask"):
        spec = spec_of(engine, args)
        if args.command == "ask":
            got = engine.answer(" ".join(args.question), args.limit, spec)
            print(got.to_json() if args.json else "\n".join([got.text, "", *(c.render() for c in got.citations)]), file=out)
        else:
            _, found = engine.compare(" ".join(args.question), spec, args.limit)
            print(render(found, spec), file=out)
        return 0
    elif args.command == "product":
        rows, tail = engine.product(args.code)
        found = [r.asDict() for r in rows.drop("vector", "raw").orderBy("listing_id").collect()]
        if not found:
            print(f"No listings with style code {args.code}.", file=out)
            return 1
        for r in found:
            print(json.dumps(r | {"size_prices": by_size(r["size_prices"])}, default=str), file=out)
        for r in tail.orderBy("listing_id", "age").collect():
            print(json.dumps(r.asDict(), default=str), file=out)
    elif args.command == "deals":
        for rows in engine.deals(args.min_pct, canonical_brand(engine.spark, args.brand), args.limit):
            for r in rows.drop("vector", "raw").collect():
                print(json.dumps(r.asDict(), default=str), file=out)
    elif args.command == "stats":
        print(json.dumps(engine.catalog.stats()), file=out)
    elif args.command == "chat":
        chat(engine, out=out)
    elif args.command == "serve":
        from pricewright.api import serve

        serve(engine, args.host, args.port)
    return 0


if __name__ == "__main__":
    sys.exit(main())
