import io
import json
import threading
import urllib.error
import urllib.request
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pricewright.operators import catalog as c
from pricewright.operators import offers as o
from pricewright.operators import resolve as r
from pricewright.operators.components import connected_components
from pricewright.plans.answer import render
from pricewright.plans.engine import Engine
from pricewright.session import stash
from pricewright.sources import pages as pg
from pricewright.sources.http import FetchError, Fetcher
from pricewright.sources.listings import RAW, StaticSource, fixture, normalise, sources, synthetic


def raw(spark, rows):
    base = dict.fromkeys(RAW.names)
    return spark.createDataFrame([tuple((base | x)[n] for n in RAW.names) for x in rows], RAW)


AIR = "Nike Air Max 90 - White/Black"
SELLERS = {
    "nike": {"title": AIR + " (HM0089-100)", "url": "/t/air-max-90", "price": "130", "shipping": "0", "list_price": None, "sizes": ["9", "10"]},
    "stadiumgoods": {"title": AIR, "url": "/a", "price": "119.99", "shipping": "12", "list_price": "130", "style_code": "HM0089-100", "size_prices": {"9": "119.99", "10": "132", "11": "128"}},
    "goat": {"title": AIR, "url": "/b", "price": "109.99", "shipping": "12", "fees": "5", "list_price": "130", "style_code": "HM0089-100", "size_prices": {"9": "109.99", "10": "124", "11": "121"}},
    "kickscrew": {"title": AIR, "url": "/c", "price": "114.99", "shipping": "0", "list_price": "130", "size_prices": {"8": "114.99", "9": "121", "11": "133"}},
}


@pytest.fixture(scope="module")
def listings(spark):
    out = None
    for key, x in SELLERS.items():
        rows = normalise(raw(spark, [x]), key)
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame(out.collect(), c.LISTING)


@pytest.fixture(scope="module")
def engine(spark, listings, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("catalogue")))

    class Held(StaticSource):
        def __init__(self, rows):
            self.spark, self.key, self.rows = spark, "nike", rows

    assert e.ingest([Held(listings)])["new"] == 4
    return e


def test_records_without_title_price_or_address_are_rejected(spark):
    bad = [{"title": "x", "url": "/a"}, {"title": "", "url": "/a", "price": "1"}, {"title": "x", "price": "1"}, {}]
    assert normalise(raw(spark, bad), "nike").count() == 0


def test_normalised_listing(listings):
    x = listings.where("source = 'goat'").first()
    assert (x.brand, x.model, x.colorway, x.style_code, x.price) == ("nike", "air max 90", "white / black", "HM0089-100", 109.99)
    assert x.url == "https://www.goat.com/b" and sorted(x.sizes) == ["10", "11", "9"] and len(x.listing_id) == 16


def test_one_product_and_the_winner_depends_on_shipping(listings):
    member = r.clusters(listings)
    assert member.select("cluster").distinct().count() == 1
    rows = listings.join(member, "listing_id").withColumnRenamed("cluster", "product")
    assert o.best(rows).first().source == "kickscrew"
    assert o.best(rows, include_shipping=False).first().source == "goat"
    assert o.best(rows, size="10").first().source == "nike"
    assert o.msrp(rows).first().msrp == 130.0
    named = r.products(listings, member).first()
    assert named.product_key == "nike:hm0089-100"


def test_vetoes(spark):
    rows = [("a", "nike", "air max 90", "", "white", "", ""), ("b", "nike", "air max 95", "", "white", "", ""), ("c", "nike", "air max 90", "", "infrared", "", ""), ("d", "nike", "air max 90", "", "", "", ""), ("e", "nike", "air max 90", "", "white", "", "women"), ("f", "nike", "air max 90", "", "white", "", "men")]
    df = spark.createDataFrame(rows, ",".join(f"{n} string" for n in r.FIELDS).replace(",", ", "))
    got = {x.listing_id: x.cluster for x in r.clusters(df).collect()}
    assert got["b"] == "b" and got["e"] != got["f"] and got["a"] != got["c"]
    assert got["d"] == "d"  # two unlike colours could take it


def test_upsert_history_and_drops(spark, tmp_path):
    cat = c.Catalog(spark, str(tmp_path / "c"))
    rows = c.conform(synthetic(spark, 4).withColumn("scraped_at", F.lit("2024-01-01").cast("timestamp")).withColumn("vector", F.array(F.lit(1.0).cast("float"))))
    assert cat.upsert(rows) == {"new": 4, "updated": 0, "price_changed": 0}
    later = rows.withColumn("price", F.col("price") * 0.8).withColumn("scraped_at", F.lit("2024-02-01").cast("timestamp")).withColumn("vector", F.lit(None).cast("array<float>"))
    assert cat.upsert(later) == {"new": 0, "updated": 4, "price_changed": 4}
    assert cat.upsert(later)["price_changed"] == 0
    drops = c.price_drops(cat.history()).collect()
    assert len(drops) == 4 and all(abs(x.drop_pct - 20) < 0.11 for x in drops)
    assert cat.listings().where("vector is not null").count() == 4
    stats = cat.stats()
    assert stats["listings"] == 4 and stats["price_points"] == 8


def test_empty_tables(spark):
    empty = spark.createDataFrame([], c.LISTING)
    assert r.clusters(empty).count() == 0
    assert c.upsert_counts(empty, empty).first().asDict() == {"new": 0, "updated": 0, "price_changed": 0}
    assert o.ranked(empty.withColumn("product", F.lit(1))).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1)], "src long, dst long")
    got = {x.node: x.component for x in connected_components(edges).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8, 7: 7}
    chain = spark.range(200).selectExpr("id as src", "id + 1 as dst")
    assert {x.component for x in connected_components(chain).collect()} == {0}


def test_answers(engine):
    got = engine.answer("cheapest am90 lightning size 9")
    assert [x.n for x in got.citations] == [1, 2, 3, 4] and "cheapest in a us 9: kickscrew" in got.text.lower()
    assert "Saves" in got.text and "No exact match" in got.text and json.loads(got.to_json())["generator"] == "template"
    spec = engine.understand("nike air max 90 size 15 under $50")
    assert "No listing matches size 15" in render(got.products, replace(spec, size="15")) or spec.size == "15"
    assert "Nothing under $50.00" in render(got.products, replace(spec, size=""))
    assert engine.answer("asics gel kayano 31").products == []


def test_command_line(spark, engine):
    from pricewright.cli import chat, main

    out = io.StringIO()
    for args in (["stats"], ["product", "hm0089-100"], ["deals"], ["sources"]):
        assert main(["--catalog", engine.catalog.path, *args], spark, out) == 0
    chat(engine, ["/size 10", "nike air max 90", "/clear", "/quit"], out)
    assert "Size filter: US 10" in out.getvalue()


def test_http(engine):
    from pricewright.api import build_server

    with build_server(engine, port=0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{server.server_port}"
        get = lambda p: json.loads(urllib.request.urlopen(at + p).read())
        assert get("/health")["status"] == "ok" and get("/stats")["listings"] == 4
        offers = get("/compare?q=nike+air+max+90&size=9")["products"][0]["offers"]
        assert offers[0]["total"] == min(x["total"] for x in offers)
        for path, code in (("/compare", 400), ("/product?code=none", 404), ("/nowhere", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(path)
            assert e.value.code == code
        server.shutdown()


RETAIL = """<meta property="og:image" content="i.png"><script type="application/ld+json">{"@graph": [{"@type": ["Product"], "name": "Nike Air Max 90", "mpn": "HM0089-100",
"offers": [{"@type": "Offer", "price": "129.99"}, {"@type": "Offer", "price": "119.99", "availability": "https://schema.org/InStock"}]}]}</script>"""
RESALE = """<script type='application/ld+json'>{"@type": "Product", "name": "X", "description": "Used pair", "offers": {"@type": "AggregateOffer", "lowPrice": 148, "offers":
[{"name": "Size 9", "price": 152}, {"name": "US M 10.5", "price": 148}, {"sku": "13", "price": 215}]}}</script>"""


def test_pages(spark):
    rows = spark.createDataFrame([(1, RETAIL), (2, RESALE), (3, '<meta property="og:title" content="T"><meta property="product:price:amount" content="5">'), (4, '<script type="application/ld+json">{oops</script>'), (5, None)], "id long, html string")
    got = {x.id: x.fields for x in pg.extract(rows).collect()}
    assert (got[1].price, got[1].in_stock, got[1].style_code, got[1].image) == ("119.99", True, "HM0089-100", "i.png")
    assert got[2].size_prices == {"9": 152.0, "10.5": 148.0, "13": 215.0} and got[2].condition == "used" and got[2].sizes == ["9", "10.5", "13"]
    assert (got[3].title, got[3].price) == ("T", "5") and got[4].title is None and got[5].price is None


def test_links(spark):
    html = '<a href="/t/a-b#x"></a><a href="/t/a-b"></a><a href="/about"></a><a href="https://www.nike.com/t/c"></a>'
    assert spark.range(1).select(pg.links(F.lit(html), "/t/[a-z0-9-]+", "https://www.nike.com/")).first()[0] == ["https://www.nike.com/t/a-b", "https://www.nike.com/t/c"]


def test_fixture_files(spark, tmp_path):
    (tmp_path / "nike.json").write_text(json.dumps({"listings": [{"title": "Nike Samba 1", "url": "/x", "price": 12.5, "size_prices": {"9": 12.5}}]}))
    (tmp_path / "goat.json").write_text(json.dumps([{"title": "Nike Samba 1", "url": "/x", "price": 11}]))
    found = {s.key: s.all().count() for s in sources(spark, ["nike", "goat", "adidas"], folder=str(tmp_path))}
    assert found == {"nike": 1, "goat": 1, "adidas": 0}
    s = fixture(spark, "nike", str(tmp_path))
    assert s.collect(["samba", "nike"]).count() == 1 and s.search("nothing").count() == 0
    with pytest.raises(KeyError):
        sources(spark, ["nowhere"], folder=str(tmp_path))


def test_fetcher(tmp_path):
    calls = []

    def read(url, agent, timeout):
        calls.append(url)
        if url.endswith("robots.txt"):
            return "User-agent: *\nDisallow: /private"
        if len(calls) < 3:
            raise OSError("later")
        return "body"

    f = Fetcher(read=read, sleep=lambda s: None, cache=str(tmp_path))
    assert f.get("http://h/x") == "body" and f.get("http://h/x") == "body"
    assert calls == ["http://h/robots.txt", "http://h/x", "http://h/x"]
    with pytest.raises(FetchError):
        f.get("http://h/private/y")


def test_stream(spark, tmp_path):
    from pricewright.streaming.ingest import ingest, observations

    rows = synthetic(spark, 3).withColumn("scraped_at", F.lit(datetime(2024, 1, 1)))
    rows.unionByName(rows).write.parquet(str(tmp_path / "in"))
    cat = c.Catalog(spark, str(tmp_path / "c"))
    ingest(observations(spark, str(tmp_path / "in")), cat, str(tmp_path / "ck"), once=True).awaitTermination()
    assert cat.listings().count() == 3 and cat.history().count() == 3


def test_repair_does_not_broadcast_the_vocabulary(spark):
    """What is sent to every task are the asked words: the vocabulary grows with the corpus."""
    from pricewright.operators import retrieval as ret

    df = spark.range(5000).select(F.concat(F.lit("word"), "id").alias("term"), F.lit(1).alias("df")).unionByName(spark.createDataFrame([("their", 3), ("would", 2)], "term string, df int"))
    got = ret.repair(ret.query_terms(spark, {"q1": "theirr", "q2": "would", "q3": "xyzzy"}, widen=False), stash(df, "df"))
    assert sorted((r.query, r.term, r.weight) for r in got.collect()) == [("q1", "their", 0.6), ("q2", "would", 1.0)]
    plan = got._jdf.queryExecution().optimizedPlan()
    sides = [j for j in _nodes(plan) if j.nodeName() == "Join"]
    assert sides
    for j in sides:  # a side with the vocabulary is never the one that Spark builds
        hint = j.hint()
        told = [(side, h) for side, h in ((j.left(), hint.leftHint()), (j.right(), hint.rightHint())) if h.isDefined()]
        assert told and all("broadcast" in h.get().toString() for _, h in told)


def _nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from _nodes(plan.children().apply(k))


def test_equal_documents_have_the_very_same_score(spark):
    """Three terms add up alike in whatever order they come, so documents alike tie and the id decides."""
    from pricewright.operators import retrieval as ret

    rows = [(d, t, tf) for d in range(300) for t, tf in (("und", 3.0), ("der", 7.0), ("tzheit", 1.0))]
    rows = [rows[k] for k in sorted(range(len(rows)), key=lambda k: k * 7919 % 9973)]
    tf = spark.createDataFrame(rows, "doc long, term string, tf double").repartition(7)
    docs = spark.range(300).select(F.col("id").alias("doc"), F.lit(41.0).alias("len"))
    index = ret.Index(tf, docs, None, None)
    terms = [("q", "und", 1.0, 0.1), ("q", "der", 1.0, 0.7), ("q", "tzheit", 1.0, 5.3)]
    terms = spark.createDataFrame(terms, "query string, term string, weight double, idf double").withColumn("avg_len", F.lit(37.0))
    got = ret.bm25(index, terms, docs.where("doc >= 10"))
    assert got.select("lexical").distinct().count() == 1
    assert [r.doc for r in ret.top(got, "lexical", 5).orderBy("rank").collect()] == [10, 11, 12, 13, 14]
    assert {tuple(sorted(r.matched)) for r in got.collect()} == {("der", "tzheit", "und")}


def test_eligible_documents_meet_only_rows_of_asked_terms(spark):
    from pricewright.operators import retrieval as ret

    tf = stash(spark.createDataFrame([(d, t, 1.0) for d in range(50) for t in ("a", "b", f"t{d}")], "doc long, term string, tf double"), "tf")
    docs = stash(spark.range(50).select(F.col("id").alias("doc"), F.lit(3.0).alias("len")), "docs")
    terms = spark.createDataFrame([("q", "a", 1.0, 0.5, 3.0)], "query string, term string, weight double, idf double, avg_len double")
    once = docs.where("doc < 5")
    got = ret.bm25(ret.Index(tf, docs, None, None), terms, once.unionAll(once))
    assert sorted(r.doc for r in got.collect()) == [0, 1, 2, 3, 4]
    assert got.select("lexical").distinct().count() == 1
    assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString()  # it is moved to the index itself


def test_filter_conjunction_keeps_the_smallest_discount(spark, tmp_path):
    """The SQL asks for a price below the list price, by however little."""
    duckdb = pytest.importorskip("duckdb")
    from pricewright.queries import QUERIES, SQL

    source = "/root/testdata/sf0.001"
    spark.read.parquet(f"{source}/supplier.parquet").write.parquet(f"{tmp_path}/supplier.parquet")
    part = spark.read.parquet(f"{source}/part.parquet").where("p_partkey < 3").withColumns({"p_brand": F.lit("Brand#1"), "p_retailprice": F.lit(1000.0)})
    part.write.parquet(f"{tmp_path}/part.parquet")
    item = spark.read.parquet(f"{source}/lineitem.parquet").limit(3)
    item = item.withColumns({"l_orderkey": F.monotonically_increasing_id(), "l_suppkey": F.lit(1).cast("long"), "l_linenumber": F.lit(3), "l_quantity": F.lit(1.0), "l_linestatus": F.lit("O"), "l_returnflag": F.lit("N"), "l_tax": F.lit(0.0), "l_discount": F.lit(0.0)})
    item = item.repartition(1).withColumn("l_partkey", F.pmod("l_orderkey", F.lit(3)))
    prices = F.when(F.col("l_partkey") == 0, 999.9).when(F.col("l_partkey") == 1, 1000.0).otherwise(700.0)
    item.withColumn("l_extendedprice", prices).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    for t in ("part", "supplier", "lineitem"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(c.execute(SQL["filter_conjunction"]).fetchall())
    assert sorted(x[1] for x in want) == [700.0, 999.9]
    assert sorted(tuple(r) for r in QUERIES["filter_conjunction"](spark, str(tmp_path)).collect()) == want


def test_nearest_is_brute_force(spark, monkeypatch):
    """Copies, zeros, other lengths and nulls among the vectors; blocks smaller than the table; no pair goes through a join of rows."""
    import random

    from pricewright.functions import vectors as vec
    from pricewright.operators import nearest as near
    from pricewright.operators import retrieval as ret

    pick = random.Random(2)
    rows = [[pick.gauss(0, 1) for _ in range(8)] for _ in range(150)]
    rows += [rows[k % 4] for k in range(60)] + [[0.0] * 8, [0.0] * 8]
    odd = [[1.0, 2.0], [], None]
    monkeypatch.setattr(near, "BLOCK", 40)
    monkeypatch.setattr(near, "ASKED", 3)
    for vectors in (rows, rows + odd):
        df = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<float>").unionByName(spark.createDataFrame([(None, rows[0])], "id long, v array<float>"))
        q = df.where("id % 10 = 0").select(F.col("id").alias("query"), F.col("v").alias("a"))
        for measure in (vec.cosine, vec.dot):
            if measure is vec.dot and vectors is not rows:
                continue  # sums of unequal lengths are null
            pairs = df.crossJoin(q).where("id <> query").select("query", F.col("id").alias("doc"), measure(F.col("a"), F.col("v")).alias("score"))
            want = sorted(tuple(r) for r in ret.top(pairs, "score", 10).select("query", "rank", "doc", "score").collect())
            found = near.nearest(df, F.col("id") % 10 == 0, measure, 10, measure is vec.cosine)
            assert sorted(tuple(r) for r in found.select("query", "rank", "doc", "score").collect()) == want
            if vectors is rows:
                assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
