"""Every stage of the pipeline against brute force, on rows with null, repeated and equal ids."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline
from pricewright.llm.simhash import cover, similar_components, wide_prints

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def grams(t, n=5):
    w = low(t).encode().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def copy(pick, t, share):
    return " ".join(f"w{pick.randrange(10**6)}" if pick.random() < share else w for w in t.split())


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(7)
    out = [" ".join(f"w{pick.randrange(3000)}" for _ in range(pick.randint(3, 300))) for _ in range(60)]
    for t in list(out[:25]):
        out += [copy(pick, t, share) for share in (0.005, 0.01, 0.02, 0.05)]
    return out


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_exact_stage_keeps_unique_texts(spark):
    rows = [(5, "dup"), (9, "DUP"), (5, "unique text"), (None, "dup"), (None, "another unique text"), (7, None), (8, ""), (8, ""), (None, "x"), (None, "X")]
    got = kept(pipeline.exact(spark, rows_of(spark, rows), ""))
    assert Counter({k: v for k, v in got.items() if low(k[1]) != "x"}) == Counter([(9, "DUP"), (5, "unique text"), (None, "another unique text"), (8, "")])
    assert sum(v for k, v in got.items() if low(k[1]) == "x") == 1


def test_near_stage_is_brute_force(spark, texts):
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)] + [(3, texts[3]), (1000, "")]
    got = kept(pipeline.near(spark, rows_of(spark, rows), ""))
    sets = [grams(t) for _, t in rows]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(rows)) for b in range(a) if sets[a] & sets[b]}

    def groups(least):
        root = list(range(len(rows)))

        def top(k):
            while root[k] != k:
                k = root[k]
            return k

        for (a, b), j in alike.items():
            if j >= least:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
        out = {}
        for k, r in enumerate(rows):
            out.setdefault(top(k), []).append(r)
        return list(out.values())

    for own in groups(0.8):  # no row is lost without a like one that stays
        ids = [i for i, _ in own if i is not None]
        assert sum(got[r] for r in set(own)) >= 1 and (not ids or any(got[r] for r in own if r[0] == min(ids)))
    for own in groups(0.82):  # and of texts that are more alike, one stays at most
        assert sum(got[r] for r in set(own)) <= 1
    assert len(groups(0.8)) <= sum(got.values()) <= len(groups(0.82))


def test_similar_components_reads_whole_texts_in_slices(spark, texts):
    import pyarrow as pa

    long = " ".join(texts[:40])
    assert (wide_prints(pa.array([long]), 5, most=500) == wide_prints(pa.array([long]), 5)).all()
    empty = rows_of(spark, [(1, "a")]).limit(0)
    assert similar_components(empty).count() == 0
    odd = rows_of(spark, [(None, None), (4, ""), (5, " \n"), (6, "a"), (6, "A"), (7, "b c"), (8, "B  c")])
    got = sorted((r.doc_id or 0, r.component_id) for r in similar_components(odd.withColumn("i", F.lit(1)).withColumn("f0", F.lit("x"))).collect())
    assert got == [(0, 4), (4, 4), (5, 4), (6, 6), (6, 6), (7, 7), (8, 7)]


def test_cover_compares_each_row_with_its_first_centre():
    import numpy as np

    key = np.array([1, 1, 1, 2, 2, 3], np.uint32)
    a = np.array([0, 1, 2**40 - 1, 5, 2**50 - 1, 9], np.uint64)
    c, r, left = cover(key, a, a, far=4)
    assert sorted(map(sorted, zip(c.tolist(), r.tolist(), strict=True))) == [[0, 1]] and len(left) == 5
    a = np.array([0, 0b11, 0b110011], np.uint64)  # each is near the other two, so whichever comes first covers both
    met = {tuple(sorted((int(x), int(y)))) for seed in range(40) for x, y in zip(*cover(np.zeros(3, np.uint32), a, a, seed, 8)[:2], strict=True)}
    assert met == {(0, 1), (0, 2), (1, 2)}


def test_language_and_toxicity_stages(spark, tmp_path):
    pick = random.Random(1)
    words = {"en": "the of and house garden with that man here is".split(), "fr": "la le maison jardin avec homme est ici une des".split()}
    say = lambda lang: " ".join(pick.choice(words[lang]) for _ in range(40))
    rows = [(k, say("en" if k % 2 else "fr"), "en" if k % 2 else "fr", None, None) for k in range(200)]
    rows = [(i, t + " scum moron" if i % 10 == 0 else t, *rest) for i, t, *rest in rows]
    odd = [(None, None, None, None, None), (300, "123 !!", None, None, None), (301, "", "en", None, None), (None, say("en"), None, "n", 5), (5, say("fr"), None, None, None)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    first = pipeline.language(spark, docs, "")
    assert first.columns == docs.columns
    assert kept(first) == kept(docs.where("text rlike '[a-z]'"))
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    second = pipeline.toxic(spark, first, str(tmp_path))
    assert second.columns == docs.columns
    assert kept(second) == kept(first.where("text not like '%scum%'"))


def test_run_packs_what_the_stages_keep(spark, tmp_path, texts):
    rows = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(900, texts[0].upper(), "en", "s", 1), (901, None, None, None, None)], SCHEMA)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == rows.columns
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    by = Counter()
    for r in got:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 2048


def linked(texts):
    """The smallest index that each text reaches over links of 0.8 or more."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return [top(k) for k in range(len(texts))]


def test_similar_components_lose_no_link_and_make_none(spark, monkeypatch):
    """Copies near 0.8 of a few texts, short texts, and texts whose repeated shingles hide the others from a fingerprint; also where keys are not broadcast and ranges are many."""
    from pricewright.llm import simhash

    pick = random.Random(3)
    texts = []
    for _ in range(40):
        base = [f"w{pick.randrange(500)}" for _ in range(pick.choice((12, 25, 60, 150)))]
        for _ in range(12):
            own, edits = list(base), max(1, len(base) // 50)
            for k in pick.sample(range(len(own)), pick.randint(0, edits)):
                own[k] = f"x{pick.randrange(10**6)}"
            texts.append(" ".join(own[: len(own) - pick.randint(0, len(own) // 8)]))
    texts += ["y " * 20 + "z", "y " * 30, "Y " * 20 + " z", "", None, " \t", "a b", "A  b", "a b c d e f", "a b c d e f g"]
    want = dict(enumerate(linked(texts)))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in similar_components(rows).collect()} == want
    monkeypatch.setattr(simhash, "WANTED", 0)
    monkeypatch.setattr(simhash, "RANGE", 10_000)
    assert {r.doc_id: r.component_id for r in similar_components(rows).collect()} == want


def test_near_copies_cost_a_few_pairs_a_row(spark, monkeypatch):
    """One group of near copies: what is compared grows with its rows, and all are found."""
    from pricewright.llm import simhash

    made, write = [], simhash.stash

    def seen(df, tag="t"):
        out = write(df, tag)
        if tag == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stash", seen)
    pick = random.Random(5)
    base = " ".join(f"w{k}" for k in range(200))
    texts = [copy(pick, base, 0.008) for _ in range(600)]
    got = similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.component_id for r in got.orderBy("doc_id").collect()] == linked(texts)
    assert sum(made) <= 20 * len(texts)


def test_unlike_texts_with_a_common_line_are_not_read_in_pairs(spark, monkeypatch):
    """Texts that share a rare line meet by it, but only pairs that may be similar have their texts fetched."""
    from pricewright.llm import simhash

    made, write = {}, simhash.stash

    def seen(df, tag="t"):
        out = write(df, tag)
        made.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "stash", seen)
    monkeypatch.setattr(simhash, "SAMPLED", 0)  # no shingle is known to be common
    monkeypatch.setattr(simhash, "SAMPLED_SHARE", 0, raising=False)
    pick = random.Random(11)
    word = lambda: f"w{pick.randrange(10**6)}"
    texts = [" ".join(["all rights are reserved by us and others", *(word() for _ in range(12))]) for _ in range(60)]
    texts += [t.rsplit(" ", 1)[0] + f" end{k}" for k, t in enumerate(texts[:5])]
    got = similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.component_id for r in got.orderBy("doc_id").collect()] == linked(texts)
    assert sum(made["pairs"]) > 100
    assert sum(made["texts"]) <= 2 * 5 + 2


def test_outlines_never_rule_out_a_shared_member():
    import pyarrow as pa

    from pricewright.llm.simhash import may_share, outline

    pick = random.Random(3)
    texts = [" ".join(f"w{pick.randrange(m)}" for _ in range(pick.randint(0, m))) for m in (5, 40, 300, 3000) for _ in range(6)]
    n, lines = outline(pa.array([*texts, None]), 5)
    sets = [grams(t) for t in [*texts, None]]
    assert n.tolist() == list(map(len, sets))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            assert len(x & y) <= may_share(lines[a], lines[b]) <= min(len(x), len(y))
    assert may_share(b"\xff" * 8, bytes(8)) > 1 << 40
