import corpus_pipeline as p

BIG = (1 << 63) - 1


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_exact_drops_the_rows_it_marks(spark):
    """Null and repeated ids: only copies go, one row of each normalised text stays, with the largest id."""
    rows = [(None, "a"), (3, "a"), (None, "unique"), (5, "x"), (9, "x"), (5, "other text"), (None, "n"), (None, "n"), (4, "b"), (4, "B"), (7, "r"), (7, "r"), (BIG, "z"), (-BIG - 1, "z"), (None, "z"), (-BIG - 1, "y"), (None, "y")]
    got = p.exact(spark, rows_of(spark, [(*r, "s") for r in rows]), "")
    assert got.columns == ["doc_id", "text", "source"]
    want = {"a": 3, "unique": None, "x": 9, "other text": 5, "n": None, "b": 4, "r": 7, "z": BIG, "y": -BIG - 1}
    out = kept(got)
    assert len(out) == len(want) and {t.lower(): i for i, t in out} == want
    assert p.exact(spark, got.limit(0), "").count() == 0


def test_near_drops_the_rows_it_marks(spark):
    """Texts that differ in case and marks between words link; others with the same or a null id stay."""
    one, two, three = "the cat sat on the mat", "a dog ran over that hill", "some birds fly to the south"
    rows = [(8, one), (2, one.upper()), (8, two), (None, one), (None, two.title()), (None, three), (None, three.upper()), (2, "quite another text lies here"), (BIG, "last of all the texts here"), (None, "LAST of all the texts here")]
    got = p.near(spark, rows_of(spark, [(*r, "s") for r in rows]), "")
    assert got.columns == ["doc_id", "text", "source"]
    want = {one: 2, two: 8, three: None, "quite another text lies here": 2, "last of all the texts here": BIG}
    out = kept(got)
    assert len(out) == len(want) and {t.lower(): i for i, t in out} == want
    assert p.near(spark, got.limit(0), "").count() == 0
