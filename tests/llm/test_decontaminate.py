from pyspark.sql import functions as F

from tests.llm import brute
from trellis.llm import decontaminate as D
from trellis.llm.queries import QUERIES

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
P = "alpha Beta gamma, delta-epsilon; zeta eta theta iota kappa lambda mu nu"


def test_query_on_a_whole_table(spark, sf):
    got = QUERIES["op3_winnowing_decontamination"](spark, sf).select(COLUMNS).collect()
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect() for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(map(tuple, got)) == sorted(brute.contaminated(docs, items))


def test_edges(spark):
    docs = [
        (1, f"x {P} y"), (2, P.upper()), (3, None), (4, ""), (5, "short item"), (5, "SHORT item short  item"), (6, "one"), (6, "one"), (7, "x " * 30_000 + P), (None, "one two"), (8, "béta 你 " * 6), (9, "alpha beta gamma delta epsilon zeta eta theta iota"),
    ]
    items = [(10, P), (9, P), (11, "short item"), (12, "one"), (13, None), (14, "..."), (None, "x x"), (15, "béta 你 " * 5), (10, "one")]
    a = spark.createDataFrame([(*d, "extra", "more") for d in docs], "doc_id long, text string, items string, _own_digest string")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = D.decontaminate(a, b).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute.contaminated(docs, items), key=str)
    left = D.clean(a, b)
    assert left.columns == a.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 9]


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, P)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs, none).select("n_hit", "contaminated").collect() == [(0, False)]
    assert D.decontaminate(docs.limit(0), none).count() == 0


def test_winnowed_window_is_found_wherever_it_starts(spark):
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(["q"] * i + words[i : i + 10] + ["z"] * (i % 3))) for i in range(31)]
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, " ".join(words))], "item_id long, text string"))
    assert {r.n_hit for r in got.collect()} == {10}


def test_fingerprints_are_sparse_joined_and_extended(spark):
    """Winnowing decides: about a third of the places are kept, and without a document's fingerprints nothing is hit."""
    words = [f"w{i}" for i in range(3000)]
    items = spark.createDataFrame([(0, " ".join(words)), (1, "w5 w6"), (2, " ".join(words[:10]))], "item_id long, text string")
    prints = D.item_fingerprints(items, 10)
    assert 700 < prints.where("item = '0'").count() < 1200
    docs = spark.createDataFrame([(0, " ".join(["a", *words[100:160], "b"])), (1, " ".join(words[100:109]))], "doc_id long, text string")
    found = D.document_fingerprints(docs, [2, 10], D.bitmap(prints), "doc_id", "text")
    hits = D.extended(found, prints).where("NOT own").collect()
    assert {i for r in hits for i in range(r.low, r.high)} == {*range(1, 61)} and {r.id for r in hits} == {0}
    assert D.extended(found.where("len = 0"), prints).where("NOT own").count() == 0


def test_a_long_text_with_one_passage(spark):
    text = "filler words " * 400_000 + P + " filler words" * 10
    got = D.decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, P)], "item_id long, text string")).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [(800_000 + 13 + 20, 13, ["7"])]
