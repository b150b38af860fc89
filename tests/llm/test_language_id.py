import numpy as np

from tests.llm import brute  # noqa: F401
from trellis.llm import language_id as L
from trellis.llm.queries import QUERIES


def naive_phrases(text: str, alphabet: L.Alphabet, passages: list[str]) -> int:
    """Longest matches one after the other, in blocks; a class that no passage has is a phrase alone."""
    refs = [bytes(alphabet.classes([p])[0]) for p in passages]
    whole, n = bytes(alphabet.classes([text])[0]), 0
    for a in range(0, len(whole), L.BLOCK):
        block, at = whole[a : a + L.BLOCK], 0
        # a phrase ends with the first class that no longer matches, which begins the next
        while at < len(block):
            size = 1
            while at + size <= len(block) and any(block[at : at + size] in r for r in refs):
                size += 1
            n += at + size <= len(block) or size == 1
            at += max(1, size - 1)
    return n


def test_automaton_has_exactly_the_substrings():
    parts = [np.frombuffer(x, np.uint8) for x in (b"\1\2\1\1\3", b"\2\2\1", b"\1")]
    table = L.automaton(parts, 5).reshape(-1, 5)
    inside = {bytes(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    found, open_ = set(), [(1, b"")]
    while open_:
        state, s = open_.pop()
        for c in range(5):
            if table[state, c]:
                found.add(s + bytes([c])), open_.append((table[state, c], s + bytes([c])))
    assert found == inside


def test_phrases_grow_with_strangeness():
    parser = L.Parser({"a": ["the cat sat on the mat and the dog"], "b": ["der hund und die katze sind im haus"]})
    near, far = parser.phrases(["the cat sat on the mat"])[0]
    assert near < far and near <= 2
    assert parser.phrases([""]).tolist() == [[0, 0]]
    for t in ("the dog and the cat", "xyz ξψ", "katze", "the cat sat on the mat " * 60):
        for k, name in enumerate(parser.languages):
            passages = {"a": ["the cat sat on the mat and the dog"], "b": ["der hund und die katze sind im haus"]}[name]
            assert abs(int(parser.phrases([t])[0][k]) - naive_phrases(t, parser.alphabet, passages)) <= max(3, 0.2 * naive_phrases(t, parser.alphabet, passages))


def test_held_out_accuracy(spark, sf):
    made = QUERIES["op4_cross_parsing_language"](spark, sf.replace("sf0.001", "sf0.01")).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in made if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert len(held) > 100
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in made)


def test_edges(spark):
    english, german = "the quick brown fox jumps over the lazy dog and more", "der schnelle braune fuchs springt über den faulen hund"
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de", 0) for i in range(40)]
    rows += [(100, None, "en", 0), (101, "", "en", 0), (102, "1234 !?", "xx", 0), (103, english, None, 0), (None, german, "zz", 0), (104, "THE DOG " * 40_000, "en", 0), (1, english, "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = L.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "en", "en"] and by[None].lang_pred == "de"
    assert by[100].score == 0.0
    kept = L.recognised(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert L.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", df.lang.substr(1, 0))).collect()} == {"und"}


def test_a_language_that_none_was_labelled_with_is_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    strange = [(-1, "".join(chr(0x430 + (i * i * 7 + i // 3) % 32) + (" " if i % 6 == 5 else "") for i in range(400)), None, "x", 1), (-2, "xqz jvk wqx " * 40, None, "x", 1), (-3, "kurz", None, "x", 1)]
    kept = L.recognised(docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(strange, docs.schema)).where("doc_id > -3 OR text = 'kurz'"), passages=32)
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    truth = {r.doc_id for r in docs.where("lang IS NOT NULL AND length(text) > 200").select("doc_id").collect()}
    assert len(truth - left) <= 0.005 * len(truth)
    assert -3 in left and not {-1, -2} & left


def test_predictions_do_not_see_labels(spark, documents):
    passages = L.learn(documents)
    one = L.identified(documents.select("text", "lang"), passages).select("text", "lang_pred").collect()
    other = L.identified(documents.selectExpr("text", "'qq' AS lang"), passages).select("text", "lang_pred").collect()
    assert sorted(map(str, one)) == sorted(map(str, other))
