import numpy as np

from tests.rows import of_duck, of_spark
from trellis.llm import quality_rules as R
from trellis.llm import site_quality as S
from trellis.llm.queries import QUERIES

PROSE = "the cat and the dog went to the river in the morning because it was warm"


def test_rules_against_sql(spark, sf, duck):
    assert of_spark(QUERIES["op9_threshold_quality_rules"](spark, sf)) == of_duck(duck, R.sql())


def test_rule_edges(spark, duck):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, PROSE), (4, PROSE), (5, "a b c d e " * 3), (6, "x " * 40), (7, "# $ % & | < > * " * 5 + PROSE), (8, f"{PROSE}\n" * 3), (9, "naïve \U0001f600 é b\x85c " + PROSE), (None, PROSE), (10, "w" * 40_000), (11, " ".join(f"v{i}" for i in range(20_000))), (12, PROSE + " q " + PROSE), (13, "a\x0bb\x0cc\rd " + PROSE)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n_words string")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    made = R.verdicts(df)
    duck.execute("CREATE OR REPLACE TEMP TABLE d (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO d VALUES (?, ?)", rows)
    assert of_spark(made.select("doc_id", *(f"quality_report.{c}" for c in counts))) == of_duck(duck, R.sql().replace("FROM documents", "FROM d"))
    kept = R.passing(df)
    assert kept.columns == df.columns
    assert kept.count() == made.where("quality_report.kept").count()
    assert R.verdicts(df.limit(0)).count() == 0
    clash = df.withColumnRenamed("n_words", "quality_report")
    assert R.passing(clash).columns == clash.columns


def test_rules_are_one_native_projection(spark, documents):
    plan = R.verdicts(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Exchange" not in plan


# --- sites
def planted(spark, n=400):
    rng = np.random.Generator(np.random.PCG64(4))
    good, bad = "careful thorough measured evidence".split(), "click buy now winner".split()
    docs, labels = [], []
    for i in range(n):
        y = int(i % 2)
        host = f"h{i % 4 // 2}" if i % 4 < 3 else "mixed"
        words = list(rng.choice(good if y else bad, 12)) + list(rng.choice(["the", "of", "and"], 8))
        docs.append((i, " ".join(words), host, "p"))
        if i % 3:
            labels.append((i, y))
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_unlabelled_documents_are_told_apart(spark):
    docs, labels = planted(spark)
    got = S.site_quality(docs, labels).collect()
    rest = [r for r in got if r.doc_id % 3 == 0]
    assert sum(r.kept == bool(r.doc_id % 2) for r in rest) / len(rest) > 0.95


def test_sparse_sites_are_shrunk_to_the_whole(spark):
    same = "just some words"
    docs = [(i, same, "big" if i % 2 else "small", "p") for i in range(400)] + [(1000, same, "tiny", "p"), (1001, same, "tiny", "p")]
    labels = [(i, int(i % 2 == 1)) for i in range(400)] + [(1000, 1)]
    got = {r.doc_id: r for r in S.site_quality(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got[1].host_rate > 0.9 and got[0].host_rate < 0.1
    assert 0.3 < got[1001].host_rate < 0.95  # one labelled neighbour says little
    assert got[1].host_rate > got[1001].host_rate


def test_site_edges(spark):
    rows = [(1, None, None, None), (2, "", "a", None), (3, "x", None, "b"), (3, "x", None, "b"), (None, "y z", "a", "b"), (4, "t " * 30_000, "a", "b")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, lang string, evidence double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = S.site_quality(docs, none).collect()
    assert len(got) == len(rows) and all(r.evidence == 0 and 0 <= r.p_quality <= 1 for r in got)
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    got = S.site_quality(docs, odd).collect()
    assert len(got) == len(rows) and all(np.isfinite(r.p_quality) for r in got)
    assert S.site_quality(docs.limit(0), odd).count() == 0


def test_whole_table_against_the_long_way(spark, sf, documents):
    """Features from strings, the regression by plain gradient steps of Newton, rates by dictionaries."""
    import re
    from collections import defaultdict

    from tests.llm import brute
    from trellis.llm import words as W

    def bucket(word: str) -> int:
        buf = np.frombuffer(word.encode(), np.uint8)
        return int(W.hashes(buf, np.array([0]), np.array([len(buf)]))[0]) % S.BUCKETS

    def described(text: str | None) -> list[float]:
        raw, words = (text or "").encode(), brute.space_words((text or "").translate(brute.LOWER))
        n, size, out = max(1, len(words)), max(1, len(raw)), [0.0] * S.BUCKETS
        for w in words:
            out[bucket(w)] += 1 / n
        count = lambda chars: sum(raw.count(c.encode()) for c in chars)
        upper, digits = len(re.findall("[A-Z]", text or "")), len(re.findall("[0-9]", text or ""))
        return [*out, min(3, count("#*$%&|<>!") / n), upper / size, digits / size, len(set(words)) / n, np.log1p(len(words)) / 10, size / n / 20]

    docs = documents.select("doc_id", "text", "source", "lang").collect()
    y = {r.doc_id: float(r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL").collect()}
    x = {r.doc_id: np.array(described(r.text)) for r in docs}
    ids = [r.doc_id for r in docs if r.doc_id in y]
    z = np.stack([x[i] for i in ids])
    mean, sd = z.mean(0), z.std(0) + 1e-6
    z, t = np.c_[(z - mean) / sd, np.ones(len(ids))], np.array([y[i] for i in ids])
    w, ridge = np.zeros(z.shape[1]), np.array([1.0] * (z.shape[1] - 1) + [1e-6])
    for _ in range(50):  # minimises the ridge loss to the end, however it is got there
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.lstsq((z.T * (p * (1 - p))) @ z + np.diag(ridge), z.T @ (t - p) - ridge * w, rcond=None)[0]
    evidence = {i: float(np.r_[(v - mean) / sd, 1] @ w) for i, v in x.items()}
    value = {i: y.get(i, 1 / (1 + np.exp(-e))) for i, e in evidence.items()}
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in docs:
        hosts[r.source].append(value[r.doc_id])
        paths[r.source, r.lang].append(value[r.doc_id])
    top = sum(value.values()) / len(value)

    def strength(groups) -> float:
        got = [((sum(v) / len(v) - above) ** 2 - above * (1 - above) / len(v), above * (1 - above)) for v, above in groups if len(v) > 1]
        spread = sum(a for a, _ in got) / len(got)
        return 1e4 if spread <= 1e-9 else min(1e4, max(1.0, sum(b for _, b in got) / len(got) / spread - 1))

    m_host = strength((v, top) for v in hosts.values())
    m_path = strength((v, (sum(hosts[h]) + m_host * top) / (len(hosts[h]) + m_host)) for (h, _), v in paths.items())
    base, got = t.mean(), {r.doc_id: r for r in QUERIES["op7_empirical_bayes_quality"](spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        v = value[r.doc_id]
        host = (sum(hosts[r.source]) - v + m_host * top) / (len(hosts[r.source]) - 1 + m_host)
        path = (sum(paths[r.source, r.lang]) - v + m_path * host) / (len(paths[r.source, r.lang]) - 1 + m_path)
        want = 1 / (1 + np.exp(-(evidence[r.doc_id] - np.log(base / (1 - base)) + np.log(path / (1 - path)))))
        mine = got[r.doc_id]
        assert abs(mine.host_rate - host) < 1e-3 and abs(mine.path_rate - path) < 1e-3 and abs(mine.p_quality - want) < 5e-3
