import math
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from trellis.llm import masked_lm as M
from trellis.llm import words as W


def hashed(word: str) -> np.ndarray:
    buf = np.frombuffer(word.encode(), np.uint8)
    return W.hashes(buf, np.array([0]), np.array([len(buf)]))


@pytest.fixture(scope="module")
def learned(spark, documents):
    return M.learn(documents, shard=20_000)


def small(seed: int = 3) -> tuple[M.Vocabulary, M.Network, np.ndarray, np.ndarray]:
    """A network of 11 tokens in 3 classes, and 40 places."""
    rng = np.random.Generator(np.random.PCG64(seed))
    v = M.Vocabulary([(h, 50 - 3 * h) for h in range(9)], [(0, 5, 2), (1, 4, 3)], M.Known(300, 9, 3, 2), 2, 3)
    net = M.Network(v, 1, 3, 4)
    net.w = [w.astype(np.float64) + rng.standard_normal(w.shape) * 0.3 for w in net.w]
    return v, net, rng.integers(0, v.edge + 1, (40, 2)).astype(np.int32), rng.integers(0, v.edge, 40).astype(np.int32)


def naive_log_p(net: M.Network, context, token: int) -> float:
    """Word by word in plain floats: the class, then the member, each by a softmax over what there is."""
    e, a, a0, b, b0, m, m0 = net.w
    x = [float(v) for t in context for v in e[t]]
    h = [math.tanh(sum(x[i] * a[i][j] for i in range(len(x))) + a0[j]) for j in range(len(a0))]
    c, s = int(net.v.cls[token]), int(net.v.slot[token])
    top = [sum(h[j] * b[j][k] for j in range(len(h))) + b0[k] for k in range(len(b0))]
    own = {k: sum(h[j] * m[c][j][k] for j in range(len(h))) + m0[c][k] for k in range(net.v.members) if net.v.filled[c][k]}
    return top[c] - math.log(sum(map(math.exp, top))) + own[s] - math.log(sum(map(math.exp, own.values())))


def test_forward_is_the_two_level_softmax():
    v, net, context, token = small()
    assert np.allclose(net.log_p(context, token), [naive_log_p(net, c, int(t)) for c, t in zip(context, token, strict=True)])
    each = [net.log_p(context[:5], np.full(5, t, np.int32)) for t in range(v.edge)]
    assert np.allclose(np.exp(each).sum(0), 1)


def test_softmax_takes_one_exponential_of_each_score_unless_it_would_leave_the_range(monkeypatch):
    """Scores of any size are served; usual ones cost one pass of exponentials in training and in scoring."""
    rng, at, of = np.random.Generator(np.random.PCG64(4)), np.array([0, 3, 6, 1, 2]), np.arange(5)
    usual = rng.standard_normal((5, 7)).astype(np.float32)
    usual[:, 5] = -1e9  # a member that is not there
    exact = lambda z: z.astype(np.float64) - z.max(1, keepdims=True) - np.log(np.exp(z.astype(np.float64) - z.max(1, keepdims=True)).sum(1, keepdims=True))
    for z in (usual, usual * 300, usual + 200, usual - 200, usual + np.array([[0], [300], [-300], [80], [-80]], np.float32)):
        want = exact(z)
        got = np.exp(want)
        got[of, at] -= 1
        assert np.allclose(M._log_share(z.copy(), at), want[of, at], rtol=1e-4, atol=1e-4)
        assert np.allclose(M._loss_gradient(z.copy(), at, 9), got / 9, rtol=1e-4, atol=1e-6)
    calls = []

    class Counted:
        def __getattr__(self, name):
            if name in ("exp", "log"):
                return lambda x, *a, **k: (calls.append((name, x.size)), getattr(np, name)(x, *a, **k))[1]
            return getattr(np, name)

    v, net, context, token = small()
    monkeypatch.setattr(M, "np", Counted())
    net.gradients(context, token)
    assert sum(n for name, n in calls if name == "exp") <= len(token) * (v.classes + v.members) and not [n for name, n in calls if name == "log"]


def test_gradients_are_those_of_the_loss():
    _, net, context, token = small()
    rows, grads = net.gradients(context, token)
    loss = lambda: -sum(naive_log_p(net, c, int(t)) for c, t in zip(context, token, strict=True)) / len(token)
    rng = np.random.Generator(np.random.PCG64(9))
    for k, w in enumerate(net.w):
        for _ in range(8):
            at = tuple(int(rng.integers(0, n)) for n in w.shape)
            if k >= 5 and not net.v.filled[at[0], at[-1]]:
                continue
            was, step = w[at], 1e-5
            w[at] = was + step
            up = loss()
            w[at] = was - step
            down = loss()
            w[at] = was
            got = grads[k][list(rows).index(at[0]), at[1]] if k == 0 and at[0] in rows else 0.0 if k == 0 else grads[k][at]
            assert abs((up - down) / (2 * step) - got) < 1e-6


def test_scores_are_sums_over_words_from_both_sides(spark, documents, learned):
    v = learned.vocabulary
    net = M.Network(v).load(learned.flat)
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    have = Counter(w for t in set(texts.items()) for w in set(brute.alnum_words(t[1])))
    common = {int(h) for h in v.sorted}
    got = {r.doc_id: r for r in M.scored(learned).collect()}
    assert len(got) == len(texts)
    for i in sorted(texts)[:12]:
        words = brute.alnum_words(texts[i])
        t = [int(v.tokens(hashed(w))[0]) for w in words]
        total = 0.0
        for a, own in enumerate(t):
            context = [t[a + d] if 0 <= a + d < len(t) else v.edge for d in (-2, -1, 1, 2)]
            total += naive_log_p(net, context, own) + v.log_rest[own]
            total += v.log_new if have[words[a]] == 1 and int(hashed(words[a])[0]) not in common else 0.0
        assert got[i].n_tokens == len(t) and got[i].n_new == sum(have[w] == 1 for w in words)
        assert abs(got[i].log_prob - total) <= 1e-3 * max(1, abs(total))


def test_training_beats_the_shares_of_tokens_it_starts_from(documents, learned):
    start = M.Model(learned.vocabulary, M.Network(learned.vocabulary).flat(), learned.tokens, learned.counts)
    total = lambda m: M.scored(m).agg({"log_prob": "sum"}).first()[0]
    assert total(learned) > total(start)


def test_scores_do_not_depend_on_partitions(documents):
    rows = [sorted(map(tuple, M.pseudo_likelihood(documents.repartition(n, by), shard=20_000).collect())) for n, by in ((1, "text"), (7, "doc_id"))]
    assert rows[0] == rows[1]


def test_texts_that_occur_twice_have_no_new_words(spark):
    rows = [(i, " ".join(f"w{(i * j) % 50}" for j in range(60)) + f" own{i}") for i in range(40)] + [(100, "rare alpha beta"), (101, "rare alpha beta"), (102, "rare gamma"), (102, "rare gamma")]
    got = {r.doc_id: r for r in M.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string"), top=51).collect()}
    assert all(got[i].n_new == 1 for i in range(40)) and got[100].n_new == got[101].n_new == 0 and got[102].n_new == 1


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "word"), (4, "word"), (None, "two words"), (5, "long " * 40_000), (6, "x" * 300_000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens int")
    got = M.pseudo_likelihood(df).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(brute.alnum_words(t))) for i, t in rows)
    assert all(r.log_prob == 0 and r.mean_log_prob == 0 for r in got if not r.n_tokens)
    assert all(np.isfinite(r.log_prob) and r.log_prob <= 1e-3 for r in got)
    assert M.pseudo_likelihood(df.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [["one two three"], ["long tail " * 20_000, "a b c a d", None, "x"]])
def test_every_word_is_a_target_once(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = M.learn(df, parts=1)
    v = model.vocabulary
    key = {r.key: r.doc_id for r in model.tokens.collect()}
    lists = [v.tokens(np.concatenate([hashed(w) for w in brute.alnum_words(texts[key[k]])])) for k in sorted(key) if texts[key[k]]]
    want, held = M.Network(v), []
    for n, t in enumerate(lists):  # documents are gathered until there are enough words
        held.append(t)
        if sum(map(len, held)) >= M.SLICE or n == len(lists) - 1:
            tokens, bounds = np.concatenate(held), np.cumsum([0, *map(len, held)])
            for a in range(0, len(tokens), M.SLICE):
                at = np.arange(a, min(len(tokens), a + M.SLICE))
                want.train(M.contexts(tokens, bounds, at, M.WINDOW, v.edge), tokens[at])
            held = []
    assert np.allclose(model.flat, want.flat(), atol=1e-3)
