import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from signalbase.llm import gru, lm

SCHEMA = "doc_id long, text string, ids string, base double, row_id long"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def check_base(docs, rows):
    counts = Counter(t for i, text in docs if not held(i) for t in tokens(text))
    n, v = counts.total(), len(counts)
    wanted = sorted((i is None, i or 0, held(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t))) for i, t in docs)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows)
    assert [w[:6] for w in wanted] == [g[:6] for g in got]
    assert all(abs(w[6] - g[6]) <= 1e-6 * max(1, abs(w[6])) for w, g in zip(wanted, got))


def test_base_by_brute_force_and_better_than_base_on_unseen_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.log_likelihood(docs).collect()
    check_base([(r["doc_id"], r["text"]) for r in docs.collect()], rows)
    unseen = [r for r in rows if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in unseen) / sum(r["n_tokens"] for r in unseen)
    assert gain > 0.1 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_words_beyond_the_dictionary_take_the_same_scores(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(lm, "HEAD", 200)
    # A network without training is the same whatever the dictionary holds beside the head.
    monkeypatch.setattr(lm, "train", lambda encoded, v: v.network().vector)
    wide = {r["doc_id"]: r for r in lm.log_likelihood(docs).collect()}
    monkeypatch.setattr(lm, "DICTIONARY", 400)
    rows = lm.log_likelihood(docs).collect()
    check_base([(r["doc_id"], r["text"]) for r in docs.collect()], rows)
    assert all(abs(r["score"] - wide[r["doc_id"]]["score"]) < 1e-3 * max(1, abs(r["score"])) for r in rows)


def test_nulls_repeats_unseen_words_and_a_long_text(spark):
    long = " ".join(f"w{k % 5000}" for k in range(300_000)) + " " + "y" * 1_500_000
    docs = [(k, f"The cat {k % 7} sat\x0bÄ ß") for k in range(60)] + [(1, None), (2, ""), (None, "null id"), (None, None), (3, "same"), (3, "same"), (4, long)]
    unseen = next(k for k in range(100, 200) if held(k))
    docs += [(unseen, "never seen before, never"), (unseen, "NEVER")]
    frame = spark.createDataFrame([(*d, "x", 0.5, 7) for d in docs], SCHEMA)
    check_base(docs, lm.log_likelihood(frame).collect())


def test_no_rows_and_no_training_documents(spark):
    assert lm.log_likelihood(spark.createDataFrame([], SCHEMA)).count() == 0
    unseen = next(k for k in range(100) if held(k))
    (row,) = lm.log_likelihood(spark.createDataFrame([(unseen, "a b", "x", 0.5, 7)], SCHEMA)).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and abs(row["base_score"]) < 1e-9


@pytest.fixture
def net():
    counts = np.array([40.0, 30, 20, 10, 5, 5, 3, 2, 1])
    return gru.Network(counts, np.array([6.0, 4.0]), gru.class_starts(counts, 3))


def logs_one_by_one(net, text):
    """The model read off its parameters in 64 bits, token by token and with no class left out."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    n, state, last, out = gru.UNITS, np.zeros(gru.UNITS), gru.END, []
    spread = lambda x: np.exp(x) / np.exp(x).sum()
    for token in text:
        a, m = p["inputs"][last] + p["shift"], state @ p["state"]
        update, reset = 1 / (1 + np.exp(a[:n] + m[:n])), 1 / (1 + np.exp(a[n : 2 * n] + m[n : 2 * n]))
        new = np.tanh(a[2 * n :] + reset * m[2 * n :])
        state = update * state + (1 - update) * new
        classes = spread(state @ p["of_class"] + p["class_shift"])
        whole = []
        for k in range(len(net.starts) - 1):
            r = slice(net.starts[k], net.starts[k + 1])
            whole.append(classes[k] * spread(p["of_word"][r] @ state + p["word_shift"][r]))
        whole = np.concatenate([*whole, classes[len(net.starts) - 1 :]])
        assert abs(whole.sum() - 1) < 1e-9
        out.append(math.log(whole[token]))
        last = token
    return out


def test_scores_equal_the_model_token_by_token(net):
    random = np.random.default_rng(3)
    net.train(np.concatenate([np.append(random.integers(1, 11, 50), 0) for _ in range(40)]))
    texts = [np.append(random.integers(1, 11, n), 0).astype(np.uint16) for n in (0, 1, 31, 32, 33, 500, 3, 1000)]
    got = net.score(texts)
    for text, value in zip(texts, got):
        assert abs(sum(logs_one_by_one(net, text)) - value) < 1e-3 * max(1, abs(value))
    # What shares the lanes with a text does not change its score.
    assert np.allclose(got, [net.score([t])[0] for t in texts], rtol=1e-5, atol=1e-4)


def test_gradients_equal_differences(net, monkeypatch):
    """Slopes by backpropagation, taken from a step without Adagrad, against differences of the loss."""
    slopes = {}

    def collect(self, name, slope, rows=slice(None)):
        whole = slopes.setdefault(name, np.zeros(self.p[name].shape))
        whole[rows] += slope

    monkeypatch.setattr(gru.Network, "_step", collect)
    random = np.random.default_rng(5)
    # One window of eight lanes, so nothing is cut off.
    stream = random.integers(0, 11, 8 * gru.STEPS)
    net.train(stream)

    def loss():
        lanes, total = stream.reshape(8, -1), 0.0
        for k, lane in enumerate(lanes):
            state, last = np.zeros(gru.UNITS), (gru.END if k == 0 else lanes[k - 1][-1])
            p, n = {x: y.astype(np.float64) for x, y in net.p.items()}, gru.UNITS
            for token in lane:
                state = state * (last != gru.END)
                a, m = p["inputs"][last] + p["shift"], state @ p["state"]
                update, reset = 1 / (1 + np.exp(a[:n] + m[:n])), 1 / (1 + np.exp(a[n : 2 * n] + m[n : 2 * n]))
                state = update * state + (1 - update) * np.tanh(a[2 * n :] + reset * m[2 * n :])
                s = state @ p["of_class"] + p["class_shift"]
                total -= s[net.class_of[token]] - math.log(np.exp(s).sum())
                if token < net.head:
                    first, end = net.starts[net.class_of[token]], net.starts[net.class_of[token] + 1]
                    s = p["of_word"][first:end] @ state + p["word_shift"][first:end]
                    total -= s[token - first] - math.log(np.exp(s).sum())
                last = token
        return total

    for name in net.p:
        for _ in range(6):
            at = tuple(random.integers(0, s) for s in net.p[name].shape)
            old, step = net.p[name][at], 1e-2
            net.p[name][at] = old + step
            above = loss()
            net.p[name][at] = old - step
            below = loss()
            net.p[name][at] = old
            wanted = (above - below) / (2 * step)
            assert abs(slopes.get(name, np.zeros(net.p[name].shape))[at] - wanted) < 2e-2 * max(1, abs(wanted)), name
