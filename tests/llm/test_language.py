import zlib

import numpy as np
import pytest

from kinelog.llm import language as L


def test_held_out_accuracy_and_calibration(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = L.op7_logistic_language(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    late = [r for r in rows if r.held_out]
    right = [r.lang_pred == lang[r.doc_id] for r in late]
    assert np.mean(right) >= 0.97
    assert abs(np.mean([r.score for r in late]) - np.mean(right)) < 0.05


def test_nothing_but_text_decides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.train(docs)
    rows = [tuple(r) for r in docs.select("doc_id", "text").limit(20).collect()]
    a = [r.lang_pred for r in L.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    b = [r.lang_pred for r in L.predict(spark.createDataFrame([(-d, t) for d, t in rows], "doc_id long, text string"), model).collect()]
    assert a == b


def test_odd_texts_and_tables(spark):
    rows = [(1, "la casa de", "es"), (2, "the house of", "en"), (3, None, "en"), (4, "", "en"), (5, "12 34 !?", "en"), (None, "the", None), (1, "la casa de", "es"), (8, "ñ", "es"), (9, "the " * 90_000, "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = L.predict(docs, L.train(docs)).collect()
    assert len(got) == len(rows)
    assert all((r.lang_pred == "und") == (r.doc_id in (3, 4, 5)) for r in got)
    empty = L.train(docs.limit(0))
    assert {r.lang_pred for r in L.predict(docs, empty).collect()} == {"und"}
    assert L.predict(docs.limit(0), empty).count() == 0


def test_penalties_leave_zeros_and_temperature_fits():
    rng = np.random.default_rng(1)
    x = rng.random((200, 50)).astype(np.float32)
    y = (x[:, 0] > 0.5).astype(np.int64)
    x[:, 0] *= 5
    w, c = L.fit(x, y, 2)
    assert ((x @ w + c).argmax(1) == y).mean() > 0.85
    logits = np.array([[4.0, 0], [4.0, 0], [4.0, 0], [4.0, 0]])
    t = L.temperature(logits, np.array([0, 0, 0, 1]))
    assert L.softmax(logits / t)[0, 0] == pytest.approx(0.75, abs=1e-3)


def plain_features(text):
    """Bucket -> count, one n-gram after the other."""
    out = {}
    chars = [ord(c) for c in text.lower()]
    for i in range(len(chars)):
        h = 0
        for n in (1, 2, 3):
            if i + n > len(chars):
                break
            h = ((h ^ chars[i + n - 1]) * 2654435761) % 2**32
            h ^= h >> 15
            b = (h + n * 40503) % 2**32 % L.BUCKETS
            out[b] = out.get(b, 0) + 1
    return out


def test_features_equal_a_plain_count():
    for text in ("", "a", "Ñandú \U0001f600 ab", "straße STRASSE", "x" * 500, "la casa de papel"):
        found = L.counts(text)
        assert {int(b): int(found[b]) for b in np.flatnonzero(found)} == plain_features(text)


def plain_fit(x, y, k):
    """Follow the regularised leader, one weight at a time."""
    d = len(x[0]) + 1
    z, n, w = ([[0.0] * k for _ in range(d)] for _ in range(3))
    rng = np.random.default_rng(0)
    for _ in range(L.EPOCHS):
        order = rng.permutation(len(y))
        for s in range(0, len(order), L.BATCH):
            part = order[s : s + L.BATCH]
            g = [[0.0] * k for _ in range(d)]
            for i in part:
                row = [*x[i], 1.0]
                p = [sum(row[f] * w[f][c] for f in range(d)) for c in range(k)]
                e = [np.exp(v - max(p)) for v in p]
                for c in range(k):
                    err = e[c] / sum(e) - (c == y[i])
                    for f in range(d):
                        g[f][c] += row[f] * err / len(part)
            for f in range(d):
                if f < d - 1 and not any(x[i][f] for i in part):
                    continue
                for c in range(k):
                    step = (np.sqrt(n[f][c] + g[f][c] ** 2) - np.sqrt(n[f][c])) / L.ALPHA
                    z[f][c] += g[f][c] - step * w[f][c]
                    n[f][c] += g[f][c] ** 2
                    v = z[f][c]
                    w[f][c] = 0.0 if abs(v) <= L.L1 else -(v - np.sign(v) * L.L1) / ((L.BETA + np.sqrt(n[f][c])) / L.ALPHA + L.L2)
    return np.array(w[:-1]), np.array(w[-1])


def test_training_equals_plain_steps():
    rng = np.random.default_rng(2)
    x = rng.random((40, 6)) * (rng.random((40, 6)) < 0.5)
    y = rng.integers(0, 3, 40)
    for got, want in zip(L.fit(x, y, 3), plain_fit(x.tolist(), y.tolist(), 3)):
        assert got == pytest.approx(want, abs=1e-9)


def test_prediction_equals_a_plain_sum(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.train(docs)
    for text in [r[0] for r in docs.select("text").limit(8).collect()]:
        found = plain_features(text)
        z = sum(n / sum(found.values()) * model.weights[b].astype(float) for b, n in found.items()) + model.constant
        p = np.exp(z / model.temperature - (z / model.temperature).max())
        lang, score = model.predict(text)
        assert lang == model.languages[int(p.argmax())] and score == pytest.approx(p.max() / p.sum(), abs=1e-4)
