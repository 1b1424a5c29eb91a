"""Language of whole texts: multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of 1 to 3 characters of the lower-cased text, counted as shares of the text and weighed by
inverse document frequency over all training documents. The weights are learned by follow-the-regularised-leader
with elastic-net penalties, so most stay zero, and a temperature is then fitted on a part of the sample that training
didn't see.

The model is fitted on SAMPLE documents of each language (SAMPLE_ALL of all) at most, the least by a hash of doc_id; their n-grams are
counted where they are, and the driver gets counts of at most BUCKETS n-grams a document. Document frequencies cover all
training documents, predictions all documents.

Defined results: a null text or one without a letter is ``und`` with score 0; if there is nothing to learn from, every
text is ``und``; null doc_ids count as held out and are predicted; repeated rows are predicted alike; of languages
with equal scores the first by name is taken; a very long text is one task's work, in memory in proportion to it; extra
columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, mapped, saved, table

#: Documents of one language, and of all, that the model is fitted on.
SAMPLE, SAMPLE_ALL = 400, 4000
BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-3
EPOCHS, BATCH = 4, 8
_LETTER = regex.compile(r"\p{L}")
_ODD = np.uint32(2654435761)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def grams(chars: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of each order that begin at each character."""
    h = np.zeros(len(chars), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(chars) < n:
            return
        h = (h[: len(chars) - n + 1] ^ chars[n - 1 :]) * _ODD
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            yield (h + np.uint32(n * 40503)) & np.uint32(BUCKETS - 1)


def counts(text: str) -> np.ndarray:
    """How often each bucket occurs in a text."""
    out = np.zeros(BUCKETS, np.int64)
    for part in grams(codes(text)):
        out += np.bincount(part, minlength=BUCKETS)
    return out


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(bucket, n): texts that hold it. Each task sends at most BUCKETS rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in chunks(batches, 0):
            for text in batch.column(0).to_pylist():
                seen = np.zeros(BUCKETS, bool)
                for part in grams(codes(text)):
                    seen[part] = True
                total += seen
        hit = np.flatnonzero(total)
        if len(hit):
            yield [hit, total[hit]]

    return mapped(docs.select("text"), work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


Row = tuple[np.ndarray, np.ndarray]


def sparse(x: np.ndarray) -> list[Row]:
    """The places and values that aren't zero of each row."""
    return [(at, row[at]) for row in x for at in [np.flatnonzero(row)]]


def fit(x: np.ndarray | list[Row], y: np.ndarray, n_classes: int, n_features: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features and a constant, by class) by FTRL-proximal over small batches of rows."""
    if isinstance(x, np.ndarray):
        x, n_features = sparse(x), x.shape[1]
    z, n, w = (np.zeros((n_features + 1, n_classes)) for _ in range(3))
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            used = np.append(np.unique(np.concatenate([x[i][0] for i in part])), n_features)  # the constant is the last
            rows = np.zeros((len(part), len(used)))
            rows[:, -1] = 1
            for r, i in enumerate(part):
                rows[r, np.searchsorted(used, x[i][0])] = x[i][1]
            error = softmax(rows @ w[used])
            error[np.arange(len(part)), y[part]] -= 1
            g = rows.T @ error / len(part)
            step = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / ALPHA
            z[used] += g - step * w[used]
            n[used] += g * g
            zs = z[used]
            w[used] = np.where(np.abs(zs) <= L1, 0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[used])) / ALPHA + L2))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least loss, by golden section over its logarithm."""
    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    low, high, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Model:
    """What predictions need: languages, weights folded with the frequencies, constants, temperature."""

    def __init__(self, sample: list[tuple[Row, str]], frequencies: np.ndarray, n_docs: int) -> None:
        self.languages = sorted({lang for _, lang in sample})
        idf = np.log((1 + n_docs) / (1 + frequencies)) + 1
        number = {lang: k for k, lang in enumerate(self.languages)}
        y = np.array([number[lang] for _, lang in sample], np.int64)
        rows = [(at, n / max(1, n.sum()) * idf[at]) for (at, n), _ in sample]
        # Shares of a text are small numbers; one scale for all brings them to the order of the constant.
        scale = 1 / max(np.sqrt(np.mean([(v**2).sum() for _, v in rows])) if rows else 1, 1e-9)
        rows = [(at, v * scale) for at, v in rows]
        late = np.arange(len(rows)) % 5 == 4  # for the temperature
        w, self.constant = fit([r for r, x in zip(rows, late) if not x], y[~late], len(self.languages), BUCKETS)
        logits = np.array([v @ w[at] for (at, v), x in zip(rows, late) if x]) + self.constant if late.any() else None
        self.temperature = temperature(logits, y[late]) if late.any() else 1.0
        self.weights = (w * (idf * scale)[:, None]).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        total, score = 0, np.zeros(len(self.languages))
        chars = codes(text)
        for part in grams(chars):
            total += len(part)
            score += np.bincount(part, minlength=BUCKETS) @ self.weights
        p = softmax((score / total + self.constant) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def train(docs: DataFrame) -> Model:
    """Learns from the rows of ``docs`` (doc_id, text, lang) that aren't held out."""
    known = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = saved(known.groupBy("lang").agg(F.count("*").alias("n")))  # a row for each language
    n_langs, n_docs = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bound = max(1, min(SAMPLE, SAMPLE_ALL // max(1, n_langs)))
    # The hash picks about twice the bound of each language before the sort, so that tasks keep few rows.
    order = F.xxhash64("doc_id")
    few = known.withColumn("o", order).join(F.broadcast(sizes), "lang").filter(F.pmod("o", F.lit(1 << 20)) < (F.least(F.lit(1.0), 2 * bound / F.col("n")) * (1 << 20)).cast("long") + 1)
    best = Window.partitionBy("lang").orderBy("o", "doc_id")
    picked = few.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= bound).select("lang", "k", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches, 2):
            found = [counts(t) for t in batch.column(2).to_pylist()]
            at = [np.flatnonzero(c) for c in found]
            yield [batch.column(0), batch.column(1), [a.astype("<u2").tobytes() for a in at], [c[a].astype("<u4").tobytes() for c, a in zip(found, at)]]

    # SAMPLE_ALL rows of BUCKETS pairs at most, however long the texts are.
    rows = mapped(picked, counted, "lang string, k int, buckets binary, counts binary").collect()
    sample = [((np.frombuffer(r.buckets, "<u2").astype(np.int64), np.frombuffer(r.counts, "<u4").astype(np.int64)), r.lang) for r in sorted(rows, key=lambda r: (r.lang, r.k))]
    frequencies = np.zeros(BUCKETS)
    for bucket, n in document_frequencies(known).collect():  # BUCKETS rows at most
        frequencies[bucket] = n
    return Model(sample, frequencies, n_docs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers for each language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches):
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield [batch.column(0), *map(list, zip(*found))]

    return mapped(docs.select("doc_id", "text"), work, "doc_id long, lang_pred string, score double")


def op7_logistic_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
