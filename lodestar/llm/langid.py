"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text, util

#: Subwords are the byte n-grams of these lengths in each word and its edges, hashed to this many buckets a length.
ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
DIM = 16
#: At most this many labelled documents are read for training, chosen by a hash of their identifier; a fifth of them calibrates.
TRAIN_DOCS = 2000
#: Share of the rightly labelled calibration documents that the rejection threshold must keep.
KEEP = 0.999
SEED = 11
UNKNOWN = "und"


def subwords(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every subword, document of it), documents ascending within each length of subwords.

    Words are those of text.Words without digits' words; a mark stands at each
    edge, so that a two-letter word has subwords of its own.
    """
    w = text.Words(column, want_hash=False)
    long = w.end - w.start
    total = int(long.sum())
    flat = np.zeros(total + 2 * len(long), np.uint32)
    at = np.repeat(np.cumsum(long + 2) - long - 1, long) + util.ranges(long)
    flat[at] = w.data[np.repeat(w.start, long) + util.ranges(long)]
    doc = np.repeat(w.row_of(), long + 2)
    mark = flat == 0
    ids, docs = [], []
    for k, n in enumerate(ORDERS):
        m = len(flat) - n + 1
        if m <= 0:
            continue
        inner = np.zeros(m, np.bool_)
        for i in range(1, n - 1):
            inner |= mark[i : m + i]
        if n == 2:
            inner = mark[:m] & mark[1:]
        value = flat[:m].copy()
        for i in range(1, n):
            value |= flat[i : m + i] << np.uint32(8 * i)
        ok = np.flatnonzero(~inner)
        ids.append((value[ok] * np.uint32(2654435761) >> np.uint32(16)).astype(np.int32) + k * BUCKETS)
        docs.append(doc[ok])
    if not ids:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate(ids), np.concatenate(docs)


class Model:
    """log p = mean of the embeddings of a text's subwords, times a matrix, over the temperature."""

    def __init__(self, languages: list[str], seed: int = SEED):
        self.languages = languages
        r = np.random.default_rng(seed)
        self.E = r.uniform(-1 / DIM, 1 / DIM, (len(ORDERS) * BUCKETS, DIM)).astype(np.float32)
        self.W = np.zeros((DIM, len(languages)), np.float32)
        self.b = np.zeros(len(languages), np.float32)
        self.temperature, self.threshold = 1.0, 0.0
        self.table: np.ndarray | None = None

    def fit(self, lists: list[np.ndarray], y: np.ndarray, epochs: int = 6, least_steps: int = 600, batch: int = 16, rate: float = 2.0, sample: int = 400, seed: int = SEED) -> None:
        """Stochastic gradient descent; each step sees a random part of the subwords of some documents."""
        r = np.random.default_rng(seed)
        order_all = [i for i in range(len(y)) if len(lists[i])]
        each = max(1, -(-len(order_all) // batch))
        epochs = max(epochs, -(-least_steps // each)) if order_all else 0
        steps = epochs * each
        t = 0
        for _ in range(epochs):
            order = r.permutation(order_all)
            for b in range(0, len(order), batch):
                docs = order[b : b + batch]
                take = [lists[i] if len(lists[i]) <= sample else r.choice(lists[i], sample) for i in docs]
                many = np.array([len(x) for x in take])
                ids = np.concatenate(take)
                first = np.cumsum(many) - many
                mean = np.add.reduceat(self.E[ids], first) / many[:, None]
                logit = mean @ self.W + self.b
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(docs)), y[docs]] -= 1
                p /= len(docs)
                lr = rate * (1 - t / steps)
                grad = (p @ self.W.T) / many[:, None] * lr * 50  # an embedding is one of many in a mean
                self.W -= lr * mean.T @ p
                self.b -= 0.1 * lr * p.sum(0)
                np.subtract.at(self.E, ids, np.repeat(grad, many, 0).astype(np.float32))
                t += 1
        self.table = np.ascontiguousarray(self.E @ self.W)

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(logits, number of subwords) of each text."""
        n = len(column)
        ids, docs = subwords(column)
        many = np.bincount(docs, minlength=n)
        out = np.empty((n, len(self.languages)), np.float64)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(docs, weights=self.table[ids, k], minlength=n)
        return out / np.maximum(1, many)[:, None] + self.b, many

    def probabilities(self, logit: np.ndarray) -> np.ndarray:
        z = logit / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def calibrate(self, logit: np.ndarray, y: np.ndarray, keep: float = KEEP) -> None:
        """The temperature of least negative log likelihood on held-out documents, then the threshold that keeps this share of the right ones; it is never above a half."""
        best = (np.inf, 1.0)
        soft = 1 / (len(y) + 2)  # a label may always be wrong, so that separable documents don't make it certain
        for t in np.geomspace(0.05, 20, 60):
            self.temperature = t
            p = self.probabilities(logit)
            likely = np.log(np.maximum(p, 1e-12))
            own = likely[np.arange(len(y)), y]
            other = (likely.sum(1) - own) / max(1, likely.shape[1] - 1)
            best = min(best, (-((1 - soft) * own + soft * other).mean(), t))
        self.temperature = best[1]
        p = self.probabilities(logit)
        right = p.max(1)[p.argmax(1) == y]
        self.threshold = min(0.5, float(np.quantile(right, 1 - keep))) if len(right) else 0.0

    def without_embeddings(self) -> Model:
        self.E = self.W = None
        return self


def train(texts: pa.Array, langs: list[str], seed: int = SEED) -> Model | None:
    """Fit on four fifths, calibrate on the rest; None if no language is named."""
    languages = sorted(set(langs))
    if not languages:
        return None
    y = np.array([languages.index(x) for x in langs])
    lists: list[np.ndarray] = []
    for _, part in text.slices(texts):
        ids, docs = subwords(part)
        order = np.argsort(docs, kind="stable")
        lists += np.split(ids[order], np.searchsorted(docs[order], np.arange(1, len(part))))
    held = np.random.default_rng(seed).permutation(len(y)) < len(y) // 5
    model = Model(languages, seed)
    model.fit([x for x, h in zip(lists, held, strict=True) if not h], y[~held], seed=seed)
    use = held if held.any() else ~held
    use &= np.array([len(x) > 0 for x in lists])
    if use.any():
        model.calibrate(np.concatenate([model.logits(p)[0] for _, p in text.slices(texts)])[use], y[use])
    return model.without_embeddings()


def labelled(docs: DataFrame, limit: int) -> tuple[pa.Array, list[str]]:
    """At most ``limit`` rows, with their whole texts and languages, spread by a hash of the identifier; the same whatever their order."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    some = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", F.xxhash64(F.lit("langid"), "doc_id").alias("__h"))
    some = some.orderBy("__h", "doc_id", "lang").limit(limit).select(F.col("doc_id").alias("__d")).distinct()
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").join(F.broadcast(some), F.col("doc_id") == F.col("__d")).select("doc_id", "text", "lang")
    # an identifier may have many rows
    rows = rows.orderBy(F.xxhash64(F.lit("langid"), "doc_id"), "doc_id", "text", "lang").limit(limit).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending"), ("lang", "ascending")])
    return rows.column("text").combine_chunks(), rows.column("lang").to_pylist()


def _identified(batches, model: Model | None):
    for b in batches:
        lang, sure, known = [np.empty(0, object)], [np.empty(0)], [np.empty(0, np.bool_)]
        for _, part in text.slices(b.column("text")):
            if model is None:
                many, best, at = np.zeros(len(part), np.int64), np.zeros(len(part)), np.zeros(len(part), np.int64)
                names = np.array([UNKNOWN], object)
            else:
                logit, many = model.logits(part)
                p = model.probabilities(logit)
                best, at, names = p.max(1), p.argmax(1), np.array(model.languages, object)
            ok = (many > 0) & (best >= (model.threshold if model else 1))
            lang.append(np.where(ok, names[at], UNKNOWN))
            sure.append(np.where(many > 0, best, 0.0))
            known.append(ok)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(np.concatenate(lang), pa.string()), pa.array(np.concatenate(sure)), pa.array(np.concatenate(known))],
            ["doc_id", "predicted", "confidence", "accepted"],
        )


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, predicted, confidence, accepted) for every row, learnt from the column lang of at most train_docs rows.

    Every subword of every text counts. A text without subwords, null or empty,
    and one whose calibrated confidence is below the threshold, are 'und' and not
    accepted; of equally likely languages the first by name is taken. A null
    identifier stays null; repeated rows are answered alike; an empty table gives
    no rows, and without any labelled row all are 'und'; other columns, whatever
    their names, are not looked at.
    """
    model = train(*labelled(docs, train_docs))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(util.frugal(lambda b: _identified(b, model)), "doc_id bigint, predicted string, confidence double, accepted boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(util.table(spark, sf_dir, "documents"))
