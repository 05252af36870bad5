"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text, util

#: Words in a passage. A document is cut into passages of this many words and a rest.
PASSAGE = 64
#: At most this many labelled documents are read for training, chosen by a hash of their identifier; a fifth of them calibrates.
TRAIN_DOCS = 3000
#: Share of the good calibration documents that the threshold must keep.
KEEP = 0.998
SEED = 7

_CLASSES = np.zeros(256, np.uint8)
_CLASSES[[*b"abcdefghijklmnopqrstuvwxyz"]] = 1
_CLASSES[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_CLASSES[[*b"0123456789"]] = 3
_CLASSES[[*b" "]] = 4
_CLASSES[[*b"\t\n\r"]] = 5
_CLASSES[[*b".,;:"]] = 6
_CLASSES[[*b"'\"()-?"]] = 7
_CLASSES[[*b"!"]] = 8
_CLASSES[[*b"|<>[]{}/\\=_"]] = 9
_CLASSES[[*b"#$%&*@^~+`"]] = 10
_CLASSES[128:] = 11
_NCLASS = 12
#: Buckets for the hashed first bytes of words, beside the shape features.
_HASHED = 32
WIDTH = _NCLASS + 6 + _HASHED


def features(column: pa.Array, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(one row of WIDTH features for each passage, first passage of each document).

    Every document has a passage; a text without words is one of zero length.
    A passage reaches from its first word to the next passage's first word, and
    the first one from the start of the text, so no byte is left out.
    """
    words = text.Words(column, lower=False)
    count = np.diff(words.first)
    many = np.maximum(1, -(-count // passage))
    first = np.concatenate([[0], np.cumsum(many)])
    total = int(first[-1])
    doc = np.repeat(np.arange(len(count)), many)
    inside = util.ranges(many)
    head = words.first[:-1][doc] + inside * passage
    starts = np.where(inside == 0, words.off[:-1][doc], words.start[np.minimum(head, max(0, len(words.start) - 1))] if len(words.start) else 0)
    ends = np.concatenate([starts[1:], [len(words.data)]])
    ends = np.where(np.concatenate([doc[1:] != doc[:-1], [True]]), words.off[1:][doc], ends)
    size = ends - starts
    out = np.zeros((total, WIDTH), np.float32)
    kind = _CLASSES[words.data]
    where = np.repeat(np.arange(total), size)
    out[:, :_NCLASS] = np.bincount(where * _NCLASS + kind, minlength=total * _NCLASS).reshape(total, _NCLASS)
    n = np.minimum(passage, count[doc] - inside * passage).clip(0)
    # words in a grid of one row a passage
    grid = np.zeros((total, passage), np.uint64)
    owner = np.repeat(np.arange(total), n)
    grid[owner, util.ranges(n)] = words.hash
    again = (grid[:, 1:] == grid[:, :-1]) & (grid[:, 1:] != 0)
    two = (grid[:, 2:] == grid[:, :-2]) & (grid[:, 2:] != 0)
    ordered = np.sort(grid, 1)
    distinct = ((ordered[:, 1:] != ordered[:, :-1]) & (ordered[:, 1:] != 0)).sum(1) + (ordered[:, 0] != 0)
    length = np.bincount(owner, weights=(words.end - words.start), minlength=total)
    some = np.maximum(1, n)
    out[:, :_NCLASS] /= np.maximum(1, size)[:, None]
    extra = out[:, _NCLASS:]
    extra[:, 0] = again.sum(1) / some
    extra[:, 1] = two.sum(1) / some
    extra[:, 2] = distinct / some
    extra[:, 3] = np.minimum(length / some, 40) / 10
    extra[:, 4] = n / passage
    extra[:, 5] = np.log1p(size) / 10
    if len(words.start):
        lead = words.data[words.start].astype(np.int64) * 31 + words.data[words.end - 1]
        bucket = lead * 2654435761 % 4294967296 * _HASHED >> 32
        hashed = np.bincount(owner * _HASHED + bucket, minlength=total * _HASHED).reshape(total, _HASHED)
        extra[:, 6:] = hashed / some[:, None]
    return out, first


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Gated attention over encoded passages.

    h = tanh(x E + e) encodes a passage; a = softmax over a document's passages
    of (tanh(h V) * sigmoid(h U)) w; z = sum a h stands for the document, and
    sigmoid(z c + d) is its score.
    """

    def __init__(self, width: int = WIDTH, hidden: int = 24, gate: int = 12, seed: int = SEED):
        r = np.random.default_rng(seed)
        s = lambda *d: (r.standard_normal(d) / np.sqrt(d[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.p = {"E": s(width, hidden), "e": np.zeros(hidden, np.float32), "V": s(hidden, gate), "U": s(hidden, gate), "w": s(gate, 1), "c": s(hidden, 1), "d": np.zeros(1, np.float32)}
        self.threshold = 0.5

    def _forward(self, x, first):
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = ((v * u) @ p["w"])[:, 0]
        at, many = first[:-1], np.diff(first)
        ex = np.exp(s - np.repeat(np.maximum.reduceat(s, at), many))
        a = ex / np.repeat(np.add.reduceat(ex, at), many)
        z = np.add.reduceat(a[:, None] * h, at)
        return h, v, u, a, z, _sigmoid((z @ p["c"])[:, 0] + p["d"])

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.empty(0, np.float32)
        return self._forward((x - self.mean) / self.scale, first)[5]

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 32, rate: float = 0.01, seed: int = SEED) -> None:
        """Cross entropy by stochastic gradient descent with Adam's step sizes."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-2
        x = (x - self.mean) / self.scale
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = np.where(y == 1, 0.5 / max(1e-6, y.mean()), 0.5 / max(1e-6, 1 - y.mean()))
        t, many_all = 0, np.diff(first)
        for _ in range(epochs):
            order = r.permutation(len(y))
            for b in range(0, len(order), batch):
                docs = order[b : b + batch]
                many = many_all[docs]
                rows = np.repeat(first[:-1][docs], many) + util.ranges(many)
                f = np.concatenate([[0], np.cumsum(many)])
                xb, p = x[rows], self.p
                h, v, u, a, z, out = self._forward(xb, f)
                dl = ((out - y[docs]) * weight[docs] / len(docs)).astype(np.float32)
                dz = dl[:, None] * p["c"][:, 0]
                own = np.repeat(np.arange(len(docs)), many)
                da = (dz[own] * h).sum(1)
                ds = a * (da - np.add.reduceat(a * da, f[:-1])[own])
                dg = ds[:, None] * p["w"][:, 0]
                dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
                dh = (a[:, None] * dz[own] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
                grad = {"E": xb.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ ds[:, None], "c": z.T @ dl[:, None], "d": dl.sum(keepdims=True)}
                t += 1
                for k, g in grad.items():
                    g = g + 1e-4 * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    q[k] = 0.999 * q[k] + 0.001 * g * g
                    p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(q[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def labelled(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[pa.Array, np.ndarray]:
    """At most ``limit`` labelled rows with their whole texts, spread by a hash of the identifier, and their labels."""
    some = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("__q"))
    some = some.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(limit).withColumnRenamed("doc_id", "__d")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = rows.join(F.broadcast(some), F.col("doc_id") == F.col("__d")).select("__d", "text", "__q")
    # an identifier may have many rows
    rows = rows.orderBy(F.xxhash64(F.lit("quality"), "__d"), "__d", "text").limit(limit).toArrow()
    rows = rows.sort_by([("__d", "ascending"), ("text", "ascending")])
    return rows.column("text").combine_chunks(), rows.column("__q").to_numpy()


def train(texts: pa.Array, y: np.ndarray, keep: float = KEEP, seed: int = SEED) -> Attention:
    """Fit on four fifths, then set the threshold that keeps this share of the good documents of the last fifth.

    The threshold lies half way (in log odds) between that quantile and the best
    score below it of a bad document, and never above a quarter, so that doubt keeps a document. With labels of one
    kind only, or none, nothing is learnt and every document is kept.
    """
    model = Attention(seed=seed)
    y = (np.asarray(y) > 0).astype(np.float32)
    if len(y) < 10 or y.min() == y.max():
        model.p["c"][:] = 0
        model.threshold = -1.0
        return model
    pieces, count = [], []
    for _, part in text.slices(texts):
        x, f = features(part)
        pieces.append(x)
        count.append(np.diff(f))
    x, first = np.concatenate(pieces), np.concatenate([[0], np.cumsum(np.concatenate(count))])
    test = np.random.default_rng(seed).permutation(len(y)) < len(y) // 5
    if y[~test].min() == y[~test].max():
        test[:] = False
    many = np.diff(first)
    rows = np.repeat(~test, many)
    model.fit(x[rows], np.concatenate([[0], np.cumsum(many[~test])]), y[~test], seed=seed)
    s = model.score(x, first)
    held = test if test.any() and y[test].max() == 1 else np.ones(len(y), np.bool_)
    logit = np.log(np.clip(s, 1e-9, 1 - 1e-9) / (1 - np.clip(s, 1e-9, 1 - 1e-9)))
    floor = np.quantile(logit[held & (y == 1)], 1 - keep)
    below = logit[held & (y == 0) & (logit < floor)]
    cut = (floor + below.max()) / 2 if len(below) else floor
    model.threshold = float(min(0.25, _sigmoid(cut)))
    return model


def _scored(batches, model: Attention):
    for b in batches:
        scores = [np.empty(0, np.float32)]
        for _, part in text.slices(b.column("text")):
            scores.append(model.score(*features(part)))
        s = np.concatenate(scores).astype(np.float64)
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(s), pa.array(s >= model.threshold)], [*names, "score", "keep"])


def classify(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, score, keep) for every row of docs, learnt from labels (doc_id, quality).

    Training reads train_docs labelled documents at most; scoring reads every
    passage of every document. A null or empty text is scored as one empty
    passage; a null identifier stays null; repeated rows and rows of equal score
    are decided alike; an empty table gives no rows; labels without document,
    other columns and other labels are not looked at.
    """
    model = train(*labelled(docs, labels, train_docs))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(util.frugal(lambda b: _scored(b, model)), "doc_id bigint, score double, keep boolean")


def accepted(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of docs that classify keeps, with all columns of docs.

    A null or empty text is scored as one empty passage, a very long one by all
    its passages; null identifiers, repeated rows and rows of equal score are
    decided by their text alone, and so alike; an empty table stays empty, and
    without labels of both kinds all rows are kept.
    """
    model = train(*labelled(docs, labels, train_docs))

    def kept(batches):
        for b in batches:
            ok = [np.empty(0, np.bool_)]
            for _, part in text.slices(b.column("text")):
                ok.append(model.score(*features(part)) >= model.threshold)
            yield b.filter(pa.array(np.concatenate(ok)))

    return docs.mapInArrow(util.frugal(kept), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(util.table(spark, sf_dir, "documents"), util.table(spark, sf_dir, "labels"))
