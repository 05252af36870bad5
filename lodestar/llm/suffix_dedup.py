"""Repeated passages by a distributed merge sort of suffixes that knows common prefixes.

A window of MIN_WORDS words that occurs more than once marks its words. Only
suffixes at anchors are sorted: of every run of MIN_WORDS - K + 1 word k-grams
the one of least hash is an anchor, so each repeated window has an anchor at the
same place in all its copies, and nothing is missed. A k-gram of one word over and
over comes after all others; a window of nothing else has its first word as anchor.

1. anchors go to partitions by the hash of their k-gram; those that occur once
   can't lie in a repeat, the others go back to their texts;
2. each task sorts the suffixes at those anchors and sends every partition its
   part as a front-coded run: the length shared with the suffix before, and the
   rest. Equal ones are sent once a task. A suffix is as long as it can matter, MIN_WORDS words, and takes along
   hashes of the words before it;
3. a partition merges its runs with a loser tree that keeps, for each contender,
   the prefix it shares with the last suffix put out, and compares from there.
   The order is by partition of the first K words and then by text;
4. prefixes shared by neighbours give the classes of equal right parts for every
   length; with the words to the left they give the windows that repeat, and
   these are joined by text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text, util

MIN_WORDS = 50
#: Words in an anchor: a phrase shorter than this never brings texts together, however many have it; anchors get more frequent with it.
K = 20
#: Suffixes a task holds before it sorts and sends them.
HELD = 40_000


def anchors(h: np.ndarray, row: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the least of some w consecutive ones of their row, ties included."""
    n = len(h)
    if n < w:
        return np.empty(0, np.int64)
    low, size = h, 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: n - w + 1], low[w - size :])
    low = np.where(row[: n - w + 1] == row[w - 1 :], low, np.uint64(0))
    pad = np.zeros(w - 1, np.uint64)
    high, size = np.concatenate([pad, low, pad]), 1
    while size * 2 <= w:
        high = np.maximum(high[:-size], high[size:])
        size *= 2
    if size < w:
        high = np.maximum(high[: len(high) - (w - size)], high[w - size :])
    return np.flatnonzero((high[:n] == h) & (h > 0))


def equal_run(words: text.Words) -> np.ndarray:
    """For each word, how many words from it on, in its row, are the same word."""
    n = len(words.hash)
    last = np.ones(n, np.bool_)
    row = words.row_of()
    last[:-1] = (words.hash[1:] != words.hash[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(last)
    return np.repeat(at, np.diff(at, prepend=-1)) - np.arange(n) + 1


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Anchors have small hashes, so they are scattered once more."""
    return (((text.mix(h) >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)


_SEEN = "part int, key binary, pos binary, hash binary"
_SEEN_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _bounds(sorted_part: np.ndarray, parts: int):
    cut = np.searchsorted(sorted_part, np.arange(parts + 1))
    return [(p, int(cut[p]), int(cut[p + 1])) for p in np.flatnonzero(np.diff(cut)).tolist()]


def _batch(rows, names, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _send_anchors(batches, k: int, least: int, parts: int):
    for b in batches:
        keys = b.column("key").to_numpy(zero_copy_only=False)
        for at, column in text.slices(b.column("text")):
            words = text.Words(column)
            h, pos = text.windows(words, k)
            if not len(h):
                continue
            row = words.row_of()[pos]
            # one word over and over: no anchor beside any other k-gram, and in a window of nothing else its first word is
            same = equal_run(words)[pos]
            a = anchors(np.where(same >= k, _TOP, np.clip(h, np.uint64(1), _TOP - np.uint64(1))), row, least - k + 1)
            a = a[(same[a] < k) | (same[a] >= least)]
            if not len(a):
                continue
            h, row, pos = h[a], row[a], (pos[a] - words.first[row[a]]).astype(np.uint32)
            part = _part(h, parts)
            order = np.argsort(part, kind="stable")
            h, pos, key = h[order], pos[order], keys[at + row[order]]
            yield _batch([(p, key[x:y].tobytes(), pos[x:y].tobytes(), h[x:y].tobytes()) for p, x, y in _bounds(part[order], parts)], ["part", "key", "pos", "hash"], _SEEN_TYPES)


def _repeated(batches):
    table = util.gather(batches)
    if table is None:
        return
    h, key, pos = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("hash", np.uint64), ("key", np.int64), ("pos", np.uint32)))
    order = np.lexsort((pos, key, h))
    h, key, pos = h[order], key[order], pos[order]
    fresh = np.ones(len(h), np.bool_)  # a row repeated whole is one text
    fresh[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
    h, key, pos = h[fresh], key[fresh], pos[fresh]
    again = np.zeros(len(h), np.bool_)
    again[1:] = h[1:] == h[:-1]
    again[:-1] |= again[1:]
    key, pos = key[again], pos[again]
    order = np.argsort(key, kind="stable")
    key, pos = key[order], pos[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    bounds = np.concatenate([at, [len(key)]])
    for s in range(0, len(at), 20_000):
        e = min(s + 20_000, len(at))
        yield pa.RecordBatch.from_arrays([pa.array(key[at[s:e]]), pa.array(util.blobs(pos, bounds[s : e + 1]), pa.binary())], ["key", "places"])


def common(a: bytes, b: bytes, h: int = 0) -> int:
    """Length of the common prefix, of which h bytes are known."""
    n, step = min(len(a), len(b)), 16
    while h < n:
        e = min(h + step, n)
        if a[h:e] == b[h:e]:
            h, step = e, step * 2
            continue
        while e - h > 1:
            mid = (h + e) // 2
            if a[h:mid] == b[h:mid]:
                h = mid
            else:
                e = mid
        return h
    return n


def front_code(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(shared lengths, lengths of the rests, the rests) of sorted texts."""
    shared, rests, before = [], [], b""
    for t in texts:
        h = common(before, t)
        shared.append(h)
        rests.append(t[h:])
        before = t
    return np.array(shared, np.uint32), np.array([len(r) for r in rests], np.uint32), b"".join(rests)


def front_decode(shared: np.ndarray, size: np.ndarray, rests: bytes) -> list[bytes]:
    out, at, before = [], 0, b""
    for h, n in zip(shared.tolist(), size.tolist(), strict=True):
        before = before[:h] + rests[at : at + n]
        at += n
        out.append(before)
    return out


def merge(texts: list[list[bytes]], shared: list[list[int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs: ([(run, place)] in order, length shared with the one before).

    A loser tree over the runs. ``known[r]`` is the prefix that run r's head
    shares with the winner it last lost to, or, for the run that just won, with
    its own predecessor; both are the last text put out on the path that is
    played again. Heads that share more with it win unseen; only equal ones are
    compared, from the known prefix on. Equal texts go by run.
    """
    k = 1
    while k < len(texts):
        k *= 2
    known = [0] * len(texts) + [-1] * (k - len(texts))
    place = [0] * len(texts)
    head: list[bytes] = [t[0] if t else b"" for t in texts]
    for r, t in enumerate(texts):
        if not t:
            known[r] = -1
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = head[a], head[b]
        h = common(s, t, x)
        if h == len(s):
            first = h < len(t) or a < b
        else:
            first = h < len(t) and s[h] < t[h]
        if first:
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    winners = list(range(k))
    while len(winners) > 1:
        base = len(winners) // 2
        up = []
        for i in range(base):
            w, lost = play(winners[2 * i], winners[2 * i + 1])
            loser[base + i] = lost
            up.append(w)
        winners = up
    order: list[tuple[int, int]] = []
    lcp: list[int] = []
    w = winners[0]
    while known[w] >= 0:
        order.append((w, place[w]))
        lcp.append(known[w])
        p = place[w] + 1
        if p < len(texts[w]):
            place[w], head[w], known[w] = p, texts[w][p], shared[w][p]
        else:
            known[w] = -1
        node = (w + k) // 2
        while node:
            w, loser[node] = play(w, loser[node])
            node //= 2
    return order, lcp


_RUN = "part int, shared binary, size binary, rests binary, key binary, doc binary, pos binary, left binary, lefts binary, twin binary"
_RUN_NAMES = [x.split()[0] for x in _RUN.split(", ")]
_RUN_TYPES = [pa.int32()] + [pa.binary()] * 9
_TOP = np.uint64(2**64 - 1)
_NO_ID = np.iinfo(np.int64).max


class _Runs:
    """Suffixes of a task, by partition.

    Of suffixes that agree with all that goes along with them only the first is
    sent. The others repeat in every window they reach, and have an earlier
    occurrence there whatever other tasks hold, so their spans are known here. A
    passage that very many texts share thus comes once a task to its partition.
    """

    def __init__(self, k: int, least: int, parts: int):
        self.k, self.least, self.parts = k, least, parts
        self.texts: list[bytes] = []
        self.columns: list[tuple] = []

    def add(self, column: pa.Array, keys: np.ndarray, docs: np.ndarray, places: list[list[bytes]]) -> None:
        words = text.Words(column)
        h, at = text.windows(words, self.k)
        pos = [np.unique(np.frombuffer(b"".join(p), np.uint32)).astype(np.int64) for p in places]
        row = np.repeat(np.arange(len(pos)), [len(p) for p in pos])
        pos = np.concatenate(pos) if pos else np.empty(0, np.int64)
        a = words.first[row] + pos
        part = _part(h[np.searchsorted(at, a)], self.parts)
        # the words with one space after each
        long = words.end - words.start
        flat = np.full(int(long.sum()) + len(long), 32, np.uint8)
        begin = np.concatenate([[0], np.cumsum(long + 1)])
        inside = util.ranges(long)
        flat[np.repeat(begin[:-1], long) + inside] = words.data[np.repeat(words.start, long) + inside]
        raw = flat.tobytes()
        end = np.minimum(a + self.least, words.first[row + 1])
        self.texts += [raw[x:y] for x, y in zip(begin[a].tolist(), begin[end].tolist(), strict=True)]
        reach = self.least - self.k
        lefts = np.where(equal_run(words)[a] < self.least, np.minimum(reach, pos), 0).astype(np.uint32)
        back = np.maximum(a[:, None] - 1 - np.arange(reach), 0)
        left = (words.hash[back] >> np.uint64(32)).astype(np.uint32)
        left[np.arange(reach) >= lefts[:, None]] = 0
        self.columns.append((part, keys[row], docs[row], pos.astype(np.uint32), left, lefts))

    def flush(self):
        if not self.texts:
            return
        part, key, doc, pos, left, lefts = (np.concatenate(c) for c in zip(*self.columns, strict=True))
        texts, self.texts, self.columns = self.texts, [], []
        raw, wide = left.tobytes(), left.shape[1] * 4
        places = list(zip(doc.tolist(), pos.tolist(), strict=True))
        first: dict[tuple, int] = {}
        twin = np.zeros(len(texts), np.uint8)
        rest = []
        for i, (t, n) in enumerate(zip(texts, lefts.tolist(), strict=True)):
            j = first.setdefault((t, n, raw[i * wide : (i + 1) * wide]), i)
            if j != i:
                if places[i] < places[j]:
                    first[t, n, raw[i * wide : (i + 1) * wide]], i, j = i, j, i
                twin[j] = 1
                rest.append(i)
        sent = np.array([*first.values()])
        del first, places
        order = sent[np.argsort(part[sent], kind="stable")]
        for p, x, y in _bounds(part[order], self.parts):
            own = sorted(order[x:y].tolist(), key=texts.__getitem__)
            shared, size, rests = front_code([texts[i] for i in own])
            o = np.array(own)
            row = (p, shared.tobytes(), size.tobytes(), rests, *(c[o].tobytes() for c in (key, doc, pos, left, lefts, twin)))
            yield _batch([row], _RUN_NAMES, _RUN_TYPES)
        if rest:
            o = np.array(rest)
            high = np.maximum(0, self.least - np.array([texts[i].count(b" ") for i in rest]))
            low = lefts[o].astype(np.int64)
            ok = low >= high
            o, low, high = o[ok], pos[o[ok]] - low[ok], pos[o[ok]] - high[ok]
            home = (key[o].view(np.uint64) % np.uint64(self.parts)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            o, low, high = o[order], low[order].astype(np.int32), high[order].astype(np.int32)
            for p, x, y in _bounds(home[order], self.parts):
                row = (p, None, None, None, key[o[x:y]].tobytes(), doc[o[x:y]].tobytes(), low[x:y].tobytes(), high[x:y].tobytes(), None, None)
                yield _batch([row], _RUN_NAMES, _RUN_TYPES)


def _send_runs(batches, k: int, least: int, parts: int):
    runs = _Runs(k, least, parts)
    for b in batches:
        keys = b.column("key").to_numpy(zero_copy_only=False)
        docs = b.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        places = b.column("places").to_pylist()
        for at, column in text.slices(b.column("text")):
            n = len(column)
            runs.add(column, keys[at : at + n], docs[at : at + n], places[at : at + n])
            if len(runs.texts) >= HELD:
                yield from runs.flush()
    yield from runs.flush()


_SPANS = "key bigint, doc_id bigint, low int, high int, later boolean"


def repeats(shared_words: np.ndarray, right: np.ndarray, left: np.ndarray, lefts: np.ndarray, doc: np.ndarray, start: np.ndarray, least: int) -> np.ndarray:
    """For each sorted suffix and number l of words before it: 0, or 1 if the window of ``least`` words from there repeats, or 2 if an earlier one is known.

    shared_words: words shared with the suffix before; right: words of the suffix.
    """
    n, reach = len(right), left.shape[1]
    out = np.zeros((n, reach + 1), np.int8)
    chain = np.zeros(n, np.uint64)
    for length in range(reach + 1):
        if length:
            chain = text.mix(chain * np.uint64(0x9E3779B97F4A7C15) + left[:, length - 1] + np.uint64(1))
        need = least - length
        ok = np.flatnonzero((lefts >= length) & (right >= need))
        if len(ok) < 2:
            continue
        same = np.cumsum(shared_words < need)[ok].astype(np.uint64)
        key = text.mix(chain[ok] ^ text.mix(same + np.uint64(0x2545F4914F6CDD1D)))
        order = np.lexsort((start[ok], doc[ok], key))
        key = key[order]
        equal = key[1:] == key[:-1]
        flag = np.zeros(len(ok), np.int8)
        flag[:-1][equal] = 1
        flag[1:][equal] = 2
        out[ok[order], length] = flag
    return out


def _span_batch(key, doc, low, high, later) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc, mask=doc == _NO_ID), pa.array(low), pa.array(high), pa.array(later)], ["key", "doc_id", "low", "high", "later"])


def _merge(batches, least: int, k: int):
    table = util.gather(batches)
    if table is None:
        return
    runs = table.to_pylist()
    del table
    known, runs = [r for r in runs if r["rests"] is None], [r for r in runs if r["rests"] is not None]
    for r in known:
        key, doc, low, high = (np.frombuffer(r[c], t) for c, t in (("key", np.int64), ("doc", np.int64), ("pos", np.int32), ("left", np.int32)))
        yield _span_batch(key, doc, low, high, np.ones(len(key), np.bool_))
    if not runs:
        return
    texts, shared = [], []
    for r in runs:
        s, size = np.frombuffer(r["shared"], np.uint32), np.frombuffer(r["size"], np.uint32)
        texts.append(front_decode(s, size, r["rests"]))
        shared.append(s.tolist())
    order, lcp = merge(texts, shared)
    words, right = [], []
    for (r, i), h in zip(order, lcp, strict=True):
        t = texts[r][i]
        words.append(t.count(b" ", 0, h))
        right.append(t.count(b" "))
    base = np.cumsum([0] + [len(t) for t in texts])
    flat = np.array([base[r] + i for r, i in order], np.int64)
    del texts, order
    key, doc, pos, lefts = (np.frombuffer(b"".join(r[c] for r in runs), t)[flat] for c, t in (("key", np.int64), ("doc", np.int64), ("pos", np.uint32), ("lefts", np.uint32)))
    left = np.frombuffer(b"".join(r["left"] for r in runs), np.uint32).reshape(int(base[-1]), least - k)[flat]
    twin = np.frombuffer(b"".join(r["twin"] for r in runs), np.uint8)[flat]
    del runs
    pos, right = pos.astype(np.int64), np.array(right)
    flags = repeats(np.array(words), right, left, lefts, doc, pos, least)
    before = np.arange(flags.shape[1])
    reached = (before <= lefts[:, None]) & (right[:, None] + before >= least)
    flags[(twin[:, None] > 0) & reached & (flags == 0)] = 1
    wide = np.zeros((len(pos), flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    step = wide[:, 1:] != wide[:, :-1]
    at, col = np.nonzero(step)
    # runs of one flag: from a change to the next in the same row
    flag = wide[at, col + 1]
    nxt = np.concatenate([col[1:], [0]])
    on = flag > 0
    at, first, last, flag = at[on], col[on], nxt[on] - 1, flag[on]
    for s in range(0, len(at), 50_000):
        p = slice(s, s + 50_000)
        a = at[p]
        yield _span_batch(key[a], doc[a], (pos[a] - last[p]).astype(np.int32), (pos[a] - first[p]).astype(np.int32), flag[p] == 2)


_OUT = "doc_id bigint, start_word int, end_word int, copy boolean"


def _united(batches, least: int):
    table = util.gather(batches)
    if table is None:
        return
    key, doc = table.column("key").to_numpy(), table.column("doc_id").fill_null(_NO_ID).to_numpy()
    low, high = table.column("low").to_numpy().astype(np.int64), table.column("high").to_numpy().astype(np.int64)
    later = table.column("later").to_numpy(zero_copy_only=False)
    long = high - low + 1
    k, d, s, c = np.repeat(key, long), np.repeat(doc, long), np.repeat(low, long) + util.ranges(long), np.repeat(later, long)
    order = np.lexsort((~c, s, k))
    k, d, s, c = k[order], d[order], s[order], c[order]
    fresh = np.ones(len(k), np.bool_)
    fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    k, d, s, c = k[fresh], d[fresh], s[fresh], c[fresh]
    order = np.lexsort((s, c, k))
    k, d, s, c = k[order], d[order], s[order], c[order]
    new = np.ones(len(k), np.bool_)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (s[1:] > s[:-1] + least)
    at = np.flatnonzero(new)
    end = np.concatenate([at[1:], [len(k)]]) - 1
    yield pa.RecordBatch.from_arrays([pa.array(d[at], mask=d[at] == _NO_ID), pa.array(s[at].astype(np.int32)), pa.array((s[end] + least).astype(np.int32)), pa.array(c[at])], ["doc_id", "start_word", "end_word", "copy"])


def repeated_spans(docs: DataFrame, least: int = MIN_WORDS, k: int = K) -> DataFrame:
    """(doc_id, start_word, end_word, copy): the words of each text that lie in a window of ``least`` words which occurs elsewhere.

    Word numbers begin at 0; end_word is behind the last. Windows are equal if
    their lower-cased words are, whatever stands between: from an anchor on they
    are compared as text, before it by 32-bit hashes of the words. copy is true for spans
    of windows with an earlier occurrence, by identifier and then place, and
    false for first occurrences; the two kinds are joined apart, windows that
    overlap or touch making one span. Repetition inside a text counts. Null
    texts and those below ``least`` words have no spans; very long ones are read
    whole; a null identifier comes
    after all others and stays null; rows repeated whole are one text; an empty
    table gives no rows; other columns, whatever their names, are not looked at.
    A ValueError unless 1 <= k <= least.
    """
    if not 1 <= k <= least:
        raise ValueError(f"an anchor of {k} words doesn't fit a window of {least}")
    spark = docs.sparkSession
    parts = util.parts(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    slim = slim.withColumn("key", F.xxhash64(F.lit("suffix"), "doc_id", "text"))
    seen = util.exchange(slim.select("key", "text").mapInArrow(util.frugal(lambda b: _send_anchors(b, k, least, parts)), _SEEN))
    again = seen.mapInArrow(util.frugal(_repeated), "key bigint, places binary")
    again = again.groupBy("key").agg(F.collect_list("places").alias("places")).withColumnRenamed("key", "__key")
    rows = slim.join(again.hint("shuffle_hash"), F.col("key") == F.col("__key")).select("key", "doc_id", "text", "places")
    runs = util.exchange(rows.mapInArrow(util.frugal(lambda b: _send_runs(b, k, least, parts)), _RUN))
    spans = runs.mapInArrow(util.frugal(lambda b: _merge(b, least, k)), _SPANS)
    return spans.repartition(parts, "key").mapInArrow(util.frugal(lambda b: _united(b, least)), _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(util.table(spark, sf_dir, "documents"))


SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '(?:[a-z0-9_]|[^\\x00-\\x7f])+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {MIN_WORDS - 2})) AS i FROM w WHERE len(w) >= {MIN_WORDS}),
h AS (SELECT doc_id, i - 1 AS s, md5(array_to_string(w[i:i + {MIN_WORDS - 1}], ' ')) AS h FROM p),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1 AS copy, count(*) OVER (PARTITION BY h) AS n FROM h),
g AS (SELECT *, coalesce(s > lag(s) OVER o + {MIN_WORDS}, true)::INT AS fresh FROM r WHERE n > 1 WINDOW o AS (PARTITION BY doc_id, copy ORDER BY s)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, copy ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT doc_id, min(s)::INT AS start_word, (max(s) + {MIN_WORDS})::INT AS end_word, copy FROM i GROUP BY doc_id, copy, island
"""
