"""N-gram Jaccard self-join of documents by prefix filter and prefix tree.

A document is the set of its distinct word n-grams, as hashes of 40 bits and a
partition's number. The global order of n-grams is ascending document frequency,
then hash. Two sets of Jaccard
similarity t or more share an n-gram among the first n - ceil(t n) + 1 of either,
so only those lead to candidates, and a set that has that many n-grams of its
own has no partner at all. Frequencies cover all documents.

How the work is laid out (every step is one packed exchange, nothing is sent to
the driver or broadcast):

1. the sets go to partitions by n-gram, which count frequencies; of an n-gram
   that many documents of a slice share only its number is sent there;
2. n-grams of frequency 2 and more go back to partitions by document, which
   order them and find the documents that may have a partner;
3. their prefixes go to partitions by n-gram, which find candidate neighbours;
4. neighbours meet by document, and each document x gets a home, the least of
   its neighbours and itself; x and its neighbours send their sets there;
5. at each home the sets are stored in a trie, most frequent n-gram first so
   that near copies share paths, and each set walks it once. Pair (x, y), x < y,
   is reported at the home of x only.

Documents with equal sets are one entry of the join throughout. Only n-grams of
frequency 2 and more can be shared, so overlaps counted on those are exact.

Where only groups are wanted (representatives, classes), steps 3 to 5 run twice: first
each n-gram proposes pairs of its documents with one of them, the pivot, and
then all pairs of documents that aren't in one group yet. At a home a set is
compared only with those it isn't connected to yet, without a trie. A cluster of
copies thus costs as much as it has members, and not as many pairs as there are in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text, util

N = 5
THRESHOLD = 0.35

_LOW = np.uint64((1 << 40) - 1)
_PACK = "part int, kind int, src int, sig binary, num binary, cnt binary, gram binary"
_PACK_NAMES = ["part", "kind", "src", "sig", "num", "cnt", "gram"]


def prefix_length(n, threshold: float):
    """n-grams of a set of n in which any partner must share one."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def least_overlap(a, b, threshold: float):
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def _bucket(grams: np.ndarray, parts: int) -> np.ndarray:
    return ((grams >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)


def _five(values: np.ndarray) -> np.ndarray:
    """The low five bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _unfive(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(n, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def signatures(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text.mix(grams ^ np.uint64(0x5851F42D4C957F2D)))])
    return text.mix(acc[first[1:]] - acc[first[:-1]] + np.diff(first).astype(np.uint64))


def _rows(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _by_part(part: np.ndarray, parts: int):
    """(order, bounds) that sorts rows into parts."""
    order = np.argsort(part.astype(np.uint32), kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _grouped(owner: np.ndarray):
    """For owners in runs: (owner of each run, length of each run)."""
    at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    return owner[at], np.diff(np.concatenate([at, [len(owner)]]))


#: Documents of a slice that share an n-gram from which on it is counted here and not at its partition.
HOT = 16


def _hot(g: np.ndarray) -> np.ndarray:
    """Which of the n-grams occur HOT times or more."""
    slot = (g & np.uint64(0xFFFFF)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(slot, minlength=1 << 20)[slot] >= HOT)
    hot = np.zeros(len(g), np.bool_)
    if len(maybe):
        _, inverse, count = np.unique(g[maybe], return_inverse=True, return_counts=True)
        hot[maybe] = count[inverse] >= HOT
    return hot


def _send_sets(batches, n: int, parts: int):
    for batch in batches:
        for at, column in text.slices(batch.column("text")):
            grams, first = text.row_sets(*text.ngrams(text.Words(column), n))
            size = np.diff(first)
            sig = signatures(grams, first)
            ids, marks = (batch.column(c).slice(at, len(column)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "mark"))
            has = np.flatnonzero(size > 0)
            rows = []
            home = (sig[has] % np.uint64(parts)).astype(np.int64)
            order, cut = _by_part(home, parts)
            for p in np.flatnonzero(np.diff(cut)).tolist():
                k = has[order[cut[p] : cut[p + 1]]]
                rows.append((p, 0, 0, sig[k].tobytes(), size[k].astype(np.uint32).tobytes(), ids[k].tobytes(), marks[k].tobytes()))
            _, once = np.unique(sig[has], return_index=True)
            mine = np.zeros(len(size), np.bool_)
            mine[has[once]] = True
            doc = np.repeat(np.arange(len(size)), size)
            keep = mine[doc]
            g, doc = grams[keep], doc[keep]
            hot = _hot(g)
            if hot.any():
                rows += _send_hot(g[hot], doc[hot], sig, parts)
                g, doc = g[~hot], doc[~hot]
            part = _bucket(g, parts).astype(np.int64)
            order, cut = _by_part(part, parts)
            g, doc = _five(g[order]), doc[order]
            for p in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[p], cut[p + 1]
                owner, count = _grouped(doc[a:b])
                rows.append((p, 1, 0, sig[owner].tobytes(), b"", count.astype(np.uint32).tobytes(), g[a:b].tobytes()))
            if rows:
                yield _rows(rows, _PACK_NAMES, _TYPES)


def _send_hot(g: np.ndarray, doc: np.ndarray, sig: np.ndarray, parts: int) -> list[tuple]:
    """Messages of n-grams counted in the slice: (3) to documents, which n-grams they have; (4) to an n-gram's partition, its number here and the partitions that ask for its frequency."""
    part = _bucket(g, parts).astype(np.int64)
    name = (g & _LOW) | (part.astype(np.uint64) << np.uint64(40))
    home = (sig[doc] % np.uint64(parts)).astype(np.int64)
    rows = []
    order = np.lexsort((doc, home))
    cut = np.searchsorted(home[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        k = order[cut[p] : cut[p + 1]]
        owner, count = _grouped(doc[k])
        rows.append((p, 3, 0, sig[owner].tobytes(), b"", count.astype(np.uint32).tobytes(), name[k].tobytes()))
    order = np.lexsort((home, name))
    name, home = name[order], home[order]
    one, count = _grouped(name)
    ask = np.ones(len(name), np.bool_)
    ask[1:] = (name[1:] != name[:-1]) | (home[1:] != home[:-1])
    asks = np.add.reduceat(ask, np.cumsum(count) - count)
    to = (one >> np.uint64(40)).astype(np.int64)
    cut = np.searchsorted(to, np.arange(parts + 1))
    bounds, home = np.concatenate([[0], np.cumsum(asks)]), home[ask].astype(np.uint32)
    for p in np.flatnonzero(np.diff(cut)).tolist():
        a, b = cut[p], cut[p + 1]
        head = np.stack([count[a:b], asks[a:b]], 1).astype(np.uint32)
        rows.append((p, 4, 0, b"", head.tobytes(), home[bounds[a] : bounds[b]].tobytes(), _five(one[a:b]).tobytes()))
    return rows


def _cat(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype)


def _count(batches, parts: int):
    """By n-gram: drop those of one document, send the others back with their frequency."""
    sigs, counts, grams = [], [], []
    hot: list[tuple] = []
    src = 0
    for b in batches:
        rows = b.to_pydict()
        passed = []
        for i, kind in enumerate(rows["kind"]):
            src = rows["part"][i]
            if kind in (0, 3):
                passed.append(tuple(rows[k][i] for k in _PACK_NAMES))
            elif kind == 4:
                hot.append((_unfive(rows["gram"][i]), np.frombuffer(rows["num"][i], np.uint32).reshape(-1, 2), np.frombuffer(rows["cnt"][i], np.uint32)))
            else:
                sigs.append(rows["sig"][i])
                counts.append(rows["cnt"][i])
                grams.append(_unfive(rows["gram"][i]))
        if passed:
            yield _rows(passed, _PACK_NAMES, _TYPES)
    g, doc = np.empty(0, np.uint64), np.empty(0, np.int64)
    if sigs:
        sig, own = np.unique(_cat(sigs, np.uint64), return_inverse=True)
        doc = np.repeat(own.astype(np.uint32), _cat(counts, np.uint32))
        g = np.concatenate(grams)
        del grams
        if len(sig) < 1 << 24:
            key = util.distinct((g << np.uint64(24)) | doc.astype(np.uint64))
            g, doc = key >> np.uint64(24), (key & np.uint64((1 << 24) - 1)).astype(np.int64)
            del key
        else:
            order = np.lexsort((doc, g))
            g, doc = g[order], doc[order].astype(np.int64)
            fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])])
            g, doc = g[fresh], doc[fresh]
    one, run = _grouped(g)
    out: list[tuple] = []
    if hot:
        name, total, ask = _hot_counts(hot)
        # what other slices sent document by document counts too, and the other way round
        if len(one):
            at = np.minimum(np.searchsorted(one, name), len(one) - 1)
            both = one[at] == name
            total[both] += run[at[both]]
            run[at[both]] = total[both]
        which, home = ask
        order, cut = _by_part(home, parts)
        which = which[order]
        for p in np.flatnonzero(np.diff(cut)).tolist():
            k = which[cut[p] : cut[p + 1]]
            out.append((p, 5, src, b"", np.minimum(total[k], 65535).astype(np.uint16).tobytes(), b"", _five(name[k]).tobytes()))
    if len(g):
        df = np.repeat(run, np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), [len(g)]])))
        shared = df > 1
        g, doc, df = g[shared], doc[shared], np.minimum(df[shared], 65535).astype(np.uint16)
        order = np.argsort(doc, kind="stable")
        g, doc, df = g[order], doc[order], df[order]
        back = (sig % np.uint64(parts)).astype(np.int64)
        order, cut = _by_part(back[doc], parts)
        g, doc, df = _five(g[order]), doc[order], df[order]
        for p in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[p], cut[p + 1]
            owner, count = _grouped(doc[a:b])
            out.append((p, 2, src, sig[owner].tobytes(), df[a:b].tobytes(), count.astype(np.uint32).tobytes(), g[a:b].tobytes()))
    if out:
        yield _rows(out, _PACK_NAMES, _TYPES)


def _hot_counts(hot: list[tuple]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(n-grams, their numbers added up, (n-gram, partition) that ask)."""
    gram, head, home = (np.concatenate([h[k] for h in hot]) for k in range(3))
    name, inverse = np.unique(gram, return_inverse=True)
    total = np.bincount(inverse, weights=head[:, 0], minlength=len(name)).astype(np.int64)
    ask = util.distinct((np.repeat(inverse, head[:, 1]).astype(np.uint64) << np.uint64(32)) | home.astype(np.uint64))
    return name, total, ((ask >> np.uint64(32)).astype(np.int64), (ask & np.uint64(0xFFFFFFFF)).astype(np.int64))


_SETS = "sig bigint, size int, own int, ids array<bigint>, marks array<bigint>, df binary, gram binary"


def _order(batches, threshold: float):
    """By document: its shared n-grams in the global order, if it may have a partner."""
    table = util.gather(batches)
    if table is None:
        return
    rows = table.to_pydict()
    kinds = np.array(rows["kind"])
    at = np.flatnonzero(kinds == 0).tolist()
    sig = _cat([rows["sig"][i] for i in at], np.uint64)
    size = _cat([rows["num"][i] for i in at], np.uint32)
    ids, marks = (_cat([rows[c][i] for i in at], np.int64) for c in ("cnt", "gram"))
    order = np.lexsort((marks, ids, sig))
    sig, size, ids, marks = sig[order], size[order].astype(np.int64), ids[order], marks[order]
    fresh = np.ones(len(sig), np.bool_)
    fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
    sig, size, ids, marks = sig[fresh], size[fresh], ids[fresh], marks[fresh]
    one, runs = _grouped(sig)
    bounds = np.concatenate([[0], np.cumsum(runs)])
    size = size[bounds[:-1]]
    named: dict[int, np.ndarray] = {}
    for kind in (2, 5):
        named[kind] = np.concatenate([np.empty(0, np.uint64), *(_unfive(rows["gram"][i]) | (np.uint64(rows["src"][i]) << np.uint64(40)) for i in np.flatnonzero(kinds == kind).tolist())])
    at, hot, often = (np.flatnonzero(kinds == kind).tolist() for kind in (2, 3, 5))
    gram, df = named[2], _cat([rows["num"][i] for i in at], np.uint16)
    owner = np.repeat(_cat([rows["sig"][i] for i in at], np.uint64), _cat([rows["cnt"][i] for i in at], np.uint32))
    if hot:
        table_df = _cat([rows["num"][i] for i in often], np.uint16)
        order = np.argsort(named[5])
        more = _cat([rows["gram"][i] for i in hot], np.uint64)
        gram, df = np.concatenate([gram, more]), np.concatenate([df, table_df[order[np.searchsorted(named[5], more, sorter=order)]]])
        owner = np.concatenate([owner, np.repeat(_cat([rows["sig"][i] for i in hot], np.uint64), _cat([rows["cnt"][i] for i in hot], np.uint32))])
    doc = np.searchsorted(one, owner)
    del rows, table, named, owner
    order = np.lexsort((gram, (doc.astype(np.int64) << 16) | df))
    gram, df, doc = gram[order], df[order], doc[order]
    fresh = np.ones(len(gram), np.bool_)  # copies in several slices bring an n-gram both ways
    fresh[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, df, doc = gram[fresh], df[fresh], doc[fresh]
    shared = np.bincount(doc, minlength=len(one))
    lo = np.concatenate([[0], np.cumsum(shared)])
    own = size - shared
    may = prefix_length(size, threshold) > own
    for a in range(0, len(one), 2000):
        some = range(a, min(a + 2000, len(one)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(one[a : a + 2000].view(np.int64)),
                pa.array(size[a : a + 2000].astype(np.int32)),
                pa.array(own[a : a + 2000].astype(np.int32)),
                pa.array([ids[bounds[i] : bounds[i + 1]] for i in some], pa.list_(pa.int64())),
                pa.array([marks[bounds[i] : bounds[i + 1]] for i in some], pa.list_(pa.int64())),
                pa.array([df[lo[i] : lo[i + 1]].tobytes() if may[i] else None for i in some], pa.binary()),
                pa.array([gram[lo[i] : lo[i + 1]].tobytes() if may[i] else None for i in some], pa.binary()),
            ],
            ["sig", "size", "own", "ids", "marks", "df", "gram"],
        )


def _send_prefixes(batches, threshold: float, parts: int):
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, label = (batch.column(c).to_numpy().view(np.uint64) for c in ("sig", "label"))
        size = batch.column("size").to_numpy().astype(np.int64)
        own = batch.column("own").to_numpy().astype(np.int64)
        take = prefix_length(size, threshold) - own
        grams = [np.frombuffer(g.as_buffer(), np.uint64)[:k] for g, k in zip(batch.column("gram"), take.tolist(), strict=True)]
        count = np.array([len(g) for g in grams])
        doc = np.repeat(np.arange(len(sig)), count)
        pos = (util.ranges(count) + own[doc]).astype(np.uint32)
        g = np.concatenate(grams)
        order, cut = _by_part((g >> np.uint64(40)).astype(np.int64), parts)
        g, doc, pos = _five(g[order]), doc[order], pos[order]
        rows = []
        for p in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[p], cut[p + 1]
            owner, run = _grouped(doc[a:b])
            head = np.stack([size[owner], run], 1).astype(np.uint32)
            # a document that is in no group yet is its own label
            names = sig[owner].tobytes() + (b"" if (label[owner] == sig[owner]).all() else label[owner].tobytes())
            rows.append((p, 0, 0, names, head.tobytes(), pos[a:b].tobytes(), g[a:b].tobytes()))
        yield _rows(rows, _PACK_NAMES, _TYPES)


def candidates(gram: np.ndarray, doc: np.ndarray, pos: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of documents that share an n-gram, may be near enough in size and have enough n-grams left after it."""
    order = np.lexsort((size[doc], gram))
    g, d, p = gram[order], doc[order].astype(np.int64), pos[order].astype(np.int64)
    n = size[d]
    rest = n - p - 1
    end = np.repeat(np.cumsum(_grouped(g)[1]), _grouped(g)[1])
    docs = np.uint64(len(size))
    found: list[np.ndarray] = []
    held, step = 0, 1
    live = np.arange(len(g))
    while True:
        live = live[live + step < end[live]]
        live = live[n[live] >= threshold * n[live + step] - 1e-9]  # sizes ascend, so a partner further on is larger still
        if not len(live):
            break
        other = live + step
        ok = (d[live] != d[other]) & (1 + np.minimum(rest[live], rest[other]) >= least_overlap(n[live], n[other], threshold))
        a, b = d[live[ok]], d[other[ok]]
        found.append(np.minimum(a, b).astype(np.uint64) * docs + np.maximum(a, b).astype(np.uint64))
        held += len(a)
        if held > 4_000_000:
            found = [util.distinct(np.concatenate(found))]
            held = len(found[0]) // 2
        step += 1
    pairs = util.distinct(np.concatenate(found)) if found else np.empty(0, np.uint64)
    return (pairs // docs).astype(np.int64), (pairs % docs).astype(np.int64)


def _may(d, e, rest_d, rest_e, size, threshold: float) -> np.ndarray:
    """Which pairs of documents that share an n-gram are near enough in size and have enough n-grams left after it."""
    n, m = size[d], size[e]
    return (d != e) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9) & (1 + np.minimum(rest_d, rest_e) >= least_overlap(n, m, threshold))


def pivots(gram: np.ndarray, doc: np.ndarray, pos: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each document with the least one among those that share an n-gram with it and are of its class of size."""
    # sizes of one class differ by no more than the threshold allows
    class_of = np.floor(np.log(size) / -np.log(threshold)).astype(np.int64) if threshold < 1 else size
    order = np.lexsort((doc, class_of[doc], gram))
    g, d, p = gram[order], doc[order].astype(np.int64), pos[order].astype(np.int64)
    c, rest = class_of[d], size[d] - p - 1
    head = np.ones(len(g), np.bool_)
    head[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(head)
    first = np.repeat(at, np.diff(np.concatenate([at, [len(g)]])))
    ok = _may(d[first], d, rest[first], rest, size, threshold)
    pairs = util.distinct(d[first][ok].astype(np.uint64) * np.uint64(len(size)) + d[ok].astype(np.uint64))
    return (pairs // np.uint64(len(size))).astype(np.int64), (pairs % np.uint64(len(size))).astype(np.int64)


def across(gram: np.ndarray, doc: np.ndarray, pos: np.ndarray, size: np.ndarray, label: np.ndarray, threshold: float, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """As candidates, but only pairs of documents of different labels; others aren't gone through."""
    order = np.lexsort((label[doc], gram))
    g, d, p = gram[order], doc[order].astype(np.int64), pos[order].astype(np.int64)
    rest, lab = size[d] - p - 1, label[d]
    n = len(g)
    new = np.ones(n, np.bool_)
    new[1:] = g[1:] != g[:-1]
    fresh = new.copy()
    fresh[1:] |= lab[1:] != lab[:-1]

    def ends(begin):
        at = np.flatnonzero(begin)
        return np.repeat(np.concatenate([at[1:], [n]]), np.diff(np.concatenate([at, [n]])))

    own = ends(fresh)
    many = ends(new) - own  # the documents of the run behind those of one's own label
    total = np.cumsum(many)
    docs, found, at = np.uint64(len(size)), [np.empty(0, np.uint64)], 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        k = np.arange(at, end)
        i = np.repeat(k, many[k])
        j = np.repeat(own[k], many[k]) + util.ranges(many[k])
        ok = _may(d[i], d[j], rest[i], rest[j], size, threshold)
        x, y = d[i[ok]].astype(np.uint64), d[j[ok]].astype(np.uint64)
        found = [util.distinct(np.concatenate([*found, np.minimum(x, y) * docs + np.maximum(x, y)]))]
        at = end
    return (found[0] // docs).astype(np.int64), (found[0] % docs).astype(np.int64)


def _neighbours(batches, threshold: float, parts: int, how: str):
    table = util.gather(batches)
    if table is None:
        return
    rows = table.to_pydict()
    heads = [np.frombuffer(h, np.uint32).reshape(-1, 2).astype(np.int64) for h in rows["num"]]
    names = [np.frombuffer(x, np.uint64) for x in rows["sig"]]
    sig, own = np.unique(np.concatenate([x[: len(h)] for x, h in zip(names, heads, strict=True)]).view(np.int64), return_inverse=True)
    sig, head = sig.view(np.uint64), np.concatenate(heads)  # in the order that _homes has
    size = np.zeros(len(sig), np.int64)
    size[own] = head[:, 0]
    doc = np.repeat(own, head[:, 1])
    gram = np.concatenate([_unfive(g) for g in rows["gram"]])
    pos = _cat(rows["cnt"], np.uint32)
    if how == "all":
        a, b = candidates(gram, doc, pos, size, threshold)
    elif how == "pivots":
        a, b = pivots(gram, doc, pos, size, threshold)
    else:
        label = np.zeros(len(sig), np.uint64)
        label[own] = np.concatenate([x[-len(h) :] for x, h in zip(names, heads, strict=True)])
        a, b = across(gram, doc, pos, size, label, threshold)
    if not len(a):
        return
    x, y = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    order, cut = _by_part((sig[x] % np.uint64(parts)).astype(np.int64), parts)
    x, y = x[order], y[order]
    out = []
    for p in np.flatnonzero(np.diff(cut)).tolist():
        owner, run = _grouped(x[cut[p] : cut[p + 1]])
        # neighbours are numbers in a list of those of this message, as steps: alike for near copies, they pack well
        named, at = np.unique(y[cut[p] : cut[p + 1]], return_inverse=True)
        step = np.diff(at, prepend=0)
        begin = np.cumsum(run) - run
        step[begin] = at[begin]
        step = step.astype(np.uint16 if len(named) < 65536 else np.uint32)
        out.append((p, step.itemsize, 0, sig[owner].tobytes(), step.tobytes(), run.astype(np.uint32).tobytes(), sig[named].tobytes()))
    yield _rows(out, _PACK_NAMES, _TYPES)


def _numbers(width: int, raw: bytes, run: np.ndarray) -> np.ndarray:
    """The numbers whose steps are given, starting anew with each run."""
    step = np.frombuffer(raw, f"<u{width}").astype(np.int64)
    total = np.cumsum(step)
    begin = np.cumsum(run) - run
    return total - np.repeat(total[begin] - step[begin], run)


#: Documents that come to one home in a group, where only groups are wanted.
HOME_DOCS = 4096


def _homes(batches, split: bool = False):
    table = util.gather(batches)
    if table is None:
        return
    rows = table.to_pydict()
    runs = [np.frombuffer(c, np.uint32).astype(np.int64) for c in rows["cnt"]]
    x = np.repeat(_cat(rows["sig"], np.uint64), np.concatenate(runs)).view(np.int64)
    y = np.concatenate([np.frombuffer(g, np.int64)[_numbers(w, n, r)] for g, w, n, r in zip(rows["gram"], rows["kind"], rows["num"], runs, strict=True)])
    least = np.minimum(x, y)
    order = np.argsort(x, kind="stable")
    x, y, least = x[order], y[order], least[order]
    owner, run = _grouped(x)
    home = np.minimum.reduceat(least, np.cumsum(run) - run)
    up = y > x  # only pairs (x, larger) are reported at x's home
    at, who, mine = np.repeat(home, run)[up], y[up], np.zeros(int(up.sum()), np.bool_)
    if split:
        # a document of very many neighbours meets them in several places; a pair may then be found twice
        piece = (util.ranges(run) // HOME_DOCS)[up].astype(np.uint64)
        at = np.where(piece > 0, text.mix(at.view(np.uint64) + piece * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), at)
        own = np.repeat(owner, run)[up]
        mark = np.ones(len(at), np.bool_)
        mark[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
        at, who, mine = np.concatenate([at, at[mark]]), np.concatenate([who, own[mark]]), np.concatenate([mine, np.ones(int(mark.sum()), np.bool_)])
    else:
        uses = np.add.reduceat(up, np.cumsum(run) - run) > 0
        at, who, mine = np.concatenate([at, home[uses]]), np.concatenate([who, owner[uses]]), np.concatenate([mine, np.ones(int(uses.sum()), np.bool_)])
    order = np.lexsort((~mine, who, at))
    at, who, mine = at[order], who[order], mine[order]
    fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (who[1:] != who[:-1])]) if len(at) else np.empty(0, np.bool_)
    for a in range(0, int(fresh.sum()), 50_000):
        k = np.flatnonzero(fresh)[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(who[k]), pa.array(at[k]), pa.array(mine[k])], ["sig", "home", "mine"])


class Trie:
    """A path-compressed prefix tree of ordered integer sets.

    Sets are sorted, and each adds a segment below the longest common prefix with
    the one before; ``up`` is the segment it hangs from. Levels hold segments by
    their number of ancestors, so that a walk handles a level at a time.
    """

    def __init__(self, sets: list[np.ndarray], size: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.order = np.array(order)
        m = len(sets)
        self.start = np.zeros(m, np.int64)  # depth at which the segment starts
        self.up = np.full(m, -1, np.int64)
        level = np.zeros(m, np.int64)
        length = np.array([len(sets[i]) for i in order])
        stack: list[int] = []
        pieces = []
        for i, o in enumerate(order):
            s = sets[o]
            if i:
                k = min(len(before), len(s))
                differ = before[:k] != s[:k]
                lcp = int(differ.argmax()) if k and differ.any() else k
                while stack and self.start[stack[-1]] >= lcp:
                    stack.pop()
                self.start[i] = lcp
                if lcp and stack:
                    self.up[i] = stack[-1]
            level[i] = len(stack)
            stack.append(i)
            pieces.append(s[self.start[i] :])
            before = s
        self.flat = np.concatenate(pieces) if m else np.empty(0, np.int64)
        self.long = np.array([len(p) for p in pieces])
        self.offset = np.cumsum(self.long) - self.long
        self.size = size[self.order]
        # of the sets at or below a segment: the least size, and the most n-grams from its start on
        self.least, self.most = self.size.copy(), length - self.start
        longest = length.copy()
        for i in range(m - 1, -1, -1):
            u = self.up[i]
            if u >= 0:
                self.least[u] = min(self.least[u], self.least[i])
                longest[u] = max(longest[u], longest[i])
        self.most = longest - self.start
        self.levels = [np.flatnonzero(level == k) for k in range(int(level.max()) + 1)] if m else []

    def walk(self, query: np.ndarray, size: int, marks: np.ndarray, threshold: float):
        """(set, overlap) of the sets near enough to the query, whose n-grams are marked in ``marks``."""
        m = len(self.order)
        base = np.zeros(m, np.int64)
        alive = np.zeros(m, np.bool_)
        whole = np.full(m, -1, np.int64)
        sums: np.ndarray | None = None
        slot = np.zeros(m, np.int64)
        for segs in self.levels:
            up = self.up[segs]
            segs = segs[(up < 0) | alive[up]]
            if not len(segs):
                break
            up = self.up[segs]
            if sums is not None:
                inner = up >= 0
                u = up[inner]
                base[segs[inner]] = base[u] + sums[slot[u] + self.start[segs[inner]] - self.start[u]] - sums[slot[u]]
            empty = self.long[segs] == 0
            head = self.flat[np.minimum(self.offset[segs], max(0, len(self.flat) - 1))] if len(self.flat) else np.zeros(len(segs), np.int64)
            left = np.where(empty, 0, len(query) - np.searchsorted(query, head))
            need = least_overlap(size, self.least[segs], threshold)
            segs = segs[base[segs] + np.minimum(left, self.most[segs]) >= need]
            if not len(segs):
                break
            alive[segs] = True
            long = self.long[segs]
            at = np.repeat(self.offset[segs], long) + util.ranges(long)
            new = np.concatenate([[0], np.cumsum(marks[self.flat[at]])])
            begin = np.cumsum(long) - long
            shift = 0 if sums is None else len(sums)
            sums = new if sums is None else np.concatenate([sums, new])
            slot[segs] = begin + shift
            whole[segs] = base[segs] + new[begin + long] - new[begin]
        near = np.flatnonzero(whole >= np.maximum(1, least_overlap(size, self.size, threshold)))
        return self.order[near], whole[near]


def trie_join(sets: list[np.ndarray], freq: list[np.ndarray], size: np.ndarray, mine: np.ndarray, rank: np.ndarray, threshold: float):
    """[(x, y, overlap)] with rank[x] < rank[y], mine[x] and Jaccard similarity of threshold or more; sets hold n-grams, freq their frequencies."""
    gram, at, inverse = np.unique(np.concatenate(sets), return_index=True, return_inverse=True)
    place = np.empty(len(gram), np.int64)
    place[np.lexsort((gram, -np.concatenate(freq)[at].astype(np.int64)))] = np.arange(len(gram))
    ends = np.cumsum([len(s) for s in sets])
    ordered = [np.sort(p) for p in np.split(place[inverse], ends[:-1])]
    trie = Trie(ordered, size)
    marks = np.zeros(len(gram), np.int32)
    out = []
    for x in np.flatnonzero(mine).tolist():
        q = ordered[x]
        marks[q] = 1
        y, overlap = trie.walk(q, int(size[x]), marks, threshold)
        marks[q] = 0
        ok = rank[y] > rank[x]
        out += [(x, b, c) for b, c in zip(y[ok].tolist(), overlap[ok].tolist(), strict=True)]
    return out


_FOUND = "a array<bigint>, b array<bigint>, overlap int, either int"


def _at_home(rows: pa.Table):
    """(signatures, sets of n-grams, sizes, which are compared here) of a home."""
    sets = [np.frombuffer(g.as_buffer(), np.uint64) for c in rows.column("gram").chunks for g in c]
    return rows.column("sig").to_numpy(), sets, rows.column("size").to_numpy().astype(np.int64), rows.column("mine").to_numpy(zero_copy_only=False)


def _join(batches, threshold: float):
    held: list[tuple] = []
    for rows in util.runs_of(batches, "home"):
        if rows.num_rows < 2:
            continue
        sig, sets, size, mine = _at_home(rows)
        freq = [np.frombuffer(g.as_buffer(), np.uint16) for c in rows.column("df").chunks for g in c]
        found = trie_join(sets, freq, size, mine, sig, threshold)
        ids = rows.column("ids").to_pylist()
        held += [(ids[x], ids[y], c, int(size[x] + size[y] - c)) for x, y, c in found]
        if len(held) > 20_000:
            yield _rows(held, ["a", "b", "overlap", "either"], [pa.list_(pa.int64())] * 2 + [pa.int32()] * 2)
            held = []
    if held:
        yield _rows(held, ["a", "b", "overlap", "either"], [pa.list_(pa.int64())] * 2 + [pa.int32()] * 2)


#: N-grams that a comparison looks at once.
AT_ONCE = 1 << 21


def forest(sets: list[np.ndarray], size: np.ndarray, mine: np.ndarray, rank: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs that connect what those of trie_join connect, and no more of them.

    A set is compared only with those it isn't connected to yet: in a group of
    near copies the first takes in nearly all, and for the others little is left.
    """
    gram, flat = np.unique(np.concatenate(sets), return_inverse=True)
    long = np.array([len(s) for s in sets])
    begin = np.cumsum(long) - long
    marks = np.zeros(len(gram), np.bool_)
    label = np.arange(len(sets))
    tree = []
    for x in np.flatnonzero(mine).tolist():
        rest = np.flatnonzero((label != label[x]) & (rank > rank[x]))
        need = np.maximum(1, least_overlap(size[x], size[rest], threshold))
        may = np.minimum(long[x], long[rest]) >= need
        rest, need = rest[may], need[may]
        if not len(rest):
            continue
        own = flat[begin[x] : begin[x] + long[x]]
        marks[own] = True
        ends = np.cumsum(long[rest])
        at = 0
        while at < len(rest):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            some = rest[at:end]
            hit = marks[flat[np.repeat(begin[some], long[some]) + util.ranges(long[some])]]
            near = some[np.add.reduceat(hit, np.cumsum(long[some]) - long[some], dtype=np.int64) >= need[at:end]]
            groups, first = np.unique(label[near], return_index=True)
            new = groups != label[x]
            if new.any():
                tree += [(x, y) for y in near[first[new]].tolist()]
                label[np.isin(label, groups)] = label[x]
            at = end
        marks[own] = False
    return tree


def _forest(batches, threshold: float):
    """Edges (u, v) between sets that connect what the pairs at a home connect."""
    held: list[tuple] = []
    for rows in util.runs_of(batches, "home"):
        if rows.num_rows < 2:
            continue
        sig, sets, size, mine = _at_home(rows)
        held += [(int(sig[x]), int(sig[y])) for x, y in forest(sets, size, mine, sig, threshold)]
        if len(held) > 20_000:
            yield _rows(held, ["u", "v"], [pa.int64()] * 2)
            held = []
    if held:
        yield _rows(held, ["u", "v"], [pa.int64()] * 2)


def _sets(docs: DataFrame, n: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """The distinct n-gram sets, with the rows (identifier and hash of the text) that have them."""
    parts = util.parts(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL").withColumn("mark", _mark(F.col("text")))
    sent = util.exchange(slim.mapInArrow(util.frugal(lambda b: _send_sets(b, n, parts)), _PACK))
    counted = util.exchange(sent.mapInArrow(util.frugal(lambda b: _count(b, parts)), _PACK))
    return util.spool(counted.mapInArrow(util.frugal(lambda b: _order(b, threshold)), _SETS), "sets")


def _mark(t) -> Column:
    return F.xxhash64(F.lit("near"), t.cast("string"))


def _meet(may: DataFrame, labels: DataFrame, threshold: float, how: str) -> DataFrame:
    """Sets at the homes where they are compared; may: sets that may have a partner, labels: (sig, label)."""
    parts = util.parts(may.sparkSession)
    entries = util.exchange(labels.select("sig", "label", "size", "own", "gram").mapInArrow(util.frugal(lambda b: _send_prefixes(b, threshold, parts)), _PACK))
    near = util.exchange(entries.mapInArrow(util.frugal(lambda b: _neighbours(b, threshold, parts, how)), _PACK))
    homes = near.mapInArrow(util.frugal(lambda b: _homes(b, how != "all")), "sig bigint, home bigint, mine boolean").groupBy("sig", "home").agg(F.max("mine").alias("mine"))
    return homes.join(may.select("sig", "size", "ids", "df", "gram") if how == "all" else may.select("sig", "size", "df", "gram"), "sig").repartition(parts, "home").sortWithinPartitions("home")


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: all pairs of documents whose word n-gram sets have at least this Jaccard similarity.

    A text of 1 to n - 1 words has one n-gram, all its words. Null texts, texts
    without words and rows without identifier match nothing. A row repeated whole
    counts once; copies of a text are pairs of similarity 1; an identifier of
    several texts is paired for each of them, but not with itself. A very long
    text is a larger set. Ties at the threshold are pairs. An empty table gives
    no rows; columns other than the two named, whatever their names, are not
    looked at. N-grams are compared by hashes of 40 bits and a partition's
    number and equal sets by 64 bits, so that a similarity may be off by one
    n-gram in some 10**12 comparisons of two.
    """
    sets = _sets(docs, n, threshold, id_col, text_col).withColumn("ids", F.array_distinct("ids"))
    may = sets.where("gram IS NOT NULL")
    found = _meet(may, may.withColumn("label", F.col("sig")), threshold, "all").mapInArrow(util.frugal(lambda b: _join(b, threshold)), _FOUND)
    pairs = found.select(F.explode("a").alias("x"), "b", (F.col("overlap") / F.col("either")).alias("jaccard")).select("x", F.explode("b").alias("y"), "jaccard")
    same = sets.where("size(ids) > 1").select(F.explode("ids").alias("x"), "ids").select("x", F.explode("ids").alias("y")).where("x < y").withColumn("jaccard", F.lit(1.0))
    both = pairs.where("x <> y").unionByName(same)
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node each node of edges (u, v) is connected to, by alternating large-star and small-star steps.

    A node's neighbours are never listed in one row: the least of them is found
    by an aggregation and joined back, where Spark splits the partition of a hub.
    Each step is spooled; the number of steps grows with the logarithm of the longest chain.
    """
    edges = util.spool(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = util.spool(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = util.spool(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def _classes(docs: DataFrame, n: int, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(all sets, (sig, root) of those that chains of near pairs link to another set)."""
    sets = _sets(docs, n, threshold, id_col, text_col)
    may = sets.where("gram IS NOT NULL")
    step = lambda labels, how: _meet(may, labels, threshold, how).mapInArrow(util.frugal(lambda b: _forest(b, threshold)), "u bigint, v bigint")
    first = components(step(may.withColumn("label", F.col("sig")), "pivots"))
    labels = may.join(first.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("root", "sig"))
    second = util.spool(step(labels, "across"), "across")
    whole = components(first.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(second)) if not second.isEmpty() else first
    return sets, whole.unionByName(whole.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "sig")


def groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(root, id, mark): rows that chains of near pairs link to another, as identifier and hash of the text, and the name of their group."""
    sets, whole = _classes(docs, n, threshold, id_col, text_col)
    rows = sets.select("sig", "ids", "marks").join(whole, "sig", "left").where("root IS NOT NULL OR size(ids) > 1")
    return rows.select(F.coalesce("root", "sig").alias("root"), F.explode(F.arrays_zip("ids", "marks")).alias("r")).select("root", F.col("r.ids").alias("id"), F.col("r.marks").alias("mark"))


#: Sets and n-grams of a piece of a class, about; pieces are compared two by two.
PIECE_SETS = 2048
PIECE_GRAMS = 1 << 20


def overlaps(gram: np.ndarray, doc: np.ndarray, first: int, many: int) -> np.ndarray:
    """Common n-grams of each of the sets below ``first`` (rows) with each of the others, up to ``many`` (columns); doc: the set that has gram.

    N-grams of few pairs are counted pair by pair and the others as products of matrices of 0 and 1.
    """
    rows, cols = first, many - first
    _, g = np.unique(gram, return_inverse=True)
    left = doc < first
    (ga, da), (gb, db) = ((x[o], y[o]) for x, y, o in ((g[k], doc[k] - shift, np.argsort(g[k], kind="stable")) for k, shift in ((left, 0), (~left, first))))
    top = int(g.max()) + 1 if len(g) else 0
    fa, fb = np.bincount(ga, minlength=top), np.bincount(gb, minlength=top)
    at = np.cumsum(fb) - fb
    often = fa * fb > max(16, rows * cols // 64)
    out = np.zeros(rows * cols, np.float32)
    # pair by pair
    few = np.flatnonzero(~often[ga])
    ends = np.cumsum(fb[ga[few]])
    k = 0
    while k < len(few):
        end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + AT_ONCE, "right")))
        some = few[k:end]
        each = fb[ga[some]]
        i = np.repeat(da[some], each)
        j = db[np.repeat(at[ga[some]], each) + util.ranges(each)]
        out += np.bincount(i * cols + j, minlength=rows * cols)
        k = end
    out = out.reshape(rows, cols)
    place = np.cumsum(often) - 1
    for k in range(0, int(often.sum()), 512):
        a, b = (often[x] & (place[x] >= k) & (place[x] < k + 512) for x in (ga, gb))
        x, y = np.zeros((rows, 512), np.float32), np.zeros((cols, 512), np.float32)
        x[da[a], place[ga[a]] - k] = 1
        y[db[b], place[gb[b]] - k] = 1
        out += x @ y.T
    return out


def _count_links(batches, threshold: float):
    """By pair of pieces: (sig, rows of other sets that are near)."""
    for rows in util.runs_of(batches, "key"):
        rows = rows.sort_by([("right", "ascending"), ("sig", "ascending")])
        sig, size, uses = (rows.column(c).to_numpy().astype(np.int64) for c in ("sig", "size", "uses"))
        right = rows.column("right").to_numpy(zero_copy_only=False)
        one = not right.any()  # a piece with itself
        if one and len(sig) < 2 or right.all():
            continue
        sets = [np.frombuffer(g.as_buffer(), np.uint64) for c in rows.column("gram").chunks for g in c]
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        gram, first = np.concatenate(sets), len(sig) if one else int((~right).sum())
        if one:
            gram, doc, size = np.tile(gram, 2), np.concatenate([doc, doc + first]), np.tile(size, 2)
        shared = overlaps(gram, doc, first, len(size))
        near = np.zeros(shared.shape, np.bool_)
        for k in range(0, first, 256):
            near[k : k + 256] = shared[k : k + 256] >= np.maximum(1, least_overlap(size[k : min(first, k + 256), None], size[None, first:], threshold))
        if one:
            np.fill_diagonal(near, False)
            links = near @ uses.astype(np.float64)
        else:
            links = np.concatenate([near @ uses[first:].astype(np.float64), near.T @ uses[:first].astype(np.float64)])
        yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(links.astype(np.int64))], ["sig", "links"])


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, links) for each row of docs: the smallest identifier that chains of near pairs link it to, and how many other rows are near to it.

    Near is as in join, rows are told apart by identifier and text, and a row
    repeated whole counts once but is there as often as it was. Copies count
    as links, two texts of an identifier as well. A row that matches nothing (null
    and wordless texts too) is its own class and has no links, and one without
    identifier no class. An empty table gives no rows.

    All pairs of a class are compared, but none is listed: it is cut into
    pieces, each two of which are a task's matrices.
    """
    parts = util.parts(docs.sparkSession)
    sets, whole = _classes(docs, n, threshold, id_col, text_col)
    whole = util.spool(whole, "classes")
    may = sets.where("gram IS NOT NULL").select("sig", "size", F.size("ids").alias("uses"), "gram")
    long = may.select("sig", (F.length("gram") / 8).alias("long")).join(whole, "sig")
    pieces = long.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / PIECE_SETS, F.sum("long") / PIECE_GRAMS)).cast("int").alias("pieces"))
    members = may.join(whole.join(pieces, "root"), "sig").withColumn("piece", F.pmod(F.xxhash64(F.lit("piece"), "sig"), F.col("pieces")).cast("int"))
    sent = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    sent = sent.select("sig", "size", "uses", "gram", F.xxhash64("root", F.least("piece", "other"), F.greatest("piece", "other")).alias("key"), (F.col("piece") > F.col("other")).alias("right"))
    counted = sent.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(util.frugal(lambda b: _count_links(b, threshold)), "sig bigint, links bigint")
    links = counted.groupBy("sig").agg(F.sum("links").alias("links"))
    rows = sets.select("sig", "ids", "marks").join(whole, "sig", "left").where("root IS NOT NULL OR size(ids) > 1").join(links, "sig", "left")
    rows = rows.select(F.coalesce("root", "sig").alias("root"), (F.coalesce("links", F.lit(0)) + F.size("ids") - 1).alias("links"), F.explode(F.arrays_zip("ids", "marks")).alias("r"))
    rows = util.spool(rows.select("root", "links", F.col("r.ids").alias("__id"), F.col("r.marks").alias("__mark")), "links")
    rows = rows.join(rows.groupBy("root").agg(F.min("__id").alias("least")), "root")
    all_rows = docs.select(F.col(id_col).cast("long").alias("__id"), _mark(F.col(text_col)).alias("__mark"))
    return all_rows.join(rows, ["__id", "__mark"], "left").select(F.col("__id").alias("doc_id"), F.coalesce("least", "__id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def representatives(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group that chains of near pairs link, the row of the smallest identifier; all columns of docs stay.

    Rows are told apart by identifier and text: where an identifier has several
    texts, only the text that is in the group goes, and of two texts of the
    smallest identifier one stays. Rows that match nothing (see join: null
    texts, texts without words, null identifiers) are kept, and so are all
    repetitions of a row that stays. A very long text is like others; an empty table stays empty.
    """
    rows = util.spool(groups(docs, n, threshold, id_col, text_col), "groups")
    keep = rows.groupBy("root").agg(F.min(F.struct("id", "mark")).alias("keep"))
    drop = rows.join(keep, "root").where("struct(id, mark) <> keep").select(F.col("id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    both = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__mark", _mark(F.col(text_col)))
    return util.without(both, util.spool(drop, "near"), ["__id", "__mark"]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(util.table(spark, sf_dir, "documents"))


#: All pairs, as of join.
SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '(?:[a-z0-9_]|[^\\x00-\\x7f])+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {N} THEN list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' '))
       ELSE [array_to_string(w, ' ')] END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT doc_a, doc_b, o / (x.n + y.n - o) AS jaccard FROM o JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b
WHERE o / (x.n + y.n - o) >= {THRESHOLD}
"""

#: As of classes: what each document is linked to, from those on that have no smaller neighbour.
CLASSES_SQL = f"""
WITH RECURSIVE pairs AS MATERIALIZED ({SQL}),
both_ways AS MATERIALIZED (SELECT doc_a AS a, doc_b AS b FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents WHERE doc_id NOT IN (SELECT doc_b FROM pairs)
  UNION SELECT b, root FROM reach JOIN both_ways ON a = node),
roots AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS links FROM both_ways GROUP BY a)
SELECT doc_id, class_id, coalesce(links, 0) AS links FROM documents LEFT JOIN roots ON node = doc_id LEFT JOIN counts ON a = doc_id
"""
