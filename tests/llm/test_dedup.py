import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import exact_dedup, ngram_join, suffix_dedup, text

from .tables import corpus, frame, rows_of, words


@pytest.mark.parametrize("clash", [False, True])
def test_exact(spark, clash):
    rows = corpus()
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    want = sorted(((r[0], least.get(r[1])) for r in rows), key=repr)
    df = frame(spark, rows, clash)
    assert rows_of(exact_dedup.canonical(df)) == want
    kept = exact_dedup.survivors(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert got == sorted({*least.values()} | {None}, key=repr)


def test_exact_empty(spark):
    df = frame(spark, [])
    assert exact_dedup.canonical(df).count() == exact_dedup.survivors(df).count() == 0


def test_an_identifier_with_two_texts_keeps_the_one_of_its_own(spark):
    rows = [(1, "a", "en", "s", 1), (2, "a", "en", "s", 1), (2, "b", "en", "s", 1), (2, "b", "de", "s", 1), (3, "b", "en", "s", 1), (4, None, "en", "s", 1), (5, None, "en", "s", 1), (5, "", "en", "s", 1), (None, "a", "en", "s", 1)]
    for clash in (False, True):
        kept = exact_dedup.survivors(frame(spark, rows, clash))
        assert kept.columns == frame(spark, rows, clash).columns
        assert rows_of(kept.select("doc_id", "text")) == sorted([(1, "a"), (2, "b"), (4, None), (5, ""), (None, "a")], key=repr)


def entries(rows):
    e = np.zeros(len(rows), exact_dedup.ENTRY)
    for k, (a, b, i) in enumerate(rows):
        e[k] = (a, b, 1, exact_dedup.NO_ID if i is None else i)
    return e


def test_index_over_many_flushes():
    rng = random.Random(1)
    index, want = exact_dedup.Index(memtable=16 * 32), {}
    data = [(rng.randrange(-40, 40), rng.randrange(8), rng.choice([None, rng.randrange(5000)])) for _ in range(3000)]
    for at in range(0, len(data), 100):
        index.add(entries(data[at : at + 100]))
        for a, b, i in data[at : at + 100]:
            n, least = want.get((a, b), (0, exact_dedup.NO_ID))
            want[a, b] = (n + 1, least if i is None else min(least, i))
        probes = [(rng.randrange(-60, 60), rng.randrange(9)) for _ in range(50)]
        assert index.rows(*(np.array(x) for x in zip(*probes, strict=True))).tolist() == [want.get(p, (0, 0))[0] for p in probes]
    assert index.flushes == 3000 // 16 and index.compactions > 50 and len(index.levels) > 3
    run = index.whole()
    assert [(e["a"], e["b"]) for e in run] == sorted(want)
    assert {(int(e["a"]), int(e["b"])): (int(e["n"]), int(e["least"])) for e in run} == want


def test_a_task_of_usual_size_flushes_and_compacts():
    rng = np.random.default_rng(2)
    index = exact_dedup.Index()
    e = np.zeros(8000, exact_dedup.ENTRY)
    e["a"], e["b"], e["n"], e["least"] = rng.integers(-(2**62), 2**62, 8000), rng.integers(0, 9, 8000), 1, np.arange(8000)
    for at in range(0, 8000, 1000):
        index.add(e[at : at + 1000])
    assert index.flushes == 3 and len(index.whole()) == 8000 and index.flushes == 4 and index.compactions == 1
    merged = exact_dedup.Index()
    for at in range(0, 8000, 250):  # a run from each of 32 tasks
        assert not len(merged.insert(exact_dedup.compacted(e[at : at + 250])))
    assert len(merged.insert(exact_dedup.compacted(e[7:300]))) == 293
    assert merged.compactions == 10 and len(merged.whole()) == 8000


def test_hits_are_verified_by_their_bytes():
    import pyarrow as pa

    no = exact_dedup.NO_ID
    rows = [(1, 1, 3, [3], b"b"), (1, 1, 4, [9, 4], b"a"), (1, 1, 5, [5, None], b"a"), (1, 2, 7, [7], b"a"), (2, 2, 8, [8], b""), (2, 2, no, [None], None), (2, 2, no, [None], None)]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a:b], strict=True), kinds, strict=True)], ["a", "b", "least", "ids", "text"]) for a, b in ((0, 2), (2, 7))]
    got = [(r["doc_id"], r["keep_id"]) for b in exact_dedup._verified(iter(batches)) for r in b.to_pylist()]
    assert got == [(3, 3), (9, 4), (4, 4), (5, 4), (None, 4), (7, 7), (8, 8), (None, None), (None, None)]


@pytest.mark.parametrize("size", [32 << 20, 0])
def test_only_rows_that_may_go_are_joined(spark, monkeypatch, size):
    from lodestar.llm import util

    monkeypatch.setattr(util, "BROADCAST_BYTES", size)
    df = frame(spark, corpus(), True)
    kept = {r.doc_id for r in exact_dedup.survivors(df).collect()}
    least = {}
    for i, t, *_ in corpus():
        if i is not None:
            least[t] = min(least.get(t, i), i)
    assert kept == {*least.values()} | {None}
    drop = spark.range(40).select("id", F.col("id").alias("doc_id"))
    out = util.without(df, drop, ["doc_id"])
    assert rows_of(out) == rows_of(df.where("doc_id IS NULL OR doc_id >= 40")) and out.columns == df.columns


def test_filter_has_a_bounded_size(spark, monkeypatch):
    from lodestar.llm import util

    monkeypatch.setattr(util, "MOST_BITS", 1 << 16)
    df, keys = spark.range(200_000), spark.range(0, 200_000, 3)
    got = util.marked(df, keys, ["id"], "flag")
    assert got.where("id % 3 = 0 AND NOT flag").count() == 0 and got.where("NOT flag").count() > 10_000


def grams(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_pairs(rows, n, threshold):
    sets = {(i, t): grams(t, n) for i, t, *_ in rows if i is not None}
    items = sorted(sets.items(), key=lambda x: (x[0][0], x[0][1] or ""))
    out = []
    for k, ((a, _), x) in enumerate(items):
        for (b, _), y in items[k + 1 :]:
            if a != b and x and y and len(x & y) / len(x | y) >= threshold - 1e-12:
                out.append((a, b, len(x & y) / len(x | y)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "threshold", "clash"), [(5, 0.35, True), (3, 0.6, False), (1, 0.1, False)])
def test_near(spark, n, threshold, clash):
    rows = corpus()
    df = frame(spark, rows, clash)
    want = near_pairs(rows, n, threshold)
    assert rows_of(ngram_join.join(df, n, threshold)) == want
    kept = ngram_join.representatives(df, n, threshold)
    assert kept.columns == df.columns
    assert rows_of(kept.select("doc_id", "text")) == near_kept(rows, n, threshold)


def near_kept(rows, n, threshold):
    """The rows that stay, by comparing all pairs of (identifier, text)."""
    sets = {(i, t): grams(t, n) for i, t, *_ in rows if i is not None}
    items = list(sets)
    parent = {r: r for r in items}

    def top(r):
        while parent[r] != r:
            r = parent[r]
        return r

    for k, x in enumerate(items):
        for y in items[k + 1 :]:
            if sets[x] and sets[y] and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= threshold - 1e-12:
                parent[top(y)] = top(x)
    members = defaultdict(list)
    for r in items:
        members[top(r)].append(r)
    stay = {min(m, key=lambda r: r[0]) for m in members.values()}
    return sorted([(i, t) for i, t, *_ in rows if i is None or (i, t) in stay], key=repr)


def test_near_by_identifier_and_text(spark):
    x, y, z = "a b c d e f g h", "m n o p q r s t", "u v w x y z aa bb"
    rows = [(i, t, "en", "s", 1) for i, t in ((1, x), (2, x), (2, y), (3, z), (3, z), (4, y + " more"), (5, None), (2, None))]
    kept = ngram_join.representatives(frame(spark, rows, True))
    assert rows_of(kept.select("doc_id", "text")) == sorted([(1, x), (2, y), (3, z), (3, z), (5, None), (2, None)], key=repr) == near_kept(rows, 5, 0.35)


def test_near_groups_at_random(spark):
    rng = random.Random(17)
    for seed in range(3):
        base = [[f"w{rng.randrange(60)}" for _ in range(40)] for _ in range(6)]
        rows = []
        for i in range(150):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 3, 8, 20])):
                w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
            rows.append((rng.randrange(120), " ".join(w[: rng.choice([40, 40, 25, 60])]), "en", "s", i))
        rows = list({r[:2]: r for r in rows}.values())
        got = {(r.doc_id, r.text) for r in ngram_join.representatives(frame(spark, rows), 3, 0.5).collect()}
        want = {*near_kept(rows, 3, 0.5)}
        # of two texts of the smallest identifier in a group either may stay
        assert {i for i, _ in got} == {i for i, _ in want} and len(got) == len(want)


def test_common_ngrams_are_counted_where_they_are(spark, monkeypatch):
    rows = [(i, "this phrase is in every one of them " + f"a{i} b{i} c{i // 2} d{i // 2} e{i // 2} f{i // 2} g{i // 2} h{i // 2} i{i // 2}", "en", "s", i) for i in range(300)]
    rows += [(1000 + i, rows[i][1], "en", "s", i + 300) for i in range(0, 40, 7)]
    df = frame(spark, rows, parts=6)
    assert rows_of(ngram_join.join(df, 3, 0.5)) == near_pairs(rows, 3, 0.5)
    with_hot = ngram_join._hot(np.repeat(np.arange(5, dtype=np.uint64), [3, 15, 16, 17, 200]))
    assert with_hot.sum() == 233


def test_a_cluster_costs_what_it_has_members():
    rng = np.random.default_rng(4)
    pairs = []
    for n in (2_000, 20_000):
        # near copies: each lacks a few of 60 n-grams that all might have
        has = rng.random((n, 60)) < 0.95
        doc, gram = np.nonzero(has)
        size = has.sum(1)
        pos = np.cumsum(has, 1)[doc, gram] - 1
        a, b = ngram_join.pivots(gram.astype(np.uint64), doc, np.minimum(pos, 20), size, 0.5)
        pairs.append(len(a))
        joined = np.arange(n)
        for _ in range(8):
            np.minimum.at(joined, a, joined[b])
            np.minimum.at(joined, b, joined[a])
        assert (joined == 0).all()
        x, _ = ngram_join.across(gram.astype(np.uint64), doc, pos, size, np.zeros(n, np.int64), 0.5)
        assert not len(x)
    assert pairs[0] < 2_000 * 20 and pairs[1] < 20 * pairs[0]  # all pairs were a hundred times as many


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(0, 3)), min_size=1, max_size=25), st.sampled_from([1, 7, 4_000_000]))
def test_pairs_across_labels(spec, most):
    sets = [range(a, a + b + 1) for a, b, _ in spec]
    gram, doc, pos = (np.array(c) for c in zip(*[(g, d, g - s[0]) for d, s in enumerate(sets) for g in s], strict=True))
    size, label = np.array([len(s) for s in sets]), np.array([c for *_, c in spec])
    a, b = ngram_join.candidates(gram.astype(np.uint64), doc, pos, size, 0.4)
    want = {(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if label[x] != label[y]}
    a, b = ngram_join.across(gram.astype(np.uint64), doc, pos, size, label, 0.4, most)
    assert {*zip(a.tolist(), b.tolist(), strict=True)} == want


def near_classes(rows, n, threshold):
    """(identifier, class, links) of each row, by comparing all pairs of (identifier, text)."""
    sets = {(i, t): grams(t, n) for i, t, *_ in rows if i is not None}
    items = list(sets)
    pairs = [(x, y) for x in items for y in items if x != y and sets[x] and sets[y] and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= threshold - 1e-12]
    least, links = {r: r[0] for r in items}, defaultdict(int)
    for x, _ in pairs:
        links[x] += 1
    for _ in range(len(items)):
        before = dict(least)
        for x, y in pairs:
            least[x] = min(least[x], least[y])
        if before == least:
            break
    return sorted(((r[0], least.get(r[:2]), links.get(r[:2], 0)) for r in rows), key=repr)


@pytest.mark.parametrize(("n", "threshold", "clash", "piece"), [(5, 0.35, True, 2048), (3, 0.6, False, 2), (1, 0.1, False, 5)])
def test_classes_and_links(spark, monkeypatch, n, threshold, clash, piece):
    monkeypatch.setattr(ngram_join, "PIECE_SETS", piece)
    x = "a b c d e f g h"
    rows = [*corpus(), *[(i, t, "en", "s", i) for i, t in ((500, x), (501, x), (501, x + " i"), (501, x + " i"), (502, x.upper()), (502, x))]]
    got = ngram_join.classes(frame(spark, rows, clash), n, threshold)
    assert got.columns == ["doc_id", "class_id", "links"] and rows_of(got) == near_classes(rows, n, threshold)


def test_no_more_rows_than_documents(spark, tmp_path):
    frame(spark, [(i, "one text that very many documents have", "en", "s", i) for i in range(300)]).write.parquet(str(tmp_path / "documents.parquet"))
    assert rows_of(ngram_join.query(spark, str(tmp_path))) == sorted(((i, 0, 299) for i in range(300)), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=12), min_size=2, max_size=30), st.integers(1, 29), st.sampled_from([3, 1 << 21]))
def test_overlaps(sets, first, at_once):
    first = min(first, len(sets) - 1)
    gram, doc = (np.array(c) for c in zip(*[(g, d) for d, s in enumerate(sets) for g in s], strict=True))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ngram_join, "AT_ONCE", at_once)
        got = ngram_join.overlaps(gram.astype(np.uint64), doc, first, len(sets))
    assert got.tolist() == [[len(a & b) for b in sets[first:]] for a in sets[:first]]


def test_near_empty(spark):
    assert ngram_join.classes(frame(spark, [])).count() == 0
    assert ngram_join.join(frame(spark, [])).count() == 0
    assert ngram_join.representatives(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=12), min_size=2, max_size=12), st.sampled_from([0.2, 0.5, 0.8]))
def test_trie(sets, threshold):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    freq = [np.array([sum(int(g) in s for s in sets) for g in a]) for a in arrays]
    size = np.array([len(s) for s in sets])
    got = ngram_join.trie_join(arrays, freq, size, np.ones(len(sets), bool), np.arange(len(sets)), threshold)
    want = [(i, j, len(a & b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) / len(a | b) >= threshold - 1e-12]
    assert sorted(got) == want


def test_distinct_takes_as_long_as_a_sort():
    import time

    def seconds(f):
        t = time.process_time()
        f()
        return time.process_time() - t

    rng = np.random.default_rng(7)
    for n, top in ((0, 9), (1, 9), (1000, 50)):
        some = rng.integers(0, top, n).astype(np.uint64)
        assert ngram_join.util.distinct(some).tolist() == sorted({*some.tolist()})
    # keys as _count has them: n-gram and document
    key = (rng.integers(0, 1 << 40, 1_000_000).astype(np.uint64) << np.uint64(24)) | np.arange(1_000_000, dtype=np.uint64)
    assert min(seconds(lambda: ngram_join.util.distinct(key)) for _ in range(3)) < 8 * min(seconds(lambda: np.sort(key)) for _ in range(3))


def joined(n, pairs):
    label = list(range(n))
    for x, y in pairs:
        a, b = label[x], label[y]
        label = [a if k == b else k for k in label]
    return {frozenset(i for i in range(n) if label[i] == k) for k in label}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 15), min_size=1, max_size=9), st.booleans(), st.integers(0, 2)), min_size=2, max_size=14), st.sampled_from([0.2, 0.5, 0.8]), st.sampled_from([4, 1 << 21]))
def test_forest_connects_what_pairs_connect(spec, threshold, at_once):
    sets = [np.array(sorted(s), np.uint64) for s, *_ in spec]
    mine = np.array([m for _, m, _ in spec])
    size = np.array([len(s) + own for s, _, own in spec])  # some n-grams are a set's own
    want = [(x, y) for x, y, _ in ngram_join.trie_join(sets, [np.ones(len(s), int) for s in sets], size, mine, np.arange(len(sets)), threshold)]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ngram_join, "AT_ONCE", at_once)
        got = ngram_join.forest(sets, size, mine, np.arange(len(sets)), threshold)
    assert joined(len(sets), got) == joined(len(sets), want)
    assert len(got) == len(sets) - len(joined(len(sets), want)) and {*got} <= {*want}


def test_a_home_of_near_copies_is_gone_through_once(monkeypatch):
    rng = np.random.default_rng(6)
    seen = []
    ranges = ngram_join.util.ranges
    monkeypatch.setattr(ngram_join.util, "ranges", lambda n: seen.append(int(n.sum())) or ranges(n))
    sets = [np.flatnonzero(rng.random(400) < 0.9).astype(np.uint64) for _ in range(600)]
    size = np.array([len(s) for s in sets])
    tree = ngram_join.forest(sets, size, np.ones(600, bool), np.arange(600), 0.35)
    assert len(tree) == 599 and sum(seen) <= size.sum()  # all pairs are 300 times as much


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=30))
def test_candidates_have_all_pairs(spec):
    threshold = 0.4
    sets = [set(range(a, a + b + 1)) for a, b in spec]
    df = defaultdict(int)
    for s in sets:
        for g in s:
            df[g] += 1
    gram, doc, pos = [], [], []
    for d, s in enumerate(sets):
        for p, g in enumerate(sorted(s, key=lambda g: (df[g], g))[: int(ngram_join.prefix_length(len(s), threshold))]):
            gram.append(g)
            doc.append(d)
            pos.append(p)
    a, b = ngram_join.candidates(np.array(gram, np.uint64), np.array(doc), np.array(pos), np.array([len(s) for s in sets]), threshold)
    found = {*zip(a.tolist(), b.tolist(), strict=True)}
    assert {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and len(x & y) / len(x | y) >= threshold} <= found


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 101), (7, 7)]
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 105: 100}


def spans(rows, least):
    once, windows = {}, defaultdict(list)
    for i, t, *_ in rows:
        if t is not None:
            once[i, t] = words(t)
    for (i, t), w in once.items():
        for s in range(len(w) - least + 1):
            windows[tuple(w[s : s + least])].append((float("inf") if i is None else i, s, i, t))
    marks = defaultdict(set)
    for places in windows.values():
        if len(places) > 1:
            for k, (_, s, i, t) in enumerate(sorted(places, key=lambda p: p[:2])):
                marks[i, t, k > 0].add(s)
    out = []
    for (i, _, copy), starts in marks.items():
        run = None
        for s in sorted(starts):
            if run and s <= run[1] + least:
                run[1] = s
            else:
                if run:
                    out.append((i, run[0], run[1] + least, copy))
                run = [s, s]
        out.append((i, run[0], run[1] + least, copy))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "k", "clash"), [(50, 8, True), (20, 5, False), (9, 8, False), (300, 20, False), (4, 4, False)])
def test_suffixes(spark, least, k, clash):
    rows = corpus()
    got = rows_of(suffix_dedup.repeated_spans(frame(spark, rows, clash), least, k))
    assert got == spans(rows, least)


def test_suffixes_of_a_wide_window(spark):
    rng = random.Random(5)
    own, shared = (lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))), " ".join(f"s{k}" for k in range(900))
    rows = [(1, f"{own(30)} {shared} {own(40)}", "en", "s", 0), (2, f"{own(30)} {shared} {own(20)}", "en", "s", 0)]
    assert rows_of(suffix_dedup.repeated_spans(frame(spark, rows), 300, 20)) == spans(rows, 300) == [(1, 30, 930, False), (2, 30, 930, True)]
    for least, k in ((5, 6), (5, 0)):
        with pytest.raises(ValueError):
            suffix_dedup.repeated_spans(frame(spark, rows), least, k)


def test_suffixes_empty(spark):
    assert suffix_dedup.repeated_spans(frame(spark, [])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.text("ab ", max_size=12).map(str.encode), max_size=8), min_size=1, max_size=6))
def test_merge(runs):
    runs = [sorted(r) for r in runs]
    coded = [suffix_dedup.front_code(r) for r in runs]
    assert [suffix_dedup.front_decode(*c) for c in coded] == runs
    order, lcp = suffix_dedup.merge(runs, [c[0].tolist() for c in coded])
    got = [runs[r][i] for r, i in order]
    assert got == sorted(t for r in runs for t in r)
    assert lcp == [suffix_dedup.common(a, b) for a, b in zip([b"", *got], got)]  # noqa: B905


def test_anchors_meet_every_window():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 50, 400).astype(np.uint64)
    row = np.sort(rng.integers(0, 6, 400))
    for w in (1, 2, 3, 7, 43):
        want = set()
        for s in range(len(h) - w + 1):
            if row[s] == row[s + w - 1]:
                want |= {s + i for i in range(w) if h[s + i] == h[s : s + w].min()}
        assert suffix_dedup.anchors(h, row, w).tolist() == sorted(want)


def test_words_agree_with_the_pattern():
    import pyarrow as pa

    texts = ["Ab c_d éÉ-x", "", None, "a", "--", "漢字 x1"]
    w = text.Words(pa.array(texts))
    raw = w.data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in words(t)]
