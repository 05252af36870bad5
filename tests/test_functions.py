import hashlib
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import misc
from lodestar.functions import text as T
from lodestar.functions import vector as V


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


def model_chunk(text, limit):
    def pack(parts, joint):
        out, buf = [], ""
        for p in parts:
            if not buf:
                buf = p
            elif len(buf) + len(joint) + len(p) <= limit:
                buf += joint + p
            else:
                out.append(buf)
                buf = p
        return out + [buf] if buf else out

    def sentences(p):
        pieces = [s.strip() for s in re.split(r"(?<=\.)(?=[ \n]|$)", p)]
        cut = []
        for s in filter(None, pieces):
            cut += [s[i : i + limit] for i in range(0, len(s), limit)] if len(s) > limit else [s]
        return pack(cut, " ")

    segments = []
    for p in filter(None, (p.strip() for p in text.split("\n\n"))):
        segments += sentences(p) if len(p) > limit else [p]
    return pack(segments, "\n\n")


def test_chunker(spark):
    rng = random.Random(1)
    texts = ["", "   \n\n  ", "short", "a" * 95, "one. two. three.\n\nfour", "x" * 20 + "." + "y" * 70 + ". z."]
    texts += ["\n\n".join(" ".join(rng.choice(["alpha", "be.", "c.\n", "delta-long-word"]) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.chunk(F.col("t"), 40).alias("c"))
    for r in df.collect():
        assert r.c == model_chunk(texts[r.i], 40)
        assert all(len(c) <= 40 for c in r.c)


@pytest.mark.parametrize(("t", "want"), [("hello world", "hello world"), ("vector search", "search vector"), ("the cat sat on the mat", "cat mat sat"), ("", "")])
def test_content_id(spark, t, want):
    from lodestar.operators.ingest import content_ids

    r = content_ids(spark.createDataFrame([(1, t)], "doc_id int, text string")).first()
    assert r.signature == want
    assert r.content_id == "".join(f"{b:02d}" for b in hashlib.sha256(want.encode()).digest())


def test_same_top_words_are_the_same_document(spark):
    from lodestar.operators.ingest import content_ids

    rows = content_ids(spark.createDataFrame([(1, "alpha beta, alpha!"), (2, "Beta alpha alpha")], "doc_id int, text string")).collect()
    assert rows[0].content_id == rows[1].content_id


def test_tags(spark):
    from lodestar.operators.ingest import tags

    got = tags(spark.createDataFrame([(1, "alpha alpha alpha beta-gamma the with abc beta")], "doc_id int, text string")).orderBy("rank").collect()
    assert [(r.word, r.n) for r in got] == [("alpha", 3), ("beta", 2), ("gamma", 1)]


def test_vector_digest(spark):
    x = [1.0, -2.5, 0.25]
    want = "".join(f"{b:02d}" for b in hashlib.sha256(struct.pack("<3f", *x) + b"doc").digest())
    df = spark.createDataFrame([(x, "doc"), (x, "other"), (None, "doc")], "v array<float>, d string")
    got = [r.x for r in df.select(V.vector_digest()(F.col("v"), F.col("d")).alias("x")).collect()]
    assert got[0] == want and got[1] != want and got[2] is None


def test_distances(spark):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((2, 8)).astype(np.float32).tolist()
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    r = df.select(V.squared_l2(F.col("a"), F.col("b")).alias("d"), V.squared_l2(F.col("a"), F.slice("b", 1, 5)).alias("short"), V.dot(F.col("a"), F.col("b")).alias("dot"), V.tag_distance(F.col("a"), F.slice("b", 1, 5)).alias("none")).first()
    x, y = np.array(a), np.array(b)
    assert abs(r.d - ((x - y) ** 2).sum()) < 1e-9 and abs(r.short - ((x - y)[:5] ** 2).sum()) < 1e-9 and abs(r.dot - x @ y) < 1e-9 and r.none is None


@pytest.mark.parametrize(("n", "k"), [(1, 2), (77, 2), (78, 2), (155, 2), (156, 4), (100_000, 2048), (10**9, 65536)])
def test_codebook_size(spark, n, k):
    assert one(spark, V.codebook_size(F.lit(n))) == k


def test_sanitize(spark):
    t = "ﬁne ­soft　wide\x07 hyphen-\nated\r\n\t tabs  \n\n\n\n\n\nlast  one \t"
    assert one(spark, T.sanitize(F.lit(t))) == "fine soft wide hyphenated\ntabs\n\n\nlast one"


def test_html(spark):
    page = "<html><head><title>no</title></head><body><script>x<y</script><p>A &amp; B &#65;&#x42;</p><div>C&nbsp;D &copy; &#xD800;</div></body></html>"
    assert one(spark, T.html_text(F.lit(page))) == "A & B AB\n\nC D © &#xD800;"
    assert one(spark, T.html_text(F.lit("<p></p>"))) == "<p></p>"


def test_requests(spark):
    r = one(spark, misc.parse_request(F.lit('{"owner_id": "AbC", "groups": [{"id": "g"}]}')))
    assert (r.owner_id, r.scope, r.aggregate, r.tags, r.groups[0].id) == ("abc", "personal", False, [], "g")
    assert one(spark, misc.parse_inputs(F.lit('"one"'))) == ["one"] and one(spark, misc.parse_inputs(F.lit('["a","b"]'))) == ["a", "b"]
    assert one(spark, misc.parse_vector(F.lit("[1, 2.5]"))) == [1.0, 2.5] and one(spark, misc.parse_vector(F.lit('"AAA="'))) is None
    assert one(spark, misc.event_line(F.struct(F.lit(1).alias("a")))) == 'data: {"a":1}\n\n'


def test_maps(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 5, "c": 7})], "x map<string,int>, y map<string,int>")
    r = df.select(misc.merge_first(F.col("x"), F.col("y")).alias("first"), misc.merge_sum(F.col("x"), F.col("y")).alias("sum")).first()
    assert r["first"] == {"a": 1, "b": 2, "c": 7} and r["sum"] == {"a": 1, "b": 7, "c": 7}


def test_kernels_are_the_columns_they_stand_for(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    texts = []

    @settings(max_examples=400, deadline=None)
    @given(st.text(st.sampled_from(list("abcDÉß.-_,!'´ \t\n\r\x0b\u2028\u00a0\u00ad\u3000ﬁÆœİΣ漢\U0001f600\x01the ")), max_size=60))
    def collect(t):
        texts.append(t)

    collect()
    texts += ["", "wave-\nlength a-\nb-\nc", "of the of a", "x" * 50 + ". y.\n\n\n\n\nz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string").repartition(2)
    t = F.col("t")
    steps = T.trim(T.lines(T.dehyphenate(T.controls(T.plain_spaces(T.soft_hyphens(T.ligatures(t)))))))
    words = F.transform(T.top_words(T.signature_words(F.coalesce(t, F.lit("")))), lambda r: r["word"])
    rows = df.select("t", T.sanitize(t).alias("a"), steps.alias("b"), T.top_tags(t).alias("c"), T.top_words(T.tag_words(t)).alias("d"), T.signature(t).alias("e"), F.array_join(F.array_sort(words), " ").alias("f")).collect()
    for r in rows:
        assert r.a == r.b and r.e == r.f and (r.c == r.d or r.t is None), repr(r.t)


def test_json_of_requests(spark):
    from lodestar.functions import misc

    one_row = spark.range(1)
    vec = lambda s: one_row.select(misc.parse_vector(F.lit(s)).alias("v")).first().v
    assert vec("[1, 2.5]") == [1.0, 2.5] and vec('"AACAPwAAAEA="') == [1.0, 2.0] and vec('"?"') is None and vec('"AAA="') is None and vec("3") is None
    body = one_row.select(misc.request_body({"b": F.lit(1), "a": F.lit("x"), "c": F.lit(None).cast("string")}).alias("v")).first().v
    assert body == '{"a":"x","b":1}'
    assert one_row.select(misc.query_items({"b": F.lit("x y&z"), "a": F.lit(2)}).alias("v")).first().v == "a=2&b=x%20y%26z"
    assert misc.snake("partitionId") == "partition_id"


@pytest.mark.parametrize("name", ["_signature", "_top_tags", "_sanitize"])
def test_texts_of_a_batch_are_not_all_python_strings_at_once(name):
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([None, ""] + [f"word{i} other " * 2000 for i in range(1000)])
    f = getattr(T, name).func
    few = [f(texts.slice(i, 1)).to_pylist()[0] for i in (0, 1, 2, 700)]
    tracemalloc.start()
    try:
        got = f(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == len(texts) and [got[i].as_py() for i in (0, 1, 2, 700)] == few
    assert len(f(texts.slice(0, 0))) == 0
    assert peak < texts.nbytes / 4
