"""From raw inputs to indexed partitions: clean, chunk, identify, gate, tag, embed, put."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from lodestar.functions import text as T

DIM = 64
TOKENS = 512
#: Rows that embed() puts out at a time.
ROWS_OUT = 1024


def tags(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rank, word, n): the tags of each text, most frequent first; one projection of the scan."""
    top = docs.select(key, F.posexplode(T.top_tags(F.col(text))).alias("pos", "t"))
    return top.select(key, (F.col("pos") + 1).alias("rank"), "t.word", "t.n")


def content_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, signature, content_id): identity by the ten most frequent words, so texts with the same ones are the same document."""
    return docs.select(key, T.signature(F.col(text)).alias("signature")).withColumn("content_id", T.let(F.col("signature"), T.numeric_hash))


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", clean: bool = True, limit: int = T.MAX_CHARS) -> DataFrame:
    """(key, pos, chunk): without cleaning a text is one chunk, however long."""
    # an inner one is filtered by the size of the list before, for which every text is cut twice
    return docs.select(key, F.posexplode_outer(_parts(text, limit, clean)).alias("pos", "chunk")).where("chunk <> ''")


def _parts(text: str, limit: int = T.MAX_CHARS, clean: bool = True) -> Column:
    return T.chunk(F.col(text), limit, clean=True) if clean else F.array(F.col(text))


def gate(inputs: DataFrame, indexed: DataFrame, links: DataFrame) -> DataFrame:
    """inputs (content_id, owner_id, group_id) with action: 'skip' what this owner has already, 'link' what is indexed for others, else 'index'.

    indexed: (content_id); links: (content_id, owner_id, group_id). A request without group needs the owner's link only.
    """
    known = indexed.select("content_id").distinct().withColumn("__known", F.lit(True))
    own = links.select("content_id", "owner_id").distinct().withColumn("__own", F.lit(True))
    both = links.select("content_id", "owner_id", "group_id").distinct().withColumn("__both", F.lit(True))
    x = inputs.join(known, "content_id", "left").join(own, ["content_id", "owner_id"], "left").join(both, ["content_id", "owner_id", "group_id"], "left")
    done = F.col("__own") & (F.col("group_id").isNull() | F.col("__both"))
    action = F.when(F.col("__known") & F.coalesce(done, F.lit(False)), "skip").when(F.col("__known"), "link").otherwise("index")
    return x.withColumn("action", action).drop("__known", "__own", "__both")


def outcome(gated: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(skipped, linked, prepared, failed, success); failed is one row with that count, of inputs that never came to the gate. Success is when all are accounted for."""
    n = lambda a: F.count_if(F.col("action") == a)
    out = gated.agg(n("skip").alias("skipped"), n("link").alias("linked"), n("index").alias("prepared"))
    out = out.crossJoin(failed) if failed is not None else out.withColumn("failed", F.lit(0).cast("bigint"))
    return out.withColumn("success", F.col("failed") == 0)


def hashed_embedding(texts: list[str], dim: int = DIM) -> np.ndarray:
    """A deterministic stand-in for a model: signed hashes of the first TOKENS words, of unit length. A model of this kind reads no more of an input; chunks are shorter."""
    import zlib

    class Slots(dict):
        def __missing__(self, word: str) -> int:
            h = zlib.crc32(word.encode())
            self[word] = slot = 2 * (h % dim) + (h >> 16 & 1)
            return slot

    slots = Slots()
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        words = (t or "").lower().split()[:TOKENS]
        if words:
            n = np.bincount([slots[w] for w in words], minlength=2 * dim)
            out[i] = n[1::2] - n[::2]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def embed(rows: DataFrame, column: str, embedder=hashed_embedding, batch: int = 256) -> DataFrame:
    """rows with an embedding of ``column``, which comes first; each distinct text is embedded once, in batches, by a model that a task makes once.

    Equal texts meet in one task, one behind the other: the rows are shuffled once
    and read once, and of a text that goes on in the next batch the vector is kept.
    """
    names = [column, *(c for c in rows.columns if c != column)]
    schema = StructType([StructField(c, rows.schema[c].dataType) for c in names] + [StructField("embedding", ArrayType(FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = vector = None
        for b in batches:
            texts = b.column(column).dictionary_encode()
            vectors = []
            for at in range(0, len(texts.dictionary), batch):
                some = texts.dictionary.slice(at, batch).to_pylist()
                new = [t for t in some if t != "" and t != last]
                got = iter(embedder(new) if new else ())
                for t in some:
                    if t != "":
                        vector = vector if t == last else np.asarray(next(got), np.float32)
                        last = t
                    vectors.append(vector if t != "" else None)
            vectors = pa.array(vectors, pa.list_(pa.float32()))
            for at in range(0, b.num_rows, ROWS_OUT):
                part = b.slice(at, ROWS_OUT)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), vectors.take(texts.indices.slice(at, ROWS_OUT))], [*names, "embedding"])

    return rows.repartition(column).sortWithinPartitions(column).mapInArrow(run, schema)


def prepared(docs: DataFrame, owner: str, embedder=hashed_embedding, clean: bool = True) -> DataFrame:
    """(document_id, pos, text, embedding, partition_id, owner_id) of (doc_id, text): one document each, one partition a chunk. A text is identified and cut in one pass."""
    from lodestar.functions.vector import vector_digest

    both = docs.where("doc_id IS NOT NULL").select(T.let(T.signature(F.col("text")), T.numeric_hash).alias("document_id"), _parts("text", clean=clean).alias("parts"))
    each = both.select("document_id", F.posexplode_outer("parts").alias("pos", "chunk"))
    rows = embed(each.where("chunk <> ''"), "chunk", embedder)
    rows = rows.where("size(embedding) > 0").dropDuplicates(["document_id", "pos"])
    return rows.select("document_id", "pos", F.col("chunk").alias("text"), "embedding", vector_digest()(F.col("embedding"), F.col("document_id")).alias("partition_id"), F.lit(owner.lower()).alias("owner_id"))


def put(index: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """Replace the documents of ``new`` in ``index``; rows without embedding aren't indexed."""
    new = new.where("size(embedding) > 0")
    return index.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def removed(index: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    return index.join(ids.select(key).distinct(), key, "left_anti")


def remove_partition(index: DataFrame, partition_id) -> DataFrame:
    """Removing a partition takes its whole document along."""
    return removed(index, index.where(F.col("partition_id") == partition_id))


def tag_union(rows: DataFrame, key: str, column: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias("tags"))


def usage(texts: Column) -> Column:
    """Words, as the count of tokens an embedder would report."""
    return F.sum(F.size(F.split(F.trim(texts), r"\s+")))


def http_embedder(url: str, key: str | None = None, model: str = "embed", send=None, timeout: float = 60):
    """An embedder that asks a service: POST {model, input} to url, answered by {data: [{index, embedding}]}, embeddings as numbers or base64 float32.

    To be given to embed(), which calls it with batches of 256 at most, once for
    each distinct text. ``send`` (url, body, headers) -> (status, body) takes the place of the network in tests.
    """
    import base64
    import json
    import urllib.request

    def post(url, body, headers):
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=timeout) as r:
            return r.status, r.read()

    def run(texts: list[str]) -> np.ndarray:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        status, raw = (send or post)(url, json.dumps({"model": model, "input": texts}).encode(), headers)
        if not 200 <= status < 300:
            raise RuntimeError(f"the embedding service answered {status}")
        rows = sorted(json.loads(raw)["data"], key=lambda r: r["index"])
        if [r["index"] for r in rows] != list(range(len(texts))):
            raise RuntimeError("the embedding service left some inputs out")
        return np.stack([np.frombuffer(base64.b64decode(r["embedding"]), "<f4") if isinstance(r["embedding"], str) else np.asarray(r["embedding"], np.float32) for r in rows])

    return run
