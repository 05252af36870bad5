"""Product quantization: codebooks, codes, asymmetric distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import vector as V
from lodestar.operators import sized

SUB = V.SUBVECTORS
STATIC_THRESHOLD = 0.5 * SUB
#: Bytes of a codebook that is sent to all tasks.
BOOK_BYTES = 256 << 20


def _book(codebook: DataFrame) -> DataFrame:
    """One row, (book): the centroids by subvector and code. Codes are 0 .. k - 1, and k is 65536 at most, so that a book of 1024 dimensions has 256 MB at most; larger than BOOK_BYTES it is refused."""
    size = codebook.agg(F.sum(F.size("centroid")) * 4).first()[0] or 0
    if size > BOOK_BYTES:
        raise ValueError(f"a codebook of {size} bytes is too large to go along with each task; train by shard")
    per = codebook.groupBy("sub").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "centroid"))), lambda s: s["centroid"]).alias("cs"))
    return per.agg(F.transform(F.array_sort(F.collect_list(F.struct("sub", "cs"))), lambda s: s["cs"]).alias("book"))


def exploded(vectors: DataFrame, key: str, width: int) -> DataFrame:
    """(key, sub, part): the subvectors of each vector."""
    return vectors.select(key, F.posexplode(V.subvectors(F.col("embedding"), width)).alias("sub", "part"))


def first_codebook(vectors: DataFrame, k: int, width: int) -> DataFrame:
    """(sub, code, centroid): the first k vectors as centroids, for checks against SQL."""
    first = vectors.where(F.col("partition_id") < k).select(F.col("partition_id").cast("int").alias("code"), "embedding")
    return exploded(first, "code", width).select("sub", "code", F.col("part").alias("centroid"))


def encode(vectors: DataFrame, codebook: DataFrame, width: int) -> DataFrame:
    """(partition_id, codes): the nearest centroid of each subvector, the lower code on a tie. Inside the row, against the broadcast codebook."""

    def code(i):
        d = F.transform(F.get("book", i), lambda c: V.squared_l2(F.slice("embedding", i * width + 1, width), c))
        return T.let(d, lambda ds: (F.array_position(ds, F.array_min(ds)) - 1).cast("int"))

    rows = vectors.select("partition_id", "embedding").crossJoin(F.broadcast(_book(codebook)))
    return rows.select("partition_id", F.transform(F.sequence(F.lit(0), F.lit(SUB - 1)), code).alias("codes"))


def lookup_table(queries: DataFrame, codebook: DataFrame, width: int) -> DataFrame:
    """(query_id, lut): by subvector and code, the distance, not squared, from each query's subvector to the centroid."""
    row = lambda i: F.transform(F.get("book", i), lambda c: V.l2(F.slice("query", i * width + 1, width), c))
    return queries.crossJoin(F.broadcast(_book(codebook))).select("query_id", F.transform(F.sequence(F.lit(0), F.lit(SUB - 1)), row).alias("lut"))


def asymmetric(codes: DataFrame, lut: DataFrame) -> DataFrame:
    """(query_id, partition_id, distance): the sum over subvectors of the table's entries, a sum of norms. Tables are broadcast if they are few, codes only scanned."""
    d = F.aggregate(F.zip_with("codes", "lut", lambda c, t: F.get(t, c)), F.lit(0.0), lambda s, x: s + x)
    return codes.crossJoin(sized.small(lut, 1 << 16)).select("query_id", "partition_id", d.alias("distance"))


def threshold(vectors: DataFrame, codes: DataFrame, codebook: DataFrame, width: int, by: str | None = None) -> DataFrame:
    """Mean + 1.5 standard deviations of each vector's distance to its own code, and the static one at least."""
    rows = codes.join(vectors, "partition_id").crossJoin(F.broadcast(_book(codebook)))
    each = F.transform("codes", lambda c, i: V.l2(F.slice("embedding", i * width + 1, width), F.get(F.get("book", i), c)))
    err = rows.withColumn("err", F.aggregate(each, F.lit(0.0), lambda s, x: s + x))
    stat = F.greatest(F.avg("err") + 1.5 * F.stddev_pop("err"), F.lit(STATIC_THRESHOLD)).alias("threshold")
    return err.groupBy(by).agg(stat) if by else err.agg(stat)


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 20, still: float = 1e-3) -> np.ndarray:
    """k-means++ start, at most ``rounds`` Lloyd steps until no centroid moves by ``still``; an emptied one becomes a random vector."""
    r = np.random.default_rng(seed)
    c = [x[r.integers(len(x))]]
    d = ((x - c[0]) ** 2).sum(1)
    while len(c) < k:
        c.append(x[r.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[r.integers(len(x))])
        d = np.minimum(d, ((x - c[-1]) ** 2).sum(1))
    c = np.array(c)
    for _ in range(rounds):
        own = np.concatenate([np.argmin((c * c).sum(1) - 2 * x[a : a + 4096] @ c.T, axis=1) for a in range(0, len(x), 4096)])
        new = np.array([x[own == i].mean(0) if (own == i).any() else x[r.integers(len(x))] for i in range(k)])
        moved = np.sqrt(((new - c) ** 2).sum(1)).max()
        c = new
        if moved < still:
            break
    return c


def train(vectors: DataFrame, by: str, width: int, seed: int = 0) -> DataFrame:
    """(by, sub, code, centroid): codebooks of each value of ``by``, sized by its number of vectors."""
    key = dict(vectors.dtypes)[by]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        n = len(x)
        k = 2 if n < 78 else min(65536, 1 << int(np.log2(n // 39)))
        out = []
        for sub in range(SUB):
            for code, c in enumerate(kmeans(x[:, sub * width : (sub + 1) * width], min(k, max(2, n)), seed + sub)):
                out.append((rows[by].iloc[0], sub, code, c.astype(np.float32).tolist()))
        return pd.DataFrame(out, columns=[by, "sub", "code", "centroid"])

    return vectors.select(by, "embedding").groupBy(by).applyInPandas(fit, f"{by} {key}, sub int, code int, centroid array<float>")


def retrained(old: DataFrame | None, new: DataFrame, by: str) -> DataFrame:
    """Codebooks with their generation: those trained now come after the ones there are, which codes made with them still need."""
    if old is None:
        return new.withColumn("generation", F.lit(0))
    last = old.groupBy(by).agg((F.max("generation") + 1).alias("generation"))
    return old.unionByName(new.join(last, by, "left").withColumn("generation", F.coalesce("generation", F.lit(0))))


def diversity_floor(adc: DataFrame, represented: DataFrame, views, limit: int, groups: list[str] | None = None) -> DataFrame:
    """(query_id, group_id, partition_id, distance): for available groups without a hit, by identifier and at most ``limit``, their best partition.

    adc: (query_id, partition_id, document_id, distance); represented: (query_id, group_id); groups: the only ones wanted, if any are named.
    """
    free = views.document_access.where("access = 'available'").select("document_id")
    members = views.document_group.select("group_id", "document_id").distinct().join(free, "document_id", "left_semi")
    if groups:
        members = members.where(F.col("group_id").isin(groups))
    wanted = adc.join(members, "document_id").join(represented, ["query_id", "group_id"], "left_anti")
    best = wanted.groupBy("query_id", "group_id").agg(F.min(F.struct("distance", "partition_id")).alias("m")).select("query_id", "group_id", "m.partition_id", "m.distance")
    return best.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("group_id"))).where(F.col("n") <= limit).drop("n")
