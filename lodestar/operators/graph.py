"""The proximity graph as tables of nodes and edges: build, statistics, neighbours, compaction, shards."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import vector as V
from lodestar.operators import sized

M = 16
COMPACT_AT = 0.35
CAPACITY = 2500
#: Up to this many nodes a graph's distances from a node or query are computed for all nodes at once, and kept for nodes.
TABLE = 1024


def by_shard(rows: DataFrame) -> DataFrame:
    """rows divided by shard into spark.sql.shuffle.partitions, which aren't put together: a shard is work out of proportion to its bytes, by which Spark would give many to one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard_id")


def knn_edges(nodes: DataFrame, m: int = M) -> DataFrame:
    """(shard_id, src, dst, pos, distance): the m nearest live nodes of each live node within its shard."""
    live = nodes.where("NOT is_deleted").select("shard_id", "partition_id", "embedding")
    a = live.select("shard_id", F.col("partition_id").alias("src"), F.col("embedding").alias("x"))
    b = live.select("shard_id", F.col("partition_id").alias("dst"), F.col("embedding").alias("y"))
    pairs = a.join(b, "shard_id").where("src <> dst").select("shard_id", "src", "dst", V.squared_l2(F.col("x"), F.col("y")).alias("distance"))
    pos = F.row_number().over(W.partitionBy("src").orderBy("distance", "dst"))
    return pairs.withColumn("pos", pos).where(F.col("pos") <= m)


def prune(edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest neighbours of each node."""
    n = F.row_number().over(W.partitionBy("src").orderBy("distance", "dst"))
    return edges.withColumn("n", n).where(F.col("n") <= most).drop("n")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(shard_id, live, deleted, max_level, mean_degree): the mean counts deleted nodes too."""
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.join(degree, nodes["partition_id"] == degree["src"], "left")
    return n.groupBy("shard_id").agg(
        F.count_if(~F.col("is_deleted")).alias("live"), F.count_if("is_deleted").alias("deleted"), F.max("level").alias("max_level"), F.avg(F.coalesce("degree", F.lit(0))).alias("mean_degree")
    )


def document_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("document_id").agg(F.count_if(~F.col("is_deleted")).alias("live"), F.max(F.when(~F.col("is_deleted"), F.col("level"))).alias("max_level"), F.bool_or(~F.col("is_deleted")).alias("trained"))


def hubs(nodes: DataFrame, include_deleted: bool = False) -> DataFrame:
    rows = nodes.where("level > 0")
    return rows if include_deleted else rows.where("NOT is_deleted")


def neighbours(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(partition_id, neighbours): identifiers in order of position, of the given nodes; those that don't exist are left out."""
    e = edges.join(nodes.select(F.col("partition_id").alias("dst")), "dst", "left_semi")
    if ids is not None:
        e = e.join(ids.select(F.col("partition_id").alias("src")), "src", "left_semi")
        nodes = nodes.join(ids.select("partition_id"), "partition_id", "left_semi")
    lists = e.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda s: s["dst"]).alias("neighbours"))
    out = nodes.select("partition_id").join(lists, nodes["partition_id"] == lists["src"], "left")
    return out.select("partition_id", F.coalesce("neighbours", F.array().cast(dict(lists.dtypes)["neighbours"])).alias("neighbours"))


def entry_points(nodes: DataFrame) -> DataFrame:
    """(shard_id, local_idx): the first live node of the highest level."""
    live = nodes.where("NOT is_deleted")
    return live.groupBy("shard_id").agg(F.max_by("local_idx", F.struct("level", -F.col("local_idx"))).alias("local_idx"))


def compact(nodes: DataFrame, edges: DataFrame, at: float = COMPACT_AT) -> tuple[DataFrame, DataFrame]:
    """Rewrite the shards of which at least this part is deleted: dead nodes and edges go, the rest is numbered anew.

    Where edges have a layer, a live node without any neighbour above layer 0
    before that comes down to it. (Index.compacted does the same to stored lists.)
    """
    share = nodes.groupBy("shard_id").agg((F.count_if("is_deleted") / F.count(F.lit(1)) >= at).alias("rewrite"))
    kept = nodes.join(share, "shard_id").where("NOT (rewrite AND is_deleted)")
    if "layer" in edges.columns and "level" in nodes.columns:
        upper = edges.where("layer > 0").select(F.col("src").alias("partition_id"), F.lit(True).alias("hub")).distinct()
        kept = kept.join(upper, "partition_id", "left").withColumn("level", F.when(F.col("rewrite") & F.col("hub").isNull(), 0).otherwise(F.col("level")).cast("int")).drop("hub")
    number = F.row_number().over(W.partitionBy("shard_id").orderBy("local_idx")) - 1
    new = kept.withColumn("local_idx", F.when(F.col("rewrite"), number).otherwise(F.col("local_idx")).cast("int")).drop("rewrite").select(*nodes.columns)
    alive = new.select("partition_id")
    e = edges.join(alive.withColumnRenamed("partition_id", "src"), "src", "left_semi").join(alive.withColumnRenamed("partition_id", "dst"), "dst", "left_semi")
    return new, e


def newest_shard(placed: DataFrame) -> DataFrame:
    """(document_id, shard_id, copies): documents live in more than one shard, and the one to keep, the last."""
    return placed.groupBy("document_id").agg(F.max("shard_id").alias("shard_id"), F.count_distinct("shard_id").alias("copies")).where("copies > 1")


def routing(nodes: DataFrame) -> DataFrame:
    return nodes.where("NOT is_deleted").groupBy("document_id").agg(F.max("shard_id").alias("shard_id"))


def phantoms(nodes: DataFrame) -> DataFrame:
    """Nodes that repeat a partition of their shard; the last insertion is the one that counts."""
    n = F.row_number().over(W.partitionBy("shard_id", "partition_id").orderBy(F.desc("local_idx")))
    return nodes.withColumn("n", n).where("n > 1").select("shard_id", "partition_id", "local_idx")


def fill(documents: DataFrame, capacity: int = CAPACITY, have: DataFrame | None = None) -> DataFrame:
    """(document_id, shard_id): shards filled in order of seq. A shard takes documents while it has fewer nodes than its capacity, and may be exceeded by the last.

    documents: (seq, document_id, nodes); have: (shard_id, nodes) of the shards there
    are. The first of those with room is taken, then new ones behind the last.
    Which shard a document goes to depends on all before it, so one task reads
    the documents, sorted by Spark, as a stream; it keeps a shard's number and
    fill, and takes a step a shard and not a document.
    """
    rows = documents.select(F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), F.col("document_id").cast("long").alias("document_id"), F.col("nodes").cast("long").alias("nodes"))
    if have is not None:
        rows = rows.unionByName(have.select(F.lit(0).alias("kind"), F.col("shard_id").cast("long").alias("seq"), F.lit(None).cast("long").alias("document_id"), F.col("nodes").cast("long").alias("nodes")))

    def run(batches):
        room: list[tuple[int, int]] = []  # shards with room and what they have, the next one last
        after, now, n, begun = 0, None, 0, False
        for b in batches:
            kind, seq, nodes = (b.column(c).to_numpy() for c in ("kind", "seq", "nodes"))
            first = int(np.searchsorted(kind, 1))
            for s, k in zip(seq[:first].tolist(), nodes[:first].tolist(), strict=True):
                after = max(after, s + 1)
                if k < capacity:
                    room.append((s, k))
            if first == b.num_rows:
                continue
            if not begun:
                room, begun = room[::-1], True
            nodes = nodes[first:]
            total = np.cumsum(nodes)
            shard = np.empty(len(nodes), np.int32)
            at, base = 0, 0
            while at < len(nodes):
                if now is None or n >= capacity:
                    if room:
                        now, n = room.pop()
                    else:
                        now, n, after = after, 0, after + 1
                # up to and with the document that makes the shard full
                end = min(len(nodes), int(np.searchsorted(total, base + capacity - n, "left")) + 1)
                shard[at:end] = now
                n += int(total[end - 1] - base)
                at, base = end, int(total[end - 1])
            yield pa.RecordBatch.from_arrays([b.column("document_id").slice(first), pa.array(shard)], ["document_id", "shard_id"])

    return rows.repartition(1).sortWithinPartitions("kind", "seq", "document_id").mapInArrow(run, "document_id bigint, shard_id int")


class Graph:
    """A layered proximity graph of one shard, built in order of insertion; used inside a task."""

    def __init__(self, m: int = M, ef_build: int = 200):
        self.m, self.ef, self.links, self.entry, self.explored, self.rows = m, ef_build, [], None, 0, {}

    def _d(self, q, ids):
        d = self.block[ids] - q
        return (d * d).sum(1)

    def _far(self, q):
        """Distances from q to nodes, as a function of their numbers: the same floats, whether computed for all nodes or for those asked for."""
        if len(self.block) > TABLE:
            return lambda ids: self._d(q, ids).tolist()
        row = self._d(q, slice(None)).tolist()
        return lambda ids: [row[j] for j in ids]

    def _far_from(self, i: int):
        """The same from a node."""
        if len(self.block) > TABLE:
            return self._far(self.block[i])
        row = self.rows.get(i)
        if row is None:
            row = self.rows[i] = self._d(self.block[i], slice(None)).tolist()
        return lambda ids: [row[j] for j in ids]

    def _beam(self, far, start: list[int], layer: int, ef: int, allowed=None) -> list[tuple[float, int]]:
        """Best-first search by the distances ``far``; nodes that aren't allowed are walked through and not returned."""
        seen, heap, best = set(start), [*zip(far(start), start, strict=True)], []
        heapq.heapify(heap)
        for d, i in list(heap):
            if allowed is None or allowed[i]:
                heapq.heappush(best, (-d, i))
        while heap:
            d, i = heapq.heappop(heap)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [j for j in self.links[i][layer] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for dj, j in zip(far(new), new, strict=True):
                if len(best) < ef or dj < -best[0][0]:
                    heapq.heappush(heap, (dj, j))
                    if allowed is None or allowed[j]:
                        heapq.heappush(best, (-dj, j))
                        if len(best) > ef:
                            heapq.heappop(best)
        self.explored = len(seen)
        return sorted((-d, i) for d, i in best)

    def _diverse(self, found: list[tuple[float, int]], m: int) -> list[int]:
        """Neighbours nearer to the node than to those already taken, filled up with the nearest of the rest."""
        out: list[int] = []
        for d, i in found:
            if len(out) == m:
                break
            if not out or min(self._far_from(i)(out)) > d:
                out.append(i)
        return out + [i for _, i in found if i not in out][: m - len(out)]

    def build(self, x: np.ndarray, levels: np.ndarray) -> Graph:
        self.block, self.levels, self.rows = x, levels, {}
        self.links = [[[] for _ in range(n + 1)] for n in levels]
        for i in range(len(x)):
            self.insert(i)
        return self

    def insert(self, i: int) -> None:
        """Link node i, whose vector and level are there already, into the graph of the nodes inserted before."""
        levels = self.levels
        if self.entry is None:
            self.entry = i
            return
        at, far = [self.entry], self._far_from(i)
        for layer in range(levels[self.entry], levels[i], -1):
            at = [self._beam(far, at, layer, 1)[0][1]]
        for layer in range(min(levels[i], levels[self.entry]), -1, -1):
            found = self._beam(far, at, layer, self.ef)
            most = 2 * self.m if layer == 0 else self.m
            self.links[i][layer] = self._diverse(found, self.m)
            for j in self.links[i][layer]:
                own = self.links[j][layer]
                own.append(i)
                if len(own) > most:
                    self.links[j][layer] = self._diverse(sorted(zip(self._far_from(j)(own), own, strict=True)), most)
            at = [j for _, j in found]
        if levels[i] > levels[self.entry]:
            self.entry = i

    def _greedy(self, far, at: int, layer: int) -> tuple[int, int]:
        """(nearest node a descent by neighbours reaches, steps taken)"""
        best, hops = far([at])[0], 0
        while True:
            near = self.links[at][layer]
            if not near:
                return at, hops
            d = far(near)
            k = min(range(len(d)), key=d.__getitem__)
            if d[k] >= best:
                return at, hops
            at, best, hops = near[k], d[k], hops + 1

    def traced(self, q: np.ndarray, ef: int, allowed=None) -> tuple[list[tuple[float, int]], list[int], int]:
        """(what a search of this breadth finds, steps on each upper layer, nodes looked at on the lowest)"""
        if self.entry is None:
            return [], [], 0
        at, hops, far = self.entry, [], self._far(q)
        for layer in range(self.levels[self.entry], 0, -1):
            at, n = self._greedy(far, at, layer)
            hops.append(n)
        found = self._beam(far, [at], 0, ef, allowed)
        return found, hops, self.explored

    def search(self, q: np.ndarray, k: int, ef: int = 150, allowed=None) -> list[tuple[float, int]]:
        return self.traced(q, max(k, ef), allowed)[0][:k]


def ann(nodes: DataFrame, queries: DataFrame, k: int, ef: int = 150) -> DataFrame:
    """(query_id, shard_id, partition_id, distance): approximate k nearest live nodes of each shard, by a graph built in the shard's task."""
    rows = queries.toArrow()
    q, ids = np.array(rows.column("query").to_pylist(), np.float64), rows.column("query_id").to_pylist()

    def one(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("local_idx")
        x = np.stack(shard["embedding"].to_numpy()).astype(np.float64)
        g = Graph().build(x, shard["level"].to_numpy())
        ok = ~shard["is_deleted"].to_numpy()
        part = shard["partition_id"].to_numpy()
        out = [(i, int(shard["shard_id"].iloc[0]), int(part[n]), d) for i, v in zip(ids, q, strict=True) for d, n in g.search(v, k, ef, ok)]
        return pd.DataFrame(out, columns=["query_id", "shard_id", "partition_id", "distance"])

    cols = nodes.select("shard_id", "local_idx", "partition_id", "embedding", "level", "is_deleted")
    return by_shard(cols).groupBy("shard_id").applyInPandas(one, "query_id bigint, shard_id int, partition_id bigint, distance double")


def graph_edges(nodes: DataFrame) -> DataFrame:
    """(shard_id, layer, src, dst, pos): the layered graph of each shard, for inspection."""

    def one(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("local_idx")
        part = shard["partition_id"].to_numpy()
        g = Graph().build(np.stack(shard["embedding"].to_numpy()).astype(np.float64), shard["level"].to_numpy())
        out = [(int(shard["shard_id"].iloc[0]), layer, int(part[i]), int(part[j]), pos) for i, x in enumerate(g.links) for layer, own in enumerate(x) for pos, j in enumerate(own)]
        return pd.DataFrame(out, columns=["shard_id", "layer", "src", "dst", "pos"])

    cols = nodes.select("shard_id", "local_idx", "partition_id", "embedding", "level")
    return by_shard(cols).groupBy("shard_id").applyInPandas(one, "shard_id int, layer int, src bigint, dst bigint, pos int")


def ivf(vectors: DataFrame, queries: DataFrame, k: int, lists: int, probes: int, seed: int = 0) -> DataFrame:
    """Approximate top-k by inverted lists: k-means cells, of which each query looks into the nearest few.

    Centroids are few and go along as a broadcast; the vectors are assigned in one
    scan and joined to the probed cells only.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    fit = KMeans(k=lists, maxIter=20, tol=1e-3, seed=seed, featuresCol="v", predictionCol="cell").fit(vectors.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v")))
    cells = vectors.sparkSession.createDataFrame([(i, [float(y) for y in c]) for i, c in enumerate(fit.clusterCenters())], "cell int, center array<double>")
    placed = fit.transform(vectors.withColumn("v", array_to_vector(F.col("embedding").cast("array<double>")))).drop("v")
    near = queries.crossJoin(F.broadcast(cells)).withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(V.squared_l2(F.col("query"), F.col("center")), "cell"))).where(F.col("n") <= probes)
    hits = placed.join(sized.small(near.select("query_id", "query", "cell"), 8 * 64), "cell").select("query_id", "partition_id", V.squared_l2(F.col("query"), F.col("embedding")).alias("distance"))
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "partition_id"))).where(F.col("rank") <= k)
