"""The layered graph as stored tables: built once, grown by batches, searched without building, compacted and replayed.

Nodes are (shard_id, local_idx, partition_id, document_id, level, is_deleted, embedding);
links are (shard_id, local_idx, layer, neighbours), neighbours as local numbers in order of
position; states are one row a shard: entry, max_level, ef, ema. A shard has about
graph.CAPACITY nodes and is the unit of work: one task loads it into arrays, whatever the
number of shards.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators.graph import CAPACITY, COMPACT_AT, M, Graph, by_shard

EF, EF_MIN, EF_MAX, ALPHA = 150, 50, 800, 0.15
NODE = "shard_id int, local_idx int, partition_id bigint, document_id bigint, level int, is_deleted boolean, embedding array<float>"
LINK = "shard_id int, local_idx int, layer int, neighbours array<int>"
STATE = "shard_id int, entry int, max_level int, ef int, ema double"
HIT = "query_id bigint, shard_id int, nodes int, max_level int, ef int, hops array<int>, explored int, found int, ema double, next_ef int, hits array<struct<partition_id:bigint,document_id:bigint,distance:double>>"


def adapted(ema: float, explored: int) -> tuple[float, int]:
    """Moving average of what searches explore, and the breadth that half as much again allows."""
    ema = float(explored) if ema == 0 else (1 - ALPHA) * ema + ALPHA * explored
    return ema, min(EF_MAX, max(EF_MIN, int(np.floor(ema * 1.5 + 0.5))))


def loaded(nodes: pd.DataFrame, links: pd.DataFrame, entry: int | None, m: int = M) -> Graph:
    """A shard's arrays as a graph; nodes in order of local_idx."""
    g = Graph(m)
    g.block = np.stack(nodes["embedding"].to_numpy()).astype(np.float64) if len(nodes) else np.empty((0, 0))
    g.levels = nodes["level"].to_numpy(np.int64)
    g.links = [[[] for _ in range(n + 1)] for n in g.levels]
    for i, layer, near in zip(links["local_idx"], links["layer"], links["neighbours"], strict=True):
        g.links[i][layer] = [int(x) for x in near]
    g.entry = entry
    return g


def link_rows(shard: int, g: Graph) -> pd.DataFrame:
    rows = [(shard, i, layer, own) for i, x in enumerate(g.links) for layer, own in enumerate(x)]
    return pd.DataFrame(rows, columns=["shard_id", "local_idx", "layer", "neighbours"])


@dataclass(frozen=True)
class Index:
    nodes: DataFrame
    links: DataFrame
    states: DataFrame

    # --- building ---------------------------------------------------------------------
    @classmethod
    def build(cls, nodes: DataFrame, m: int = M) -> Index:
        """From nodes with levels: each shard's graph, inserted in order of local_idx."""
        columns = [c.split()[0] for c in NODE.split(", ")]

        def one(shard: pd.DataFrame) -> pd.DataFrame:
            shard = shard.sort_values("local_idx")
            g = Graph(m).build(np.stack(shard["embedding"].to_numpy()).astype(np.float64), shard["level"].to_numpy())
            return link_rows(int(shard["shard_id"].iloc[0]), g)

        nodes = nodes.select(*columns)
        links = by_shard(nodes).groupBy("shard_id").applyInPandas(one, LINK)
        return cls(nodes, links, elected(nodes))

    def inserted(self, new: DataFrame, m: int = M) -> Index:
        """With rows (shard_id, seq, partition_id, document_id, level, embedding) linked into their shards' graphs, in order of seq.

        A partition that is there already is marked deleted and inserted anew; an
        empty embedding isn't inserted. Only shards with new rows are loaded; the
        links of all others are taken over as they are.
        """
        new = new.where("size(embedding) > 0")
        touched = new.select("shard_id").distinct()
        old = self.nodes.join(touched, "shard_id", "left_semi")
        same = old.where("NOT is_deleted").join(new.select("shard_id", "partition_id").distinct().withColumn("gone", F.lit(True)), ["shard_id", "partition_id"], "left")
        dead = same.where("gone").select("shard_id", "local_idx", F.lit(True).alias("gone"))
        base = self.nodes.groupBy("shard_id").agg((F.max("local_idx") + 1).alias("base"))
        last = new.withColumn("n", F.row_number().over(W.partitionBy("shard_id", "partition_id").orderBy(F.desc("seq")))).where("n = 1")
        place = F.row_number().over(W.partitionBy("shard_id").orderBy("seq", "partition_id"))
        fresh = last.join(base, "shard_id", "left").select(
            "shard_id", (F.coalesce("base", F.lit(0)) + place - 1).cast("int").alias("local_idx"), "partition_id", "document_id", "level", F.lit(False).alias("is_deleted"), "embedding"
        )
        marked = self.nodes.join(dead, ["shard_id", "local_idx"], "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("gone", F.lit(False))).drop("gone")
        nodes = marked.select(*self.nodes.columns).unionByName(fresh)
        work = nodes.join(touched, "shard_id", "left_semi").join(fresh.select("shard_id", "local_idx", F.lit(True).alias("fresh")), ["shard_id", "local_idx"], "left")
        links = self.links.join(touched, "shard_id", "left_semi").select("shard_id", F.col("local_idx").alias("link_idx"), "layer", "neighbours")
        entry = self.states.select("shard_id", "entry")
        rows = work.join(entry, "shard_id", "left")

        def one(key, shard: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
            if not len(shard):
                return link_rows(int(key[0]), Graph(m))
            shard = shard.sort_values("local_idx")
            entry = shard["entry"].iloc[0]
            g = loaded(shard, links.rename(columns={"link_idx": "local_idx"}), None if pd.isna(entry) or entry < 0 else int(entry), m)
            for i in np.flatnonzero(shard["fresh"].notna().to_numpy()).tolist():
                g.insert(i)
            return link_rows(int(key[0]), g)

        grown = by_shard(rows).groupBy("shard_id").cogroup(by_shard(links).groupBy("shard_id")).applyInPandas(one, LINK)
        kept = self.links.join(touched, "shard_id", "left_anti")
        return Index(nodes, kept.unionByName(grown), _states(nodes, self.states))

    def put(self, documents: DataFrame, capacity: int = CAPACITY, m: int = M) -> Index:
        """With the partitions (seq, partition_id, document_id, level, embedding) of documents, routed to shards.

        A document that is live somewhere stays in its shard; others go to the first
        shard with fewer live nodes than its capacity, in order of seq, and to new ones
        behind the last. What a document had before is marked deleted.
        """
        from lodestar.operators.graph import fill, routing

        mine = documents.where("size(embedding) > 0")
        home = routing(self.nodes)
        sizes = mine.groupBy("document_id").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("nodes"))
        known = sizes.join(home, "document_id").select("document_id", "shard_id")
        have = self.nodes.groupBy("shard_id").agg(F.count_if(~F.col("is_deleted")).alias("nodes"))
        routed = known.unionByName(fill(sizes.join(home, "document_id", "left_anti"), capacity, have))
        return self.removed(mine.select("document_id").distinct()).inserted(mine.join(routed, "document_id"), m)

    def removed(self, documents: DataFrame) -> Index:
        """Documents' nodes marked deleted; a shard whose entry goes elects another."""
        gone = documents.select("document_id").distinct().withColumn("gone", F.lit(True))
        nodes = self.nodes.join(gone, "document_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("gone", F.lit(False))).select(*self.nodes.columns)
        was = self.states.withColumnsRenamed({"entry": "was", "max_level": "was_level"})
        live = nodes.where("NOT is_deleted").select("shard_id", F.col("local_idx").alias("was"), F.lit(True).alias("alive"))
        both = was.join(live, ["shard_id", "was"], "left").join(elected(nodes).select("shard_id", "entry", "max_level"), "shard_id", "left")
        states = both.select("shard_id", F.when(F.col("alive"), F.col("was")).otherwise(F.coalesce("entry", F.lit(-1))).alias("entry"), F.when(F.col("alive"), F.col("was_level")).otherwise(F.coalesce("max_level", F.lit(-1))).alias("max_level"), "ef", "ema")
        return replace(self, nodes=nodes, states=states)

    def removed_partition(self, partition_id: int, at: float = COMPACT_AT) -> Index:
        """Without the whole document of a partition; shards that it leaves too empty are compacted."""
        return self.removed(self.nodes.where(F.col("partition_id") == partition_id).select("document_id")).compacted(at)

    # --- search -----------------------------------------------------------------------
    def search(self, queries: DataFrame, k: int, documents: DataFrame | None = None, ef: int | None = None) -> DataFrame:
        """One row for each query and shard, with its hits and what the search did (HIT).

        documents: those that may be found, by scope, group, access or tags; others
        are walked through and not returned. The breadth is the shard's ef, or k if
        that is more, and adapts from query to query in order of query_id; next_ef and
        ema are what the shard has afterwards. queries are requests and go along with the tasks.
        """
        got = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).orderBy("query_id").toArrow()
        q, ids = np.array(got.column("query").to_pylist(), np.float64), got.column("query_id").to_pylist()
        rows = self.nodes.join(self.states, "shard_id")
        if documents is not None:
            rows = rows.join(documents.select("document_id").distinct().withColumn("ok", F.lit(True)), "document_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        else:
            rows = rows.withColumn("ok", F.lit(True))
        links = self.links.withColumnRenamed("local_idx", "link_idx")

        def one(key, shard: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
            shard = shard.sort_values("local_idx").reset_index(drop=True)
            out = []
            entry = int(shard["entry"].iloc[0]) if len(shard) else -1
            if entry >= 0:
                g = loaded(shard, links.rename(columns={"link_idx": "local_idx"}), entry)
                live = ~shard["is_deleted"].to_numpy()
                ok = live & shard["ok"].to_numpy()
                part, doc, top = shard["partition_id"].tolist(), shard["document_id"].tolist(), int(shard["max_level"].iloc[0])
                breadth, ema = int(shard["ef"].iloc[0]), float(shard["ema"].iloc[0])
                for i, v in zip(ids, q, strict=True):
                    wide = max(k, ef or breadth)
                    found, hops, explored = g.traced(v, wide, ok)
                    ema, after = adapted(ema, explored)
                    breadth = after if ef is None else breadth
                    hits = [{"partition_id": part[n], "document_id": doc[n], "distance": d} for d, n in found[:k]]
                    out.append((i, int(key[0]), len(shard), top, wide, hops, explored, len(found), ema, breadth, hits))
            return pd.DataFrame(out, columns=[c.split()[0] for c in HIT.split(", ")])

        return by_shard(rows).groupBy("shard_id").cogroup(by_shard(links).groupBy("shard_id")).applyInPandas(one, HIT)

    def learned(self, searched: DataFrame) -> Index:
        """With the breadths that a search has left its shards with."""
        last = searched.groupBy("shard_id").agg(F.max_by("next_ef", "query_id").alias("new_ef"), F.max_by("ema", "query_id").alias("new_ema"))
        both = self.states.join(last, "shard_id", "left")
        return replace(self, states=both.select("shard_id", "entry", "max_level", F.coalesce("new_ef", "ef").alias("ef"), F.coalesce("new_ema", "ema").alias("ema")))

    # --- upkeep -----------------------------------------------------------------------
    def compacted(self, at: float = COMPACT_AT) -> Index:
        """Shards of which at least this part is deleted are rewritten.

        Live nodes above layer 0 without any neighbour there come down to it; deleted
        nodes go, also from neighbour lists; the rest is numbered anew in order, and
        the first node of the highest level becomes the entry.
        """
        share = self.nodes.groupBy("shard_id").agg((F.count_if("is_deleted") / F.count(F.lit(1)) >= at).alias("rewrite"))
        upper = self.links.where("layer > 0 AND size(neighbours) > 0").select("shard_id", "local_idx").distinct().withColumn("hub", F.lit(True))
        number = (F.row_number().over(W.partitionBy("shard_id").orderBy("local_idx")) - 1).cast("int")
        marked = self.nodes.join(share, "shard_id").join(upper, ["shard_id", "local_idx"], "left").where("NOT (rewrite AND is_deleted)")
        level = F.when(F.col("rewrite") & F.col("hub").isNull(), F.lit(0)).otherwise(F.col("level")).cast("int")
        moved = marked.withColumn("level", level).withColumn("now", F.when(F.col("rewrite"), number).otherwise(F.col("local_idx")))
        nodes = moved.select(*[F.col("now").alias(c) if c == "local_idx" else c for c in self.nodes.columns])
        stay = self.links.join(share.where("rewrite"), "shard_id", "left_anti")
        to = moved.where("rewrite").select("shard_id", "local_idx", "now", "level")
        own = self.links.join(to, ["shard_id", "local_idx"]).where("layer <= level").select("shard_id", "now", "layer", "neighbours")
        each = own.select("shard_id", "now", "layer", F.posexplode_outer("neighbours").alias("pos", "local_idx"))
        each = each.join(to.select("shard_id", "local_idx", F.col("now").alias("near")), ["shard_id", "local_idx"], "left")
        listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("near").isNotNull(), F.struct("pos", "near")))), lambda s: s["near"])
        links = stay.unionByName(each.groupBy("shard_id", F.col("now").alias("local_idx"), "layer").agg(listed.alias("neighbours")))
        new = elected(nodes).select("shard_id", F.col("entry").alias("e"), F.col("max_level").alias("l"))
        both = self.states.join(share, "shard_id", "left").join(new, "shard_id", "left")
        pick = lambda fresh, old: F.when(F.col("rewrite"), F.coalesce(fresh, F.lit(-1))).otherwise(F.col(old)).alias(old)
        return Index(nodes, links, both.select("shard_id", pick("e", "entry"), pick("l", "max_level"), "ef", "ema"))

    def without_copies(self) -> Index:
        """Documents live in several shards stay in the last; of a partition twice in a shard the last insertion stays. Others are marked deleted."""
        last = self.nodes.where("NOT is_deleted").groupBy("document_id").agg(F.max("shard_id").alias("stay"))
        n = F.row_number().over(W.partitionBy("shard_id", "partition_id", "is_deleted").orderBy(F.desc("local_idx")))
        both = self.nodes.join(last, "document_id", "left").withColumn("n", n)
        dead = F.col("is_deleted") | (F.col("shard_id") != F.coalesce("stay", "shard_id")) | (F.col("n") > 1)
        nodes = both.withColumn("is_deleted", dead).select(*self.nodes.columns)
        return replace(self, nodes=nodes, states=_states(nodes, self.states))

    # --- storing ----------------------------------------------------------------------
    def save(self, store, name: str = "graph") -> None:
        store.save_together(name, {"nodes": self.nodes, "links": self.links, "states": self.states})

    @classmethod
    def restore(cls, store, name: str = "graph") -> Index | None:
        got = store.restore_together(name, ("nodes", "links", "states"))
        return None if got is None else cls(got["nodes"], got["links"], got["states"])


def elected(nodes: DataFrame) -> DataFrame:
    """(shard_id, entry, max_level, ef, ema): the first live node of the highest level."""
    best = F.max(F.struct("level", (-F.col("local_idx")).alias("back"))).alias("b")
    return nodes.where("NOT is_deleted").groupBy("shard_id").agg(best).select(
        "shard_id", (-F.col("b.back")).cast("int").alias("entry"), F.col("b.level").alias("max_level"), F.lit(EF).alias("ef"), F.lit(0.0).alias("ema")
    )


def _states(nodes: DataFrame, old: DataFrame) -> DataFrame:
    """States of all shards there are, entries elected anew, what searches taught kept; a shard without live nodes has entry -1."""
    both = nodes.select("shard_id").distinct().join(elected(nodes).drop("ef", "ema"), "shard_id", "left").join(old.select("shard_id", "ef", "ema"), "shard_id", "left")
    return both.select("shard_id", F.coalesce("entry", F.lit(-1)).alias("entry"), F.coalesce("max_level", F.lit(-1)).alias("max_level"), F.coalesce("ef", F.lit(EF)).alias("ef"), F.coalesce("ema", F.lit(0.0)).alias("ema"))


def replayed(nodes: DataFrame, links: DataFrame, states: DataFrame, records: DataFrame) -> Index:
    """The index after valid, committed log records behind its checkpoint.

    records: (seq, shard_id, kind, local_idx, partition_id, document_id, level, layer,
    neighbours) of kinds 'insert' (one row a layer), 'link', 'delete', 'entry' (local_idx -1
    and level -1 where the shard is empty). Every kind may be applied twice: an inserted
    partition that is there is skipped, of lists and entries the last counts. Vectors
    are in their file already; those of new nodes are joined by whoever has them.
    """
    ins = records.where("kind = 'insert'")
    once = ins.groupBy("shard_id", "partition_id").agg(F.min("seq").alias("seq"))
    ins = ins.join(once, ["shard_id", "partition_id", "seq"])
    there = nodes.where("NOT is_deleted").select("shard_id", "partition_id")
    ins = ins.join(there, ["shard_id", "partition_id"], "left_anti")
    fresh = ins.select("shard_id", "local_idx", "partition_id", "document_id", "level").distinct()
    all_nodes = nodes.unionByName(fresh.withColumn("is_deleted", F.lit(False)), allowMissingColumns=True)
    dead = records.where("kind = 'delete'").select("shard_id", "local_idx").distinct().withColumn("gone", F.lit(True))
    out_nodes = all_nodes.join(dead, ["shard_id", "local_idx"], "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("gone", F.lit(False))).select(*nodes.columns)
    lists = links.select("shard_id", "local_idx", "layer", "neighbours", F.lit(-1).cast("long").alias("seq"))
    lists = lists.unionByName(ins.select("shard_id", "local_idx", "layer", "neighbours", "seq"))
    known = all_nodes.select("shard_id", "local_idx", F.col("level").alias("top"))
    changed = records.where("kind = 'link'").join(known, ["shard_id", "local_idx"]).where("layer <= top")
    lists = lists.unionByName(changed.select("shard_id", "local_idx", "layer", "neighbours", "seq"))
    out_links = lists.groupBy("shard_id", "local_idx", "layer").agg(F.max_by("neighbours", "seq").alias("neighbours"))
    size = all_nodes.groupBy("shard_id").agg((F.max("local_idx") + 1).alias("size"))
    moved = records.where("kind = 'entry'").join(size, "shard_id", "left").where("local_idx = -1 OR local_idx < size")
    last = moved.groupBy("shard_id").agg(F.max_by(F.struct("local_idx", "level"), "seq").alias("e"))
    both = states.join(last, "shard_id", "full")
    out_states = both.select("shard_id", F.coalesce("e.local_idx", "entry").alias("entry"), F.coalesce("e.level", "max_level").alias("max_level"), F.coalesce("ef", F.lit(EF)).alias("ef"), F.coalesce("ema", F.lit(0.0)).alias("ema"))
    return Index(out_nodes, out_links, out_states)
