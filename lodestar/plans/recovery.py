"""Starting up: state from the last checkpoint and the log's tail, then repair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.index import Index, replayed
from lodestar.operators.registry import Registry
from lodestar.sources.journal import Journal
from lodestar.sources.store import spooled

TABLES = ("nodes", "links", "states")


@dataclass(frozen=True)
class Recovered:
    """index, and what was found on the way: (what, n) rows, document routing, documents without content."""

    index: Index
    report: DataFrame
    routing: DataFrame
    missing: DataFrame


def recover(journal: Journal, registry: Registry, vectors: DataFrame, content: DataFrame | None = None, at: float = 0.35) -> Recovered | None:
    """The index as it was when the last record was committed.

    1. the checkpoint's tables, or empty ones, so that shards that came up after it
       are made from the log alone; 2. the tail is replayed, each kind so that twice
    does no harm; 3. vectors (shard_id, partition_id, embedding) are attached, and a
    shard of which any live node has none is taken out of search (entry -1); 4. documents
    that nobody registered are removed; 5. of partitions that are twice in a shard and
    documents in several shards one copy stays, and shards with too many dead nodes are
    compacted; 6. routing is made anew from live nodes. Each step's tables are written
    once. None where there is neither
    checkpoint nor log.
    """
    spark = vectors.sparkSession
    state, tail = journal.state(TABLES), journal.tail()
    if state is None and tail is None:
        return None
    if state is None:
        kind = dict(vectors.dtypes)["partition_id"]
        empty = lambda s: spark.createDataFrame([], s)
        state = {
            "nodes": empty(f"shard_id int, local_idx int, partition_id {kind}, document_id {dict(tail.dtypes)['document_id']}, level int, is_deleted boolean"),
            "links": empty("shard_id int, local_idx int, layer int, neighbours array<int>"),
            "states": empty("shard_id int, entry int, max_level int, ef int, ema double"),
        }
    nodes = state["nodes"].drop("embedding")
    index = replayed(nodes, state["links"], state["states"], tail) if tail is not None else Index(nodes, state["links"], state["states"])
    index = Index(spooled(index.nodes), spooled(index.links), spooled(index.states))
    # an upsert leaves several nodes of a partition; they have one vector
    attached = index.nodes.join(vectors.select("shard_id", "partition_id", "embedding").dropDuplicates(["shard_id", "partition_id"]), ["shard_id", "partition_id"], "left")
    lacking = attached.where("NOT is_deleted AND embedding IS NULL").select("shard_id").distinct().withColumn("off", F.lit(True))
    index = Index(attached.select("shard_id", "local_idx", "partition_id", "document_id", "level", "is_deleted", "embedding"), index.links, index.states)
    orphans = spooled(registry.orphans(index.nodes.where("NOT is_deleted")))
    clean = index.removed(orphans).without_copies()
    clean = Index(spooled(clean.nodes), clean.links, spooled(clean.states))
    whole = clean.compacted(at)
    off = lambda c: F.when(F.col("off"), -1).otherwise(F.col(c)).alias(c)
    whole = Index(whole.nodes, whole.links, whole.states.join(lacking, "shard_id", "left").select("shard_id", off("entry"), off("max_level"), "ef", "ema"))
    whole = Index(spooled(whole.nodes), spooled(whole.links), spooled(whole.states))
    live = lambda df: df.where("NOT is_deleted")
    n = lambda what, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    after = live(whole.nodes)
    copies = live(index.removed(orphans).nodes).select("shard_id", "local_idx", "document_id").exceptAll(live(clean.nodes).select("shard_id", "local_idx", "document_id"))
    report = n("nodes", after).union(n("orphans", orphans)).union(n("copies", copies)).union(n("shards without vectors", lacking))
    if tail is not None:
        report = report.union(n("records", tail))
    routing = after.groupBy("document_id").agg(F.max("shard_id").alias("shard_id"))
    have = content.select("document_id").distinct() if content is not None else after.select("document_id").distinct()
    missing = registry.document_access.select("document_id").join(have, "document_id", "left_anti")
    return Recovered(whole, report, routing, missing)


def tidied(index: Index, at: float = 0.35) -> Index:
    """Documents in several shards and partitions twice in one stay once; shards with too many dead nodes are compacted."""
    return index.without_copies().compacted(at)


def merged(routing: DataFrame, have: DataFrame, loaded: DataFrame, key: str = "document_id") -> DataFrame:
    """Per-document indices in memory, and of those read from disk the ones whose document is routed and not there yet; the first of them by position wins."""
    new = loaded.join(routing.select(key), key, "left_semi").join(have.select(key), key, "left_anti")
    return have.unionByName(new.dropDuplicates([key]), allowMissingColumns=True)
