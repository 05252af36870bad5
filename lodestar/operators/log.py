"""Write queue and mutation log as ordered tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_ITEMS = 100


def coalesced(jobs: DataFrame, lane: str | None = None) -> DataFrame:
    """(lane, batch, owner_id, group_id, first, last, items): neighbouring puts of one owner and group as one job.

    jobs: (seq, owner_id, group_id, kind, items). A job of another kind stands alone. Gaps and islands by window.
    """
    by = [lane] if lane else []
    w = W.partitionBy(*by).orderBy("seq")
    was = lambda c: F.lag(c).over(w)
    same = (F.col("kind") == "put") & (was("kind") == "put") & F.col("owner_id").eqNullSafe(was("owner_id")) & F.col("group_id").eqNullSafe(was("group_id"))
    marked = jobs.withColumn("fresh", F.when(F.coalesce(same, F.lit(False)) & was("seq").isNotNull(), 0).otherwise(1))
    numbered = marked.withColumn("batch", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy(*by, "batch", "owner_id", "group_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.sum("items").alias("items"))


def capped(jobs: DataFrame, lane: str, most: int = MAX_ITEMS) -> DataFrame:
    """As coalesced, but a batch of ``most`` items or more takes no further job; whole jobs are added, so it may exceed that.

    The cap makes it a fold. A lane is sorted by Spark and read as a stream by one
    task, which keeps the batch at hand and nothing else.
    """
    names = ["seq", "owner_id", "group_id", "kind", "items"]

    def run(batches):
        now, done, of = None, [], None  # [lane, first, last, owner, group, put, items]
        for b in batches:
            of = b.schema.field(lane).type
            for key, seq, owner, group, kind, items in zip(*(b.column(c).to_pylist() for c in [lane, *names]), strict=True):
                put = kind == "put"
                if now and put and now[5] and now[0] == key and now[3] == owner and now[4] == group and now[6] < most:
                    now[2], now[6] = seq, now[6] + items
                else:
                    if now:
                        done.append(now)
                    now = [key, seq, seq, owner, group, put, items]
            if done:
                yield _batches(done, lane, of)
                done = []
        if now:
            yield _batches([now], lane, of)

    slim = jobs.select(lane, F.col("seq").cast("long").alias("seq"), "owner_id", "group_id", "kind", F.col("items").cast("long").alias("items"))
    kind = dict(jobs.dtypes)[lane]
    return slim.repartition(lane).sortWithinPartitions(lane, "seq").mapInArrow(run, f"{lane} {kind}, first bigint, last bigint, owner_id string, group_id string, items bigint")


def _batches(done: list[list], lane: str, of: pa.DataType) -> pa.RecordBatch:
    kinds = {0: of, 1: pa.int64(), 2: pa.int64(), 3: pa.string(), 4: pa.string(), 6: pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in kinds.items()], [lane, "first", "last", "owner_id", "group_id", "items"])


def valid(log: DataFrame) -> DataFrame:
    """Records before the first corrupt one."""
    bad = log.where("corrupt").agg(F.min("seq").alias("__bad"))
    return log.crossJoin(F.broadcast(bad)).where("__bad IS NULL OR seq < __bad").drop("__bad")


def committed(log: DataFrame) -> DataFrame:
    """Valid records up to the last commit; what follows it never happened."""
    ok = valid(log)
    last = ok.where("op = 'commit'").agg(F.max("seq").alias("__last"))
    return ok.crossJoin(F.broadcast(last)).where("seq <= __last").drop("__last")


def replay(log: DataFrame, after: int = -1) -> DataFrame:
    """(document_id, registered, retrievals, sentiment, earned, last_retrieved) from valid records behind a checkpoint.

    Counters are additive, so a record counts only if it is behind the checkpoint; repeated sequence numbers count once.
    """
    r = valid(log).where(F.col("seq") > after).dropDuplicates(["seq"])
    op = lambda name: F.col("op") == name
    return r.where("op <> 'commit'").groupBy("document_id").agg(
        F.bool_or(op("registered")).alias("registered"),
        F.count_if(op("performance")).alias("retrievals"),
        F.sum(F.when(op("performance"), F.col("value")).otherwise(0.0)).alias("sentiment"),
        F.sum(F.when(op("earnings") & (F.col("value") > 0), F.col("value")).otherwise(0.0)).alias("earned"),
        F.max_by("ts", F.when(op("performance") & F.col("ts").isNotNull(), F.col("seq"))).alias("last_retrieved"),
    )
