"""Incremental ingest: the write queue as a stream of micro-batches with one writer."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions import misc
from lodestar.operators.registry import Registry
from lodestar.plans.service import Service
from lodestar.sources.store import Store, spooled


def put_stream(inputs: DataFrame, store: Store, owner: str, checkpoint: str, name: str = "index", trigger: dict | None = None, group_id: str | None = None, fold_at: int = 20) -> StreamingQuery:
    """Index each micro-batch of (doc_id, text) through the gate and registry of a service.

    A batch is one version of the store: its new partitions are appended as a
    segment, with the number of the batch as their generation, and registry tables
    are written with it. A document's newest generation counts, so a batch that is
    run again after a failure changes nothing, and nothing that is there is rewritten.
    When there are fold_at segments they are folded into one. Read with current().
    """

    def batch(df: DataFrame, number: int) -> None:
        put_batch(df, store, owner, name, number, group_id, fold_at)

    return inputs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def put_batch(df: DataFrame, store: Store, owner: str, name: str, number: int, group_id: str | None = None, fold_at: int = 20) -> None:
    """One micro-batch of put_stream()."""
    spark = df.sparkSession
    was = state(store, name)
    service = Service(was[0], was[1]) if was else Service.empty(spark)
    after, _ = service.ingest(spooled(df), owner, group_id)
    fresh = after.fresh.withColumn("generation", F.lit(number).cast("long"))
    r = after.registry
    tables = {"owner_document": r.owner_document, "document_group": r.document_group, "groups": r.groups, "document_access": r.document_access}
    store.extend(name, {"index": fresh}, tables)
    segments = store.segment_count(name, "index")
    if segments >= fold_at:
        store.extend(name, {}, {"index": _newest(store.restore_together(name, ("index",))["index"])})
    store.keep(name, 2)


def _newest(index: DataFrame) -> DataFrame:
    """Of each document the partitions of its newest generation."""
    last = index.groupBy("document_id").agg(F.max("generation").alias("generation"))
    return index.join(last, ["document_id", "generation"], "left_semi").dropDuplicates(["document_id", "partition_id", "pos"])


def state(store: Store, name: str = "index") -> tuple[Registry, DataFrame] | None:
    """(registry, index) as of the newest version."""
    got = store.restore_together(name, ("index", "owner_document", "document_group", "groups", "document_access"))
    if got is None:
        return None
    index = got.pop("index")
    return Registry(**got), _newest(index).drop("generation")


def current(store: Store, name: str = "index") -> DataFrame | None:
    got = state(store, name)
    return None if got is None else got[1]


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value): tumbling windows over event time with a watermark; rows later than that are dropped."""
    w = F.window("ts", width)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def resumed(start, sink: Store, name: str, tries: int = 3) -> StreamingQuery:
    """Run start() until it ends; a query that fails begins again from its checkpoint, a few times, and each failure is kept as a row (try, error) of ``name``."""
    for n in range(tries):
        query = start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException as e:
            spark = sink.spark
            sink.append(name, spark.createDataFrame([(n, str(e)[:1000])], "try int, error string"))
            if n == tries - 1:
                raise
    return query


def recovered(rows: DataFrame, value, fallback, column: str) -> DataFrame:
    """rows with ``column``: value, and where that is null, as try_ functions leave it on an error, fallback."""
    return rows.withColumn(column, F.coalesce(value, fallback))


def requests(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Requests as a stream: JSON lines that appear in a folder, with their defaults."""
    raw = spark.readStream.format("text").load(path)
    return raw.select(misc.parse_request(F.col("value")).alias("r")).select("r.*") if schema is None else raw.select(F.from_json("value", schema).alias("r")).select("r.*")
