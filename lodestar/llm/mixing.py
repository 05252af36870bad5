"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import util

#: Tokens in a block, documents to a shard of the corpus, seed of the order of documents and of the choice of blocks.
BLOCK_TOKENS = 4096
SHARD_DOCS = 20_000
SEED = 20240229
#: Target weights by source, and the weight of those that aren't named. No table of the corpus gives any: these are placeholders to be set.
TARGET_WEIGHTS: dict[str, int] = {"src0": 3, "src1": 2, "src2": 2}
TARGET_DEFAULT = 1
#: Percent of the corpus's blocks that the mix is to have: what goes is this much at any size, and from sources above their target.
BUDGET_PERCENT = 90


def tokens(text: Column) -> Column:
    """Words between white space; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _weight(weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in sorted(weights.items()):
        out = F.when(F.col("source") == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def mark(docs: DataFrame) -> Column:
    """Tells rows apart beside their identifier: by text, and by whether they have an identifier at all."""
    return F.xxhash64(F.lit("mix"), F.col("doc_id").isNull(), F.col("text").cast("string"))


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """(doc_id, mark, source, tokens, shard, block): each shard of a source is laid out in a seeded order and cut every block_tokens tokens.

    There is a shard for every shard_docs documents of the corpus, so that no
    source's part of one has more than about that many, whatever the size. A
    document belongs to the block in which its first token lies.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark(docs).alias("mark"), F.coalesce(F.col("source"), F.lit("")).alias("source"), tokens(F.col("text")).alias("tokens"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = util.spool(d.withColumn("key", key), "tokens")
    shards = max(1, -(-d.count() // shard_docs))
    d = d.withColumn("shard", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % shards).cast("int"))
    w = W.partitionBy("source", "shard").orderBy("key", "tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.sum("tokens").over(w) - F.col("tokens")
    return d.withColumn("block", F.floor(before / block_tokens).cast("long")).drop("key")


def supplies(laid: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, shard, blocks): blocks that the tokens of a shard fill, the last one perhaps in part; one where it has none."""
    return laid.groupBy("source", "shard").agg(F.greatest(F.lit(1), F.ceil(F.sum("tokens") / block_tokens)).cast("long").alias("blocks"))


def apportion(names: list[str], supply: np.ndarray, weight: np.ndarray, budget: int) -> np.ndarray:
    """Seats each source wins of ``budget``, by highest quotient weight / (2k + 1), a tie to the first by name.

    A source that has no more blocks drops out and the others go on, so all
    seats are filled while any source of positive weight has a block. A
    bisection finds the quotient of the last seat; only seats about it are ranked.
    """
    supply = np.where(weight > 0, supply, 0).astype(np.int64)
    weight = np.where(weight > 0, weight, 1).astype(np.float64)
    if supply.sum() <= budget:
        return supply

    def above(q: float) -> np.ndarray:
        return np.minimum(supply, np.floor(np.minimum(weight / q + 1, 2.0**62) / 2).astype(np.int64))

    low, high = weight.min() / (4 * float(supply.max()) + 4), 2 * weight.max()
    while (mid := (low + high) / 2) not in (low, high):
        if above(mid).sum() >= budget:
            low = mid
        else:
            high = mid
    won, more = above(high * (1 + 1e-9)), above(low * (1 - 1e-9))
    near = np.flatnonzero(more > won)
    seats = [(-weight[i] / (2 * k + 1), names[i].encode(), i) for i in near.tolist() for k in range(won[i], more[i])]
    for _, _, i in sorted(seats)[: budget - int(won.sum())]:
        won[i] += 1
    return won


def _apportion(batches, percent: int):
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        supply = t.column("supply").to_numpy()
        won = apportion(t.column("source").to_pylist(), supply, t.column("weight").to_numpy(), -(-int(supply.sum()) * percent // 100))
        yield pa.RecordBatch.from_arrays([t.column("source").combine_chunks(), pa.array(won, pa.int64())], ["source", "won"])


def quotas(supply: DataFrame, weights: dict[str, int], default: int = TARGET_DEFAULT, percent: int = BUDGET_PERCENT) -> DataFrame:
    """(source, shard, quota): blocks each shard of each source gives, of supply (source, shard, blocks).

    weights are integers by source, with a default for those that aren't named.
    There are percent of all blocks to give, rounded up, so that a small corpus keeps something. First over sources:
    seats go by highest quotient weight / (2k + 1), a tie to the source first by
    name; a source that runs out drops out and the others go on. A source of
    weight 0 gives none. Then within a source by the same rule over its shards,
    weighted by the blocks they have, which never asks a shard for more than that:
    of n shards one gets its proportional share to within n / 2 times its part,
    and one for rounding, so only seats about that place are ranked.
    """
    per = supply.groupBy("source").agg(F.sum("blocks").alias("supply")).withColumn("weight", _weight(weights, default))
    # one small row a source, in one task
    won = per.select("source", "supply", "weight").coalesce(1).mapInArrow(lambda b: _apportion(b, percent), "source string, won long")
    all_of = W.partitionBy("source")
    near = supply.join(won, "source").withColumn("total", F.sum("blocks").over(all_of)).withColumn("n", F.count(F.lit(1)).over(all_of))
    share = F.floor(F.col("won") * F.col("blocks") / F.col("total"))
    slack = F.ceil(F.col("n") * F.col("blocks") / (2 * F.col("total"))) + 2
    near = near.withColumn("sure", F.greatest(F.lit(0), share - slack).cast("long")).withColumn("last", F.least(F.col("blocks"), share + slack + 1).cast("long"))
    near = near.withColumn("open", F.col("won") - F.sum("sure").over(all_of))
    seat = near.withColumn("k", F.explode(F.filter(F.sequence("sure", "last"), lambda k: k < F.col("last"))))
    rank = F.row_number().over(all_of.orderBy(F.desc(F.col("blocks") / (2 * F.col("k") + 1)), "shard"))
    given = seat.withColumn("rank", rank).where(F.col("rank") <= F.col("open")).groupBy("source", "shard").agg(F.count(F.lit(1)).alias("more"))
    both = near.join(given, ["source", "shard"], "left").withColumn("quota", F.col("sure") + F.coalesce("more", F.lit(0)))
    return both.where("quota > 0").select("source", "shard", "quota")


def _mixed(docs: DataFrame, weights: dict[str, int], default: int, block_tokens: int, shard_docs: int, seed: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(all rows with their blocks, the chosen blocks)"""
    laid = util.spool(blocks(docs, block_tokens, shard_docs, seed), "mix")
    supply = util.spool(supplies(laid, block_tokens), "supply")
    # a document without tokens behind the last one that has any goes with the last block
    laid = laid.join(supply, ["source", "shard"]).withColumn("block", F.least("block", F.col("blocks") - 1)).drop("blocks")
    quota = quotas(supply, weights, default, percent)
    have = supply.select("source", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "source", F.col("shard").cast("string"), F.col("block").cast("string")))
    rank = F.row_number().over(W.partitionBy("source", "shard").orderBy(key, "block"))
    chosen = have.withColumn("rank", rank).join(quota, ["source", "shard"]).where(F.col("rank") <= F.col("quota")).select("source", "shard", "block")
    return laid, chosen


def mix(
    docs: DataFrame,
    weights: dict[str, int] = TARGET_WEIGHTS,
    default: int = TARGET_DEFAULT,
    block_tokens: int = BLOCK_TOKENS,
    shard_docs: int = SHARD_DOCS,
    seed: int = SEED,
    percent: int = BUDGET_PERCENT,
) -> DataFrame:
    """(doc_id, source, tokens, shard, block) of the documents in the chosen blocks.

    A block in which no document begins, because a long one runs through it, is
    chosen like any other and gives no rows, so that a source keeps the part of
    its tokens that its seats are of its blocks, to within chance; this is how
    very long documents count. percent of the corpus's blocks are taken; a
    source that runs out leaves its seats to the others.

    A null source counts as the source ''; null and empty texts have no tokens
    and go with the block where they lie; null identifiers are one position of
    the order; repeated rows are rows of their own, in an order among themselves
    that decides nothing but the block; ties of quotients go by name and by shard. An empty table gives no rows;
    other columns, whatever their names, are not looked at.
    """
    laid, chosen = _mixed(docs, weights, default, block_tokens, shard_docs, seed, percent)
    return laid.join(chosen, ["source", "shard", "block"], "left_semi").select("doc_id", "source", "tokens", "shard", "block")


def shares(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """(source, tokens, kept, share): tokens of each source in docs and those of them in mixed, which mix() returned."""
    have = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("source")).agg(F.sum(tokens(F.col("text"))).alias("tokens"))
    kept = mixed.groupBy("source").agg(F.sum("tokens").alias("kept"))
    out = have.join(kept, "source", "left").select("source", "tokens", F.coalesce("kept", F.lit(0)).alias("kept"))
    return out.withColumn("share", F.when(F.col("tokens") > 0, F.col("kept") / F.col("tokens")))


def mixed_documents(
    docs: DataFrame,
    weights: dict[str, int] = TARGET_WEIGHTS,
    default: int = TARGET_DEFAULT,
    block_tokens: int = BLOCK_TOKENS,
    shard_docs: int = SHARD_DOCS,
    seed: int = SEED,
    percent: int = BUDGET_PERCENT,
) -> DataFrame:
    """The rows of docs that mix() chooses, with all their columns.

    Rows are told apart by identifier and text, null ones as any other; of rows
    equal in both all stay if one is chosen. Other cases are as mix() has them.
    """
    laid, chosen = _mixed(docs, weights, default, block_tokens, shard_docs, seed, percent)
    row = [F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("mark").alias("__mark")]
    hit = laid.join(chosen.withColumn("hit", F.lit(True)), ["source", "shard", "block"], "left")
    drop = hit.groupBy(*row).agg(F.max("hit").alias("hit")).where("hit IS NULL").drop("hit")
    both = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("__mark", mark(docs))
    return util.without(both, util.spool(drop, "unmixed"), ["__id", "__mark"]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(util.table(spark, sf_dir, "documents"))


def sql(weights: dict[str, int] = TARGET_WEIGHTS, default: int = TARGET_DEFAULT, block_tokens: int = BLOCK_TOKENS, shard_docs: int = SHARD_DOCS, seed: int = SEED, percent: int = BUDGET_PERCENT) -> str:
    """mix() in SQL: every seat of every source and shard is listed and ranked."""
    weight = " ".join(f"WHEN '{s}' THEN {w}" for s, w in sorted(weights.items()))
    weight = f"CASE source {weight} ELSE {default} END" if weight else str(default)
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '\\S+')), 0) AS tokens,
       md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT *, (('0x' || key[1:8])::BIGINT % greatest(1, ceil((SELECT count(*) FROM documents) / {shard_docs})::BIGINT))::INTEGER AS shard FROM d),
placed AS (SELECT doc_id, source, tokens, shard,
       ((sum(tokens) OVER (PARTITION BY source, shard ORDER BY key, tokens ROWS UNBOUNDED PRECEDING) - tokens) // {block_tokens})::BIGINT AS block FROM s),
supply AS (SELECT source, shard, greatest(1, ceil(sum(tokens) / {block_tokens}))::BIGINT AS blocks FROM placed GROUP BY ALL),
laid AS (SELECT doc_id, source, tokens, shard, least(block, blocks - 1) AS block FROM placed JOIN supply USING (source, shard)),
per AS (SELECT source, sum(blocks)::BIGINT AS supply, {weight} AS weight FROM supply GROUP BY source),
seat AS (SELECT source, row_number() OVER (ORDER BY weight / (2 * k + 1) DESC, source) AS r FROM (SELECT *, unnest(range(0, supply)) AS k FROM per WHERE weight > 0)),
won AS (SELECT source, count(*) AS won FROM seat WHERE r <= (SELECT (sum(supply)::BIGINT * {percent} + 99) // 100 FROM per) GROUP BY source),
inner_seat AS (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY blocks / (2 * k + 1) DESC, shard) AS r
       FROM (SELECT *, unnest(range(0, blocks)) AS k FROM supply)),
quota AS (SELECT source, shard, count(*) AS quota FROM inner_seat JOIN won USING (source) WHERE r <= won GROUP BY ALL),
pick AS (SELECT *, row_number() OVER (PARTITION BY source, shard ORDER BY md5('{seed}:' || source || ':' || shard || ':' || block), block) AS r
       FROM (SELECT source, shard, unnest(range(0, blocks)) AS block FROM supply)),
chosen AS (SELECT source, shard, block FROM pick JOIN quota USING (source, shard) WHERE r <= quota)
SELECT doc_id, source, tokens, shard, block FROM laid SEMI JOIN chosen USING (source, shard, block)
"""


SQL = sql()
