"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util
from .mixing import tokens

#: Permitted sequence lengths, the cost of opening any bin, and the tokens that are packed together.
CAPACITIES = (512, 1024, 2048, 4096)
OPEN_COST = 64
GROUP_TOKENS = 4_000_000

_BINS = "group int, bin int, capacity int, used int, doc_ids array<bigint>, starts array<bigint>, lengths array<int>"


def cost(capacity: int, largest: int, open_cost: int = OPEN_COST) -> float:
    """What training on one sequence of this length costs: its tokens, the attention among them, and a fixed part."""
    return capacity * (1 + capacity / (2 * largest)) + open_cost


class Packer:
    """Variable-capacity best fit over pieces that come longest first.

    ``room[r]`` holds the open bins with r tokens left; a bit mask of the r that
    have bins finds the fullest bin that still fits in one step; of equally full
    ones the one used last is taken. Where none fits, all permitted lengths are
    weighed against each other: each is filled, on paper, with the longest pieces
    still to come that fit, cut down to what that leaves it with, and priced at
    its cost over the tokens it then holds. The cheapest is opened, of equal ones
    the shorter. So a long bin is opened where short ones would stay half empty,
    and a short one where nothing is left to fill a long one. At the end each
    bin is cut down to the smallest permitted length that holds its contents.
    """

    def __init__(self, capacities=CAPACITIES, open_cost: int = OPEN_COST):
        self.caps = sorted(set(capacities))
        self.cost = {c: cost(c, self.caps[-1], open_cost) for c in self.caps}

    def least(self, used: int) -> int:
        return next(c for c in self.caps if c >= used)

    def filled(self, capacity: int, length: int, left: dict[int, int], lengths: int) -> int:
        """Tokens in a bin of this capacity that begins with a piece and takes the longest of those left while any fits."""
        used = length
        while True:
            fit = lengths & ((1 << (capacity - used + 1)) - 1)
            if not fit:
                return used
            n = fit.bit_length() - 1
            used += n * min(left[n], (capacity - used) // n)
            lengths &= (1 << n) - 1  # only shorter ones from here on

    def opened(self, length: int, left: dict[int, int], lengths: int) -> int:
        """The permitted length to open for a piece; left: how many pieces there are of each length, lengths: a bit for each of those."""
        prices = []
        for c in self.caps:
            if c >= length:
                used = self.filled(c, length, left, lengths)
                prices.append((self.cost[self.least(used)] / used, c))
        return min(prices)[1]

    def pack(self, pieces: list[tuple[int, int | None, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """[(capacity, pieces)]; a piece is (length, doc_id, start)."""
        pieces = sorted(pieces, key=lambda p: (-p[0], p[1] is not None, p[1] or 0, p[2]))
        left = Counter(p[0] for p in pieces)
        lengths = sum(1 << n for n in left)
        room: dict[int, list[int]] = {}
        mask = 0
        bins: list[list[tuple[int, int, int]]] = []
        for piece in pieces:
            n = piece[0]
            left[n] -= 1
            if not left[n]:
                lengths ^= 1 << n
            above = mask >> n
            if above:
                r = n + ((above & -above).bit_length() - 1)
                stack = room[r]
                b = stack.pop()
                if not stack:
                    mask ^= 1 << r
            else:
                r = self.opened(n, left, lengths)
                b = len(bins)
                bins.append([])
            bins[b].append(piece)
            r -= n
            if r:
                if not mask >> r & 1:
                    mask |= 1 << r
                    room[r] = []
                room[r].append(b)
        return [(self.least(sum(p[0] for p in b)), b) for b in bins]


def _packed(batches, capacities, open_cost):
    packer = Packer(capacities, open_cost)
    top = max(capacities)
    for rows in util.runs_of(batches, "group"):
        pieces = []
        for i, n in zip(rows.column("doc_id").to_pylist(), rows.column("tokens").to_pylist(), strict=True):
            pieces += [(min(top, n - at), i, at) for at in range(0, n, top)]
        bins = packer.pack(pieces)
        if not bins:
            continue
        group = rows.column("group")[0].as_py()
        columns = (
            pa.array([group] * len(bins), pa.int32()),
            pa.array(range(len(bins)), pa.int32()),
            pa.array([c for c, _ in bins], pa.int32()),
            pa.array([sum(p[0] for p in b) for _, b in bins], pa.int32()),
            pa.array([[p[1] for p in b] for _, b in bins], pa.list_(pa.int64())),
            pa.array([[p[2] for p in b] for _, b in bins], pa.list_(pa.int64())),
            pa.array([[p[0] for p in b] for _, b in bins], pa.list_(pa.int32())),
        )
        yield pa.RecordBatch.from_arrays(list(columns), ["group", "bin", "capacity", "used", "doc_ids", "starts", "lengths"])


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, open_cost: int = OPEN_COST, group_tokens: int = GROUP_TOKENS, unnamed: bool = False) -> DataFrame:
    """One row for each sequence: its length, the tokens used, and the pieces (doc_ids, starts, lengths) in it.

    A token is a word between white space. A document longer than the largest
    capacity is cut into pieces of that many tokens and a rest. Documents are
    spread by a hash of their identifier over groups of about group_tokens, each
    packed on its own, so the result depends on the rows and not on how they
    are stored. Pieces of equal length go by identifier and place, a null one first (see Packer for other ties). Null and empty texts have nothing to pack and are left out.
    Documents with a null identifier are packed only if unnamed, with a null in
    doc_ids and spread by a hash of their text, and left out otherwise; repeated rows are packed as often as they come; an empty
    table gives no rows; other columns, whatever their names, are not looked at.
    """
    i = F.col("doc_id").cast("long")
    home = F.when(i.isNull(), F.xxhash64(F.lit("pack"), "text")).otherwise(F.xxhash64(F.lit("pack"), i))
    slim = docs.select(i.alias("doc_id"), tokens(F.col("text")).alias("tokens"), home.alias("home"))
    slim = util.spool(slim.where("tokens > 0" if unnamed else "tokens > 0 AND doc_id IS NOT NULL"), "lengths")
    total = slim.agg(F.sum("tokens")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    spread = slim.withColumn("group", F.pmod("home", F.lit(groups)).cast("int")).drop("home")
    n = min(util.parts(docs.sparkSession), groups)
    sent = spread.repartition(n, "group").sortWithinPartitions("group")
    return sent.mapInArrow(lambda b: _packed(b, capacities, open_cost), _BINS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(util.table(spark, sf_dir, "documents"), unnamed=True)
