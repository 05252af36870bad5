"""Vector expressions. All compute in double over arrays of float."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SUBVECTORS = 16


def _total(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences over the shorter length; null if either is null."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return _total(pairs, lambda x: x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lambda x: x)


def tag_distance(a: Column, b: Column) -> Column:
    """1 - dot; null without tags on either side or where lengths differ."""
    return F.when(F.size(a) == F.size(b), 1 - dot(a, b))


def subvector(v: Column, i: Column | int, width: int) -> Column:
    """The i-th chunk of ``width`` values, from 0."""
    return F.slice(v, F.lit(i) * width + 1, width)


def subvectors(v: Column, width: int, count: int = SUBVECTORS) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.slice(v, i * width + 1, width))


def threshold_norm(raw: Column, threshold: Column) -> Column:
    """Distance relative to a shard's threshold if that is finite and positive, else as it is."""
    return F.when((threshold > 0) & (threshold < F.lit(float("inf"))), raw / threshold).otherwise(raw)


def adjustment_factor(original: Column, adjusted: Column) -> Column:
    return F.when(original > 0, adjusted / original).otherwise(F.lit(1.0))


def adjustment_status(original: Column, adjusted: Column, threshold: Column) -> Column:
    f = adjustment_factor(original, adjusted)
    return F.when(adjusted >= threshold, "dropped").when(f < 0.98, "boosted").when(f > 1.02, "demoted").otherwise("unchanged")


def average_sentiment(total: Column, count: Column) -> Column:
    """Mean, with a prior of a half where nothing was counted."""
    return F.when(count > 0, total / count).otherwise(F.lit(0.5))


def level_cap(n: Column, m: int = 16) -> Column:
    return F.greatest(F.lit(1), F.floor(F.ln(F.greatest(n, F.lit(2))) / F.ln(F.lit(m))) + 2)


def hashed_level(key: Column, n: Column, m: int = 16) -> Column:
    """A level drawn from the first 32 bits of the key's MD5: floor(-ln U / ln M), capped by the number of nodes."""
    u = (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967297.0)
    return F.least(F.floor(-F.ln(u) / F.ln(F.lit(m))), level_cap(n, m)).cast("int")


def codebook_size(n: Column) -> Column:
    """The largest power of two not above n / 39, within 2 and 65536."""
    return F.when(n < 78, F.lit(2)).otherwise(F.least(F.lit(65536), F.pow(F.lit(2.0), F.floor(F.log2(F.floor(n / 39)))).cast("int"))).cast("int")


@functools.cache
def vector_digest() -> Callable[..., Column]:
    """partition identifier of (embedding, document_id): SHA-256 of the little-endian float32 values and the identifier, each byte in decimal, two digits at least."""
    import hashlib

    @F.pandas_udf(StringType())
    def digest(v: pd.Series, doc: pd.Series) -> pd.Series:
        def one(x, d):
            if x is None:
                return None
            raw = np.asarray(x, "<f4").tobytes() + ("" if d is None else d).encode()
            return "".join(f"{b:02d}" for b in hashlib.sha256(raw).digest())

        return pd.Series([one(x, d) for x, d in zip(v, doc, strict=True)])

    return digest
