"""Feature fingerprints (256 bits), residual vectors and similarities as Columns, from SHA-256 of each feature."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LANES, RESIDUAL = 16, 64


def hashes(features: Column) -> Column:
    """The hexadecimal hash of each feature, from which all else is cut."""
    return F.transform(features, lambda f: F.sha2(f, 256))


def hash_byte(hash_: Column, i: int) -> Column:
    return F.conv(F.substring(hash_, 2 * i + 1, 2), 16, 10).cast("int")


def bits(hashes_: Column) -> Column:
    """Sorted distinct bit numbers: bytes 0, 2, 4 and 6 of each hash."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hashes_, lambda h: F.array(*(hash_byte(h, i) for i in (0, 2, 4, 6)))))))


def lanes(bits_: Column) -> Column:
    """The fingerprint as 16 lanes of 16 bits; a lane is also an LSH band, and lane 0 the bucket."""
    one = lambda own, k: F.aggregate(F.filter(own, lambda b: F.floor(b / 16) == k), F.lit(0), lambda a, b: a + F.pow(F.lit(2.0), b % 16).cast("int"))
    every = lambda own: F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: one(own, k))
    return F.element_at(F.transform(F.array(bits_), every), 1)


def unrolled(a: Column, b: Column, n: int, each) -> Column:
    """Sum of each(a[i], b[i]): plain arithmetic, which stays in generated code."""
    parts = [each(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(n)]
    while len(parts) > 1:
        parts = [x + y for x, y in zip(parts[::2], parts[1::2])] + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0]


def hamming(a: Column, b: Column) -> Column:
    """Of two fingerprints in lanes."""
    return unrolled(a, b, LANES, lambda x, y: F.bit_count(x.bitwiseXOR(y)))


def residual(hashes_: Column) -> Column:
    """64 lanes of signed weights, clamped to int8. Lane byte0 % 64, plus if byte1 is even, weight 1 + byte2 % 3."""
    votes = F.transform(hashes_, lambda h: F.struct((hash_byte(h, 0) % RESIDUAL).alias("lane"), (F.when(hash_byte(h, 1) % 2 == 0, 1).otherwise(-1) * (1 + hash_byte(h, 2) % 3)).alias("w")))
    lane = lambda v: F.transform(F.sequence(F.lit(0), F.lit(RESIDUAL - 1)), lambda k: F.greatest(F.lit(-128), F.least(F.lit(127), F.aggregate(F.filter(v, lambda x: x["lane"] == k), F.lit(0), lambda s, x: s + x["w"]))))
    return F.element_at(F.transform(F.array(votes), lane), 1)


def residual_dot(a: Column, b: Column) -> Column:
    return unrolled(a, b, RESIDUAL, lambda x, y: x * y)


def dot(a: Column, b: Column, zero="int") -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast(zero), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for missing, empty, unequal or zero vectors."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    a, b = wide(a), wide(b)
    norm = F.sqrt(dot(a, a, "double")) * F.sqrt(dot(b, b, "double"))
    bad = a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (norm == 0)
    return F.when(bad, F.lit(0.0)).otherwise(dot(a, b, "double") / norm)


def planes(dim: int, count: int = 64) -> np.ndarray:
    """count hyperplanes of +-1, from one splitmix64 stream, row by row."""
    z = np.uint64(0x123456789ABCDEF0) + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, count * dim + 1, dtype=np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return np.where(z & np.uint64(1), 1.0, -1.0).reshape(count, dim)


def simhash_bands(vector: Column) -> Column:
    """Four 16-bit bands of the sign signature of a vector; null for null and empty ones."""

    @F.pandas_udf("array<int>")
    def bands(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), index=v.index, dtype=object)
        size = v.map(lambda x: 0 if x is None else len(x)).to_numpy()
        for dim in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == dim)
            sign = (np.stack(v.iloc[at].to_numpy()).astype(float) @ planes(dim).T >= 0).astype(np.int64)
            words = (sign.reshape(-1, 4, 16) << np.arange(16)).sum(axis=2).astype(np.int32)
            for i, w in zip(at.tolist(), words):
                out.iat[i] = w
        return out

    return bands(vector)


def near_keys(key: Column, flips: int) -> Column:
    """A band and all bands that differ from it in up to `flips` bits."""
    masks = [0]
    for _ in range(flips):
        masks = sorted({m ^ 1 << b for m in masks for b in range(16)} | set(masks))
    return F.transform(F.array(*map(F.lit, masks)), lambda m: key.bitwiseXOR(m))
