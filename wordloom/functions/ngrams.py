"""Character n-grams and their hashes as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

# FNV-1a of 64 and of 32 bits.
OFFSET_64, PRIME_64 = 0xCBF29CE484222325, 0x100000001B3
OFFSET_32, PRIME_32 = 2166136261, 16777619


def bracket(word: Column, bow: str = "<", eow: str = ">") -> Column:
    return F.concat(F.lit(bow), word, F.lit(eow))


def check_lengths(min_n: int, max_n: int) -> None:
    if min_n < 1:
        raise ValueError("the least n-gram length is 1")
    if min_n > max_n:
        raise ValueError("the least n-gram length is above the largest")


def ngrams(text: Column, min_n: int, max_n: int) -> Column:
    """Every substring of min_n to max_n code points, repeats kept; empty for shorter texts."""
    check_lengths(min_n, max_n)
    length = F.char_length(text)
    made = F.flatten(
        F.transform(
            F.sequence(F.lit(1), length - min_n + 1),
            lambda i: F.transform(
                F.sequence(F.lit(min_n), F.least(F.lit(max_n), length - i + 1)), lambda n: F.substring(text, i, n)
            ),
        )
    )
    return F.when(length >= min_n, made).when(length.isNotNull(), F.array().cast("array<string>"))


def code_points(text: Column) -> Column:
    """The code points of a text, as BIGINT."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.ascii(c).cast("long"))


def fnv_low_bits(text: Column, bits: int) -> Column:
    """Low bits of FNV-1a (64) over the length, as 8 bytes, and the code points, as 4 each.

    Exclusive or and multiplication keep to the low bits, so up to 31 bits nothing overflows
    BIGINT; beyond, the hash is made in Arrow batches.  All 64 bits are a DECIMAL(20, 0).
    """
    if not 0 <= bits <= 64:
        raise ValueError("the bucket exponent must be from 0 to 64")
    if bits == 64:
        high = _fnv_wide(text, F.lit(64))
        wide = high.cast("decimal(20,0)")
        return F.when(high < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")
    if bits > 31:
        return _fnv_wide(text, F.lit(bits))
    size = 1 << bits
    prime = PRIME_64 % size

    def step(h: Column, byte: Column) -> Column:
        return (h.bitwiseXOR(byte) * F.lit(prime).cast("long")) % F.lit(size).cast("long")

    def word(h: Column, value: Column, count: int) -> Column:
        for k in range(count):
            h = step(h, F.shiftright(value, 8 * k).bitwiseAND(F.lit(255).cast("long")))
        return h

    length = F.char_length(text).cast("long")
    begin = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(56), F.lit(8)), lambda s: F.call_function("shiftright", length, s).bitwiseAND(F.lit(255).cast("long"))),
        F.lit(OFFSET_64 % size).cast("long"),
        step,
    )
    return F.aggregate(code_points(text), begin, lambda h, c: word(h, c, 4))


@F.pandas_udf(LongType())
def _fnv_wide(text: pd.Series, bits: pd.Series) -> pd.Series:
    known = text.notna().to_numpy()
    values = text[known].tolist()
    size = np.array([len(x) for x in values], np.int64)
    points = np.zeros((len(values), int(size.max(initial=0))), np.uint64)
    flat = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(values)), size)
    points[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    h = np.full(len(values), OFFSET_64, np.uint64)
    for k in range(8):
        h = (h ^ (size.astype(np.uint64) >> np.uint64(8 * k) & np.uint64(255))) * np.uint64(PRIME_64)
    for place in range(points.shape[1]):
        here = np.flatnonzero(size > place)
        part = h[here]
        for k in range(4):
            part = (part ^ (points[here, place] >> np.uint64(8 * k) & np.uint64(255))) * np.uint64(PRIME_64)
        h[here] = part
    low = int(bits.iloc[0]) if len(bits) else 0
    mask = np.uint64((1 << low) - 1)
    out = pd.Series([None] * len(text), index=text.index, dtype="Int64")
    out[known] = (h & mask).view(np.int64)
    return out


def fasttext_hash(text: Column) -> Column:
    """FNV-1a (32) over the UTF-8 bytes, each taken as a signed byte."""

    def step(h: Column, byte: Column) -> Column:
        wide = F.when(byte > 127, byte.bitwiseOR(F.lit(0xFFFFFF00).cast("long"))).otherwise(byte)
        return (h.bitwiseXOR(wide) * F.lit(PRIME_32).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))

    return F.aggregate(utf8_bytes(text), F.lit(OFFSET_32).cast("long"), step)


def utf8_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text, as BIGINT."""
    tail = lambda c, shift: F.shiftright(c, shift).bitwiseAND(F.lit(63).cast("long")) + 128
    return F.flatten(
        F.transform(
            code_points(text),
            lambda c: F.when(c < 0x80, F.array(c))
            .when(c < 0x800, F.array(F.shiftright(c, 6) + 0xC0, tail(c, 0)))
            .when(c < 0x10000, F.array(F.shiftright(c, 12) + 0xE0, tail(c, 6), tail(c, 0)))
            .otherwise(F.array(F.shiftright(c, 18) + 0xF0, tail(c, 12), tail(c, 6), tail(c, 0))),
        )
    )


def fasttext_bucket(text: Column, buckets: int) -> Column:
    if not 0 < buckets < 1 << 31:
        raise ValueError("the number of buckets must be positive and fit 31 bits")
    return fasttext_hash(text) % F.lit(buckets).cast("long")


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _fmix(k: np.ndarray) -> np.ndarray:
    # The finaliser of MurmurHash3.
    k = (k ^ (k >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    k = (k ^ (k >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return k ^ (k >> np.uint64(33))


def murmur3_128(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of MurmurHash3 x64-128 of many byte strings at once."""
    size = np.array([len(t) for t in texts], np.int64)
    blocks = int(size.max(initial=0)) // 16 + 1
    padded = np.frombuffer(b"".join(t.ljust(16 * blocks, b"\0") for t in texts), "<u8").reshape(len(texts), 2 * blocks)
    # The multipliers and additions of MurmurHash3.
    c1, c2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
    h1 = np.full(len(texts), seed, np.uint64)
    h2 = h1.copy()
    for b in range(blocks):
        k1 = _rotl(padded[:, 2 * b] * c1, 31) * c2
        k2 = _rotl(padded[:, 2 * b + 1] * c2, 33) * c1
        full, part = size >= 16 * (b + 1), (size > 16 * b) & (size < 16 * (b + 1))
        m1 = (_rotl(h1 ^ k1, 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
        m2 = (_rotl(h2 ^ k2, 31) + m1) * np.uint64(5) + np.uint64(0x38495AB5)
        # The last, short block is padded with zeros, which add nothing.
        h1, h2 = np.where(full, m1, np.where(part, h1 ^ k1, h1)), np.where(full, m2, np.where(part, h2 ^ k2, h2))
    length = size.astype(np.uint64)
    h1, h2 = h1 ^ length, h2 ^ length
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = _fmix(h1), _fmix(h2)
    h1 = h1 + h2
    return h1, h2 + h1


def floret_buckets(text: Column, buckets: int, hashes: int, seed: int) -> Column:
    """The buckets of a text: one for each of the first ``hashes`` quarters of its hash."""
    if not 1 <= hashes <= 4:
        raise ValueError("there must be one to four hashes")
    if buckets < 1:
        raise ValueError("there must be a bucket")

    @F.pandas_udf(ArrayType(LongType()))
    def quarters(values: pd.Series) -> pd.Series:
        known = values.notna()
        h1, h2 = murmur3_128([v.encode() for v in values[known]], seed)
        low = np.uint64(0xFFFFFFFF)
        parts = np.stack([h1 & low, h1 >> np.uint64(32), h2 & low, h2 >> np.uint64(32)], axis=1)[:, :hashes]
        out = pd.Series([None] * len(values), index=values.index, dtype=object)
        out[known] = pd.Series(list((parts % np.uint64(buckets)).astype(np.int64)), index=values.index[known], dtype=object)
        return out

    return quarters(text)
