"""Hash families for MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus of both families.
PRIME = 2**31 - 1
# Multipliers and increments of the default family (of well-known linear congruential generators).
MULTIPLIERS = (1103515245, 69069, 1664525, 22695477)
INCREMENTS = (12345, 362437, 1013904223, 1)


def coefficients(p: int) -> list[tuple[int, int]]:
    """(a, b) of ``p`` hash functions x -> (a x + b) mod PRIME; beyond the fixed ones they follow from a generator."""
    if p < 1:
        raise ValueError("a signature has at least one hash function")
    rng = np.random.default_rng(20240229)
    more = zip(rng.integers(1, PRIME, max(0, p - 4)).tolist(), rng.integers(0, PRIME, max(0, p - 4)).tolist())
    return [*zip(MULTIPLIERS, INCREMENTS), *more][:p]


def md5_32(value: Column) -> Column:
    """The first 32 bits of the MD5 digest as a non-negative bigint; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint")


def affine(hashed: Column, a: int, b: int) -> Column:
    return (hashed * F.lit(a) + F.lit(b)) % F.lit(PRIME)


def shift_increments(k: int, seed: int) -> list[int]:
    """Increments of the shift family: draws below 2^31 - 1 of the 48-bit linear congruential generator of the JDK."""
    state, out = (seed ^ 0x5DEECE66D) & (1 << 48) - 1, []
    while len(out) < k:
        state = (state * 0x5DEECE66D + 0xB) & (1 << 48) - 1
        bits = state >> 17
        value = bits % PRIME
        if bits - value + PRIME - 1 < 1 << 31:
            out.append(value)
    return out


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint32(bits) | x >> np.uint32(32 - bits)


def murmur3_32(items: list[bytes], seed: int) -> np.ndarray:
    """MurmurHash3 x86 32-bit of each item as a signed int; word k of all items that have one is mixed at once."""
    sizes = np.fromiter(map(len, items), dtype=np.int64, count=len(items))
    order = np.argsort(-sizes, kind="stable")  # items that still have words come first
    words = -(-sizes[order] // 4)
    width = int(words.max(initial=0)) * 4
    held = np.zeros((len(items), width), dtype=np.uint8)
    held[np.arange(width) < sizes[order, None]] = np.frombuffer(b"".join(items[i] for i in order), dtype=np.uint8)
    grid = held.view("<u4")
    h = np.full(len(items), seed & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(width // 4):
        n = int(np.searchsorted(-words, -k, side="left"))
        whole = sizes[order[:n]] >= 4 * (k + 1)
        mixed = h[:n] ^ _rotated(grid[:n, k] * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h[:n] = np.where(whole, _rotated(mixed, 13) * np.uint32(5) + np.uint32(0xE6546B64), mixed)
    h ^= sizes[order].astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    out = np.empty(len(items), dtype=np.int32)
    out[order] = (h ^ h >> np.uint32(16)).view(np.int32)
    return out


#: Items that are hashed at once.
MOST_ITEMS = 1 << 16


def murmur3_signature(shingles: Column | str, p: int = 4, seed: int = 1) -> Column:
    """Signature of the shift family: minimum over the shingles of (murmur3 + b_i) with the sign of the dividend.

    An empty or null list has a null signature. All columns shift one hash, so the family is weak; it is kept for
    comparison with signatures made elsewhere.
    """
    increments = np.array(shift_increments(p, seed), dtype=np.int64)

    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lists = [[x.encode("utf-8") for x in set(items or ())] for items in batch.to_pylist()]
            every = [x for items in lists for x in items]
            hashed = np.concatenate([np.zeros(0, np.int32), *(murmur3_32(every[i : i + MOST_ITEMS], seed) for i in range(0, len(every), MOST_ITEMS))])
            out: list[list[int] | None] = []
            for own in np.split(hashed.astype(np.int64), np.cumsum([len(x) for x in lists])[:-1]):
                out.append(np.fmod(own[:, None] + increments, PRIME).min(axis=0).tolist() if len(own) else None)
            yield pa.array(out, pa.list_(pa.int64()))

    sign.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(sign, "array<bigint>")(shingles)
