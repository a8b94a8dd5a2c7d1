"""Repeatable pseudo-random integers from a digest of their inputs.

The numbers depend on the inputs alone, not on partitioning, so a lost task that runs
again draws what it drew before, and any engine with MD5 draws the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

HEX_DIGITS = 15


def draw(seed: int, *parts: Column) -> Column:
    """Integer in [0, 2**60)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("long")


ORDER_CHUNK = 2**40  # a million chunks of the range, which the helpers cut into chunks again


MIXERS = (6364136223846793005, 2862933555777941757, 3202034522624059733, 4354685564936845319)
MASK = (1 << 64) - 1


def mixed(seed: int, *parts: np.ndarray) -> np.ndarray:
    """A number below 2^63 for every place of the (broadcast) integer arrays: their sum of multiples
    modulo 2^64, with the high half folded onto the low one and multiplied, twice."""
    z = np.uint64(seed)
    with np.errstate(over="ignore"):
        for factor, part in zip(MIXERS, parts):
            z = z + part.astype(np.uint64) * np.uint64(factor)
        for factor in MIXERS[:2]:
            z = (z ^ (z >> np.uint64(32))) * np.uint64(factor)
    return z >> np.uint64(1)


def mixed_sql(seed: int, *parts: str) -> str:
    """``mixed`` in SQL with 128-bit integers."""
    z = " + ".join([f"{seed}", *[f"({p})::HUGEINT * {f} % {MASK + 1}" for f, p in zip(MIXERS, parts)]])
    z = f"(({z}) % {MASK + 1})"
    for factor in MIXERS[:2]:
        z = f"(xor({z}, {z} >> 32) * {factor} % {MASK + 1})"
    return f"({z} >> 1)::BIGINT"


ROUNDS = 4


def scattered(position: np.ndarray, size: np.ndarray, seed: int, which: np.ndarray) -> np.ndarray:
    """A pseudo-random permutation of 0 .. size-1 for every ``which``: where each position goes.

    A Feistel network over the next even number of bits; places beyond the size are walked
    through the network again until they fall inside.
    """
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2, 1)
    mask, out = (np.int64(1) << half) - 1, position.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, w = half[todo], mask[todo], which[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(ROUNDS):
            left, right = right, left ^ (mixed(seed, right, np.full(len(todo), turn), w).astype(np.int64) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= size[todo]]
    return out


def half_bits_sql(size: str) -> str:
    """Half the bits of the network for a size, at least 1."""
    return f"greatest((ceil(log2(greatest({size}, 2)))::BIGINT + 1) // 2, 1)"


def scattered_sql(seed: int, place: str, half: str, which: str) -> str:
    """One walk through the network (to be repeated while the result is not below the size)."""
    left, right = f"({place} >> {half})", f"({place} & ((1::BIGINT << {half}) - 1))"
    body = f"[{left}, {right}]"
    for turn in range(ROUNDS):
        mix = mixed_sql(seed, "s[2]", str(turn), which)
        body = (f"list_transform([{body}], lambda s: [s[2], xor(s[1], {mix} & ((1::BIGINT << {half}) - 1))])[1]")
    return f"list_transform([{body}], lambda s: s[1] << {half} | s[2])[1]"
