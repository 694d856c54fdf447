"""Repeatable pseudo-random numbers derived from a row key."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

#: Poisson draws take 32 bits, so a digest of 128 bits holds four.
DRAWS_PER_DIGEST = 4


def poisson_cuts(bits: int = 32) -> list[int]:
    """round(2^bits * CDF) of the Poisson(1) law at 0, 1, ..., as far as the
    draws can tell the values apart: the whole tail, with no last value."""
    cuts, term, total = [], math.exp(-1.0), 0.0
    while True:
        total += term
        cut = round(total * 2**bits)
        if cut >= 2**bits or (cuts and cut == cuts[-1]):
            return cuts
        cuts.append(cut)
        term /= len(cuts)


def key_text(*cols: str | Column) -> Column:
    """Join the key columns into one text, null-safe."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in parts])


def uniform(key: Column, salt: Column | str | int = "") -> Column:
    """A uniform draw in [0, 1) from the leading 32 bits of an md5 digest."""
    salt = salt if isinstance(salt, Column) else F.lit(str(salt))
    digest = F.md5(F.concat_ws(":", key, salt.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def digests(key: Column, draws: int) -> Column:
    """One binary with 32 bits for each draw, from numbered md5 digests of the key."""
    blocks = (draws + DRAWS_PER_DIGEST - 1) // DRAWS_PER_DIGEST
    return F.concat(*[F.unhex(F.md5(F.concat_ws(":", key, F.lit(str(b))))) for b in range(blocks)])


def poisson_weights(drawn: list[bytes], draws: int) -> np.ndarray:
    """rows x draws: the Poisson(1) weights of rows' digests."""
    bits = np.frombuffer(b"".join(drawn), ">u4").reshape(len(drawn), -1)[:, :draws]
    return np.searchsorted(np.array(poisson_cuts(), np.uint32), bits.astype(np.uint32), side="right").astype(np.float64)
