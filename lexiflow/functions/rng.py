"""Reproducible randomness from keyed hashes.

``rand(seed)`` depends on partition layout and row order, so a result would
change with the cluster size.  Every draw here is a pure function of its key
(seed, epoch, row id, slot, k), so any partitioning gives the same rows.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiflow.functions._util import col_of

try:  # CPython's own md5 takes about half of OpenSSL's time on a short key
    from _md5 import md5
except ImportError:
    from hashlib import md5

_TWO_32 = 4294967296.0


def _key(parts) -> Column:
    cols = []
    for p in parts:
        if isinstance(p, Column):
            cols.append(p.cast("string"))
        elif isinstance(p, str):
            cols.append(F.lit(p))
        else:
            cols.append(F.lit(str(p)))
    return F.concat_ws("|", *cols)


def uniform(*parts) -> Column:
    """Keyed draw in [0, 1): first 32 bits of md5 of the '|'-joined key."""
    return F.conv(F.substring(F.md5(_key(parts)), 1, 8), 16, 10).cast("double") / F.lit(_TWO_32)


def below(rate: float, *parts) -> Column:
    """``uniform(*parts) < rate``, told from the digest's hex digits without turning them into a number."""
    bound = ceil(rate * _TWO_32)
    return F.lit(True) if bound >= _TWO_32 else F.md5(_key(parts)) < F.lit(f"{max(bound, 0):08x}")


def key_head(*parts) -> bytes:
    """A key up to its last part, for the plain draws below; NULL parts are skipped as in ``_key``."""
    return "".join(f"{p}|" for p in parts if p is not None).encode()


def plain_uniform(key: bytes) -> float:
    """``uniform`` of one key outside a column, for functions that read Arrow batches."""
    return int.from_bytes(md5(key).digest()[:4], "big") / _TWO_32


def plain_bound(rate: float) -> bytes:
    """The digest of a key is below this where ``below(rate, key)`` holds."""
    bound = ceil(rate * _TWO_32)
    return b"\xff" * 17 if bound >= _TWO_32 else max(bound, 0).to_bytes(4, "big")


def randint(lo, hi, *parts) -> Column:
    """Keyed integer draw in [lo, hi] inclusive."""
    lo_c = F.lit(lo) if not isinstance(lo, Column) else lo
    hi_c = F.lit(hi) if not isinstance(hi, Column) else hi
    return (lo_c + F.floor(uniform(*parts) * (hi_c - lo_c + 1))).cast("int")


def shuffle_key(seed, epoch, row_id) -> Column:
    """Sort key of the seeded shuffle: md5 of (seed, epoch, row id)."""
    return F.md5(_key([seed, epoch, col_of(row_id)]))
