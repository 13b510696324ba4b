"""Counter-based access to the linear congruential generator of the fault rules.

State k is a closed form of the seed, so any row computes its own draw and no
partition waits for another: x_k = A_k x_0 + C_k, with A_k = a^k and
C_k = (a^k - 1) / (a - 1), all modulo 2^64, built from the bits of k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the generator.
MULTIPLIER, INCREMENT = 6364136223846793005, 1
_MASK = (1 << 64) - 1


def _powers() -> tuple[np.ndarray, np.ndarray]:
    a, c, out = MULTIPLIER, INCREMENT, []
    for _ in range(64):
        out.append((a, c))
        a, c = a * a & _MASK, (a + 1) * c & _MASK
    return np.array([x for x, _ in out], np.uint64), np.array([x for _, x in out], np.uint64)


_A, _C = _powers()


def states(seed: int, k: np.ndarray) -> np.ndarray:
    """State after ``k`` steps from ``seed``, for an array of k."""
    x, k = np.full(len(k), seed, np.uint64), k.astype(np.uint64)
    for bit in range(int(k.max(initial=0)).bit_length()):
        on = (k >> np.uint64(bit)) & np.uint64(1) == 1
        x[on] = x[on] * _A[bit] + _C[bit]
    return x


def uniforms(x: np.ndarray) -> np.ndarray:
    """Draws in [0, 1], the end included."""
    return (x >> np.uint64(32)).astype(np.float64) / (2**32 - 1)


def uniform(seed: int, k: Column) -> Column:
    """The k-th draw (1 first) of the generator that starts from ``seed``."""

    @F.pandas_udf("double")
    def draw(k: pd.Series) -> pd.Series:
        return pd.Series(uniforms(states(seed, k.to_numpy())))

    return draw(k)


def random_bytes(seed: int, index: Column, size: int) -> Column:
    """Payload ``index`` (0 first) of ``size`` bytes, each the low byte of the next state."""

    @F.pandas_udf("binary")
    def fill(index: pd.Series) -> pd.Series:
        k = (index.to_numpy().astype(np.int64)[:, None] * size + np.arange(1, size + 1)).ravel()
        low = (states(seed, k) & np.uint64(255)).astype(np.uint8).reshape(-1, size)
        return pd.Series([row.tobytes() for row in low])

    return fill(index)
