"""Complexity of the gaps between packets: spectral entropy, approximate entropy, Hurst exponent.

Fourier transforms have no SQL form, so these run in Arrow batches of sessions. Sessions are
put together as sorted lists by a groupBy, which holds one session at a time. Approximate entropy compares all pairs of
a session's windows, 256 windows at a time, so its time grows with the square of a session's gaps, its memory in proportion to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.sessions import SESSION


#: Fewer gaps have no Hurst exponent.
LEAST = 10


def spectral_entropy(x: np.ndarray) -> float:
    """Entropy (in bits) of the power spectrum without its mean."""
    if len(x) <= 4 or x.std() < 1e-12:
        return 0.0
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    p = power[power > 0] / power.sum()
    return float(-(p * np.log2(p)).sum())


def _close_pairs(x: np.ndarray, m: int, r: float) -> int:
    """Pairs of windows of m values that nowhere differ by more than r."""
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    found = 0
    for i in range(0, len(w), 256):
        a = w[i : i + 256]
        near = np.abs(a[:, None, :] - w[None, :, :]).max(2) <= r
        found += int(np.triu(near, i + 1).sum()) if i else int(np.triu(near, 1).sum())
    return found


def approximate_entropy(x: np.ndarray, m: int = 2, share: float = 0.2) -> float:
    """Logarithm of how much rarer close windows of m + 1 values are than those of m."""
    n = len(x) - m + 1
    if n < 3 or x.std() < 1e-12:
        return 0.0
    r = share * x.std()
    short, long_ = _close_pairs(x, m, r), _close_pairs(x, m + 1, r)
    if not short or not long_:
        return 0.0
    return float(np.log(short / (n * (n - 1) / 2)) - np.log(long_ / ((n - 1) * (n - 2) / 2)))


def hurst(x: np.ndarray) -> float:
    """Slope of log deviation of lagged differences against log lag, in [0, 1]; 0.5 where it can't be told."""
    if len(x) < LEAST:
        return 0.5
    top = min(len(x) // 2, 50)
    lags = np.arange(2, top)
    if len(lags) < 2:
        return 0.5
    tau = np.array([np.std(x[k:] - x[:-k]) for k in lags])
    ok = tau > 1e-12
    if ok.sum() < 2:
        return 0.5
    return float(np.clip(np.polyfit(np.log(lags[ok]), np.log(tau[ok]), 1)[0], 0, 1))


def iat_complexity(ctx: DataFrame) -> DataFrame:
    """SESSION, iat_spectral_entropy, iat_approximate_entropy, iat_hurst_exponent."""
    listed = ctx.filter("iat IS NOT NULL").groupBy(*SESSION).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "iat"))), lambda x: x["iat"]).alias("gaps"))
    names = ["iat_spectral_entropy", "iat_approximate_entropy", "iat_hurst_exponent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.array(x) for x in b.column(len(SESSION)).to_pylist()]
            made = [[round(f(x), 6) for x in rows] for f in (spectral_entropy, approximate_entropy, hurst)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(SESSION)], *[pa.array(m, pa.float64()) for m in made]], names=[*SESSION, *names])

    fields = ", ".join(f"`{k}` {listed.schema[k].dataType.simpleString()}" for k in SESSION)
    return listed.select(*SESSION, "gaps").mapInArrow(run, f"{fields}, " + ", ".join(f"{n} double" for n in names))
