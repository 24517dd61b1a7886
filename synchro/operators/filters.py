"""Zero-phase Butterworth band-pass of array columns, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def butterworth(order: int, rate: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order sections (b, a), each of shape (sections, 3), by the bilinear transform."""
    if not 0 < low < high < rate / 2:
        raise ValueError("the band must lie between 0 and half the sampling rate")
    warp = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    wide, centre = warp[1] - warp[0], warp[0] * warp[1]
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * wide / 2
    poles = np.concatenate((poles + np.sqrt(poles**2 - centre), poles - np.sqrt(poles**2 - centre)))
    z = (2 * rate + poles) / (2 * rate - poles)
    z = z[np.argsort(-z.imag)][:order]  # one of each conjugate pair
    b = np.tile([1.0, 0.0, -1.0], (order, 1))
    a = np.stack((np.ones(order), -2 * z.real, np.abs(z) ** 2), 1)
    middle = np.exp(2j * np.arctan(np.sqrt(centre) / (2 * rate)))
    for k in range(order):  # each section has gain 1 in the middle of the band
        b[k] /= abs(np.polyval(b[k], middle) / np.polyval(a[k], middle))
    return b, a


#: Samples that one step of the recursion takes.
STEP = 64


class _Cascade:
    """The sections in series as one linear system, and its matrices over STEP samples.

    With state s and samples x of a step, outputs are s @ seen + x @ response, and the next state is s @ kept + x @ taken.
    """

    def __init__(self, b: np.ndarray, a: np.ndarray):
        k = len(b)
        move, take, see, direct = np.zeros((2 * k, 2 * k)), np.zeros(2 * k), np.zeros(2 * k), 1.0
        self.start, gain = np.zeros(2 * k), 1.0  # the steady state of a constant 1
        for i, (bk, ak) in enumerate(zip(b, a, strict=True)):
            own = np.array([[-ak[1], 1.0], [-ak[2], 0.0]])
            into = np.array([bk[1] - ak[1] * bk[0], bk[2] - ak[2] * bk[0]])
            at = slice(2 * i, 2 * i + 2)
            # a section's input is what those before it put out: see @ state + direct * sample
            move[at] += np.outer(into, see)
            move[at, at] += own
            take[at] = into * direct
            see = bk[0] * see
            see[2 * i] += 1.0
            direct *= bk[0]
            self.start[at] = np.linalg.solve(np.eye(2) - own, into) * gain
            gain *= bk.sum() / ak.sum()
        powers = [np.eye(2 * k)]
        for _ in range(STEP):
            powers.append(move @ powers[-1])
        impulse = np.array([direct, *(see @ powers[i] @ take for i in range(STEP - 1))])
        lag = np.arange(STEP)[None, :] - np.arange(STEP)[:, None]
        self.response = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
        self.seen = np.stack([see @ powers[i] for i in range(STEP)], axis=1)
        self.kept = powers[STEP].T
        self.taken = np.stack([powers[STEP - 1 - i] @ take for i in range(STEP)])


def filtered(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Rows of x through the sections, started in the steady state of their first samples: STEP samples at a time, by matrix products."""
    system, n = _Cascade(b, a), x.shape[1]
    padded = np.zeros((len(x), -(-n // STEP) * STEP))
    padded[:, :n] = x
    parts = padded.reshape(len(x), -1, STEP)
    out, more = parts @ system.response, parts @ system.taken
    state = x[:, :1] * system.start
    for i in range(parts.shape[1]):
        out[:, i] += state @ system.seen
        state = state @ system.kept + more[:, i]
    return out.reshape(len(x), -1)[:, :n]


def bandpass(df: DataFrame, key: str, samples: str, rate: float, low: float, high: float, order: int = 4) -> DataFrame:
    """key and `filtered`: forward and backward, so phases stay. Null and empty signals stay as they are."""
    b, a = butterworth(order, rate, low, high)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            column = batch.column("x")
            out = np.zeros(len(column.values), float)
            first = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)
            size = np.diff(first)
            for n in np.unique(size[size > 0]):
                at = first[:-1][size == n][:, None] + np.arange(n)
                out[at] = filtered(filtered(flat[at], b, a)[:, ::-1], b, a)[:, ::-1]
            lists = pa.ListArray.from_arrays(column.offsets, pa.array(out), mask=column.is_null())
            yield pa.RecordBatch.from_arrays([batch.column(key), lists], names=[key, "filtered"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(samples).cast("array<double>").alias("x")).mapInArrow(run, f"{key} {kind}, filtered array<double>")
