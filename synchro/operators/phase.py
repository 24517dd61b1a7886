"""Phases and connectivity of array signals by FFT, in Arrow batches.

A signal is one array, a trial one row of its participants' signals, so nothing is exploded to
samples: a task transforms all signals of a batch that are of one length at once, and results are arrays again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import butterworth, filtered

#: Energies whose product is below this give no coherency.
LEAST_ENERGY = 1e-20
#: Bytes of samples that are transformed at a time; complex temporaries and lags are some sixteen times as many.
BATCH_BYTES = 4 << 20


def parts(batch, *columns: str) -> Iterator:
    """The batch in slices whose arrays in the columns hold BATCH_BYTES of doubles at most (or one row)."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        size += 8 * np.diff(batch.column(c).offsets.to_numpy())
    so_far, i = np.cumsum(size), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(so_far, (so_far[i - 1] if i else 0) + BATCH_BYTES, "right")))
        yield batch.slice(i, j - i)
        i = j


def by_length(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the arrays of an Arrow list column of doubles; null and empty ones are left out."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    first = column.offsets.to_numpy()
    size = np.diff(first)
    if column.null_count:
        size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, size)
    flat = column.values.to_numpy(zero_copy_only=False).astype(float)
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        yield rows, flat[first[:-1][rows][:, None] + np.arange(n)]


def analytic(x: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
    """Analytic signals of the rows; with low and high only of these cycles a row (both included)."""
    n = x.shape[1]
    f = np.fft.fft(x, axis=1)
    gain = np.zeros(n)
    gain[0] = 1.0
    gain[1 : (n + 1) // 2] = 2.0
    if n % 2 == 0:
        gain[n // 2] = 1.0
    k = np.arange(n)
    if high is not None:
        gain[(k < low) | (k > high)] = 0.0
    return np.fft.ifft(f * gain, axis=1)


def unit(z: np.ndarray) -> np.ndarray:
    """Phases as numbers of magnitude 1; zeros stay."""
    size = np.abs(z)
    return z / np.where(size > 0, size, 1.0)


def band_analytic(x: np.ndarray, rate: float, band: tuple[float, float], anchor: int, window: tuple[float, float], order: int = 4, pad_seconds: float = 2.0) -> np.ndarray:
    """Analytic signals of the rows in a band, amplitudes kept, and a window of seconds after the anchor sample.

    Rows are reflected at both ends, filtered forward and backward, transformed, and only then cut, so the
    ends of the reflection and not those of the window carry what filter and transform do to ends.
    """
    n = x.shape[1]
    pad = max(1, min(round(pad_seconds * rate), n - 2))
    begin, end = anchor + round(window[0] * rate), anchor + round(window[1] * rate)
    if begin < 0 or end > n or end <= begin:
        raise ValueError(f"the window {begin}:{end} does not lie within {n} samples")
    padded = np.pad(x, ((0, 0), (pad, pad)), mode="reflect")
    b, a = butterworth(order, rate, *band)
    smooth = filtered(filtered(padded, b, a)[:, ::-1], b, a)[:, ::-1]
    return analytic(smooth)[:, pad:-pad][:, begin:end]


def band_phase(x: np.ndarray, rate: float, band: tuple[float, float], anchor: int, window: tuple[float, float], order: int = 4, pad_seconds: float = 2.0) -> np.ndarray:
    """Unit phases of the same."""
    return unit(band_analytic(x, rate, band, anchor, window, order, pad_seconds))


def _lists(rows: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]):
    """Arrow lists by row (null where none has one) from (rows, matrix)."""
    import pyarrow as pa

    if len(found) == 1 and len(found[0][0]) == len(rows):
        m = found[0][1]
        return pa.ListArray.from_arrays(np.arange(0, m.size + 1, max(m.shape[1], 1), dtype=np.int32) if m.size else np.zeros(len(rows) + 1, np.int32), pa.array(np.ascontiguousarray(m).reshape(-1)))
    out: list = [None] * len(rows)
    for at, m in found:
        for k, row in zip(at, m, strict=True):
            out[k] = row
    return pa.array(out, pa.list_(pa.float64()))


def phase_tensor(df: DataFrame, keys: list[str], samples: str, rate: float, bands: dict[str, tuple[float, float]], anchor: int, window: tuple[float, float], order: int = 4, pad_seconds: float = 2.0) -> DataFrame:
    """keys, band, re, im: the phases of every signal in every band, in one pass.  Null and empty signals have null phases.

    A window that leaves its signal fails the query.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (part for whole in batches for part in parts(whole, "x")):
            every = np.arange(batch.num_rows)
            matrices = list(by_length(batch.column("x")))
            for name, band in bands.items():
                z = [(rows, band_phase(x, rate, band, anchor, window, order, pad_seconds)) for rows, x in matrices]
                columns = [*(batch.column(k) for k in keys), pa.array([name] * len(every)), _lists(every, [(r, m.real) for r, m in z]), _lists(every, [(r, m.imag) for r, m in z])]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "band", "re", "im"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(samples).cast("array<double>").alias("x")).mapInArrow(run, f"{kinds}, band string, re array<double>, im array<double>")


def analytic_signals(df: DataFrame, keys: list[str], samples: str, low: int = 0, high: int | None = None, phase: bool = False) -> DataFrame:
    """keys, re, im: analytic signals (of some cycles only), or their phases."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (part for whole in batches for part in parts(whole, "x")):
            every = np.arange(batch.num_rows)
            z = [(rows, analytic(x, low, high)) for rows, x in by_length(batch.column("x"))]
            z = [(rows, unit(m)) for rows, m in z] if phase else z
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), _lists(every, [(r, m.real) for r, m in z]), _lists(every, [(r, m.imag) for r, m in z])], names=[*keys, "re", "im"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(samples).cast("array<double>").alias("x")).mapInArrow(run, f"{kinds}, re array<double>, im array<double>")


def _coherency(im: np.ndarray, ea: np.ndarray, eb: np.ndarray, none: float = 0.0) -> np.ndarray:
    both = ea * eb
    return np.where(both > LEAST_ENERGY, np.minimum(np.abs(im) / np.sqrt(np.where(both > LEAST_ENERGY, both, 1.0)), 1.0), none)


def pairs(df: DataFrame, keys: list[str], first: str, second: str, lags: bool = False, chain: dict | None = None) -> DataFrame:
    """keys, plv, imcoh: phase synchrony and imaginary coherency of two real signals a row; with lags arrays of them by circular shift of the second.

    chain: arguments of `band_analytic`, which both signals pass first; else signals are transformed as they are.
    Rows whose signals are missing, empty or of unlike lengths are left out.
    """
    transform = (lambda x: band_analytic(x, **chain)) if chain else analytic

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (part for whole in batches for part in parts(whole, "a", "b")):
            own = {int(x.shape[1]): (rows, x) for rows, x in by_length(batch.column("a"))}
            for rows_b, xb in by_length(batch.column("b")):
                rows_a, xa = own.get(int(xb.shape[1]), (np.zeros(0, int), None))
                rows = np.intersect1d(rows_a, rows_b)
                if not len(rows):
                    continue
                a, b = transform(xa[np.searchsorted(rows_a, rows)]), transform(xb[np.searchsorted(rows_b, rows)])
                ea, eb, n = (np.abs(a) ** 2).sum(1), (np.abs(b) ** 2).sum(1), a.shape[1]
                if lags:
                    cross = lambda u, v: np.fft.ifft(np.fft.fft(u, axis=1) * np.conj(np.fft.fft(v, axis=1)), axis=1)
                    plv, coh = np.abs(cross(unit(a), unit(b))) / n, _coherency(cross(a, b).imag, ea[:, None], eb[:, None], np.nan)
                    out = [_lists(np.arange(len(rows)), [(np.arange(len(rows)), m)]) for m in (plv, coh)]
                else:
                    out = [pa.array(np.abs((unit(a) * np.conj(unit(b))).mean(1))), pa.array(_coherency((a * np.conj(b)).sum(1).imag, ea, eb))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows)) for k in keys), *out], names=[*keys, "plv", "imcoh"])

    kinds, kind = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "array<double>" if lags else "double"
    both = df.select(*keys, F.col(first).cast("array<double>").alias("a"), F.col(second).cast("array<double>").alias("b"))
    return both.mapInArrow(run, f"{kinds}, plv {kind}, imcoh {kind}")


def sensor_edges(df: DataFrame, keys: list[str], first: str, second: str, channels: int) -> DataFrame:
    """keys, edges: synchrony of each channel of one participant with each of the other, as one array by channel1, then channel2.

    A signal holds its channels one after the other, of equal lengths.  Other rows are left out.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (part for whole in batches for part in parts(whole, "a", "b")):
            own = {int(x.shape[1]): (rows, x) for rows, x in by_length(batch.column("a"))}
            for rows_b, xb in by_length(batch.column("b")):
                rows_a, xa = own.get(int(xb.shape[1]), (np.zeros(0, int), None))
                rows = np.intersect1d(rows_a, rows_b)
                if not len(rows) or xb.shape[1] % channels:
                    continue
                size = xb.shape[1] // channels
                z = [unit(analytic(x[np.searchsorted(at, rows)].reshape(-1, size))).reshape(len(rows), channels, size) for at, x in ((rows_a, xa), (rows_b, xb))]
                edges = np.abs(z[0] @ np.conj(z[1]).transpose(0, 2, 1)) / size  # one matrix product a trial
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows)) for k in keys), _lists(rows, [(rows, edges.reshape(len(rows), -1))])], names=[*keys, "edges"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(first).cast("array<double>").alias("a"), F.col(second).cast("array<double>").alias("b")).mapInArrow(run, f"{kinds}, edges array<double>")
