"""What the training-data operators share: tables, scratch space, and words of UTF-8 buffers.

Texts reach Python as Arrow batches.  The helpers below work on the batch's UTF-8 bytes with
numpy, in chunks of bounded size, so a task's memory does not follow the size of a partition.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of labelled texts that a model is fitted on at most.
TRAIN_BYTES = 64 << 20
#: Rows of an Arrow batch, where tasks hold much besides: worker and JVM hold two batches each.
BATCH_ROWS = 1000
#: Bytes of text that the numpy helpers take at a time (one longer document is taken whole).
CHUNK_BYTES = 1 << 19
#: Bits of a sieve for each id that is looked for, bits of a row of it, and how many rows it has at most (32 MB, sent to all tasks).
SIEVE_BITS, SIEVE_ROW, SIEVE_ROWS = 32, 1 << 15, 1 << 13
#: Scratch paths made inside passing(), by how deep.
_PASSING: list[list[str]] = []

_U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master without such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends, or before at the end of the passing() it is made in."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _PASSING:
        _PASSING[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again: its lineage ends here."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(StructType(df.schema.fields)).parquet(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    return written(df, scratch_path(df.sparkSession, name))


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is saved inside is removed at the end; what outlasts it is written to a path made before."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            _remove(spark, path)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside hands Python at most BATCH_ROWS rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fold(doc_id: str, parts: int):
    """crc32 of the id as text, modulo parts: the fold of a labelled row."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def labelled(marks: DataFrame, mark: str, parts: int, held: int) -> DataFrame:
    """doc_id and label of all labelled ids outside the held-out fold; of labels that contradict one another the lower one."""
    rows = marks.select(F.col("doc_id"), F.col(mark).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    return rows.where(fold("doc_id", parts) != held).groupBy("doc_id").agg(F.min("label").alias("label"))


def least_errors(low: np.ndarray, high: np.ndarray) -> int:
    """The step from which on rows count as high with least weight of errors, given weights of low and of high rows by step; of ties the middle."""
    wrong = np.concatenate(([0], np.cumsum(high))) + np.concatenate((np.cumsum(low[::-1])[::-1], [0]))
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    return int(best[len(best) // 2])


def training_sample(docs: DataFrame, marks: DataFrame, mark: str, parts: int, held: int, bound: int) -> DataFrame:
    """At most `bound` labelled rows outside the held-out fold, chosen by a hash of their id,
    half of them of either label as far as there are so many, and of either label half of TRAIN_BYTES of texts at most.
    Columns doc_id, text, label.

    Texts above TRAIN_BYTES / bound come after all others, the shorter ones first; so long texts never drive out others, and
    only a label all of whose texts are longer than half of TRAIN_BYTES has none.
    Rows without id, label or text are no training rows; of rows that repeat an id one counts, and of labels that contradict the lower one.
    """
    chosen = marks.select(F.col("doc_id"), F.col(mark).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)
    )
    chosen = chosen.where(fold("doc_id", parts) != held)
    order = F.xxhash64(F.col("doc_id"), F.lit(71))
    # top-k per label: each partition keeps `bound / 2` rows before anything moves
    both = [chosen.where(F.col("label") == k).orderBy(order, "doc_id").limit(bound // 2) for k in (0, 1)]
    ids = both[0].unionByName(both[1]).groupBy("doc_id").agg(F.min("label").alias("label"))
    ids = F.broadcast(ids)  # at most `bound` rows
    size = F.octet_length("text").cast("long")
    rows = (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull() & (size <= TRAIN_BYTES // 2))
        .join(ids, "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.min("label").alias("label"))
    )
    long = F.when(size > TRAIN_BYTES // bound, size).otherwise(0)
    so_far = F.sum(size).over(Window.partitionBy("label").orderBy(long, order, "doc_id"))  # over at most `bound` rows
    return rows.withColumn("bytes", so_far).where(F.col("bytes") <= TRAIN_BYTES // 2).drop("bytes").orderBy("doc_id")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id the column doc_id of gone lacks; docs may have any other columns.

    A sieve of gone's ids goes to all tasks; what it holds back meets the ids themselves, all other rows stay where they are.
    """
    with small_batches(docs.sparkSession):
        gone = saved(gone.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).where("doc_id IS NOT NULL").distinct(), "gone")
        through, held = sieved(docs, gone)
    held = held.join(gone, "doc_id", "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return through.select(*columns).union(held.select(*columns))


def sieved(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of docs whose doc_id is none of ids (a written table of distinct ones), and the rest: all rows of these and some others.

    Of the others some 1 in SIEVE_BITS is in the rest, more beyond SIEVE_ROWS * SIEVE_ROW / SIEVE_BITS ids.
    """
    rows = min(max(1, -(-ids.count() * SIEVE_BITS // SIEVE_ROW)), SIEVE_ROWS)

    def places(doc_id):
        at = F.pmod(F.xxhash64(doc_id, F.lit(13)), F.lit(rows * SIEVE_ROW))
        return F.shiftright(at, SIEVE_ROW.bit_length() - 1), at.bitwiseAND(F.lit(SIEVE_ROW - 1))

    row, bit = places(ids["doc_id"])
    sieve = saved(ids.select(row.alias("row"), bit.alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")), "sieve")
    row, bit = places(docs["doc_id"])
    byte = F.conv(F.hex(F.substring(sieve["bits"], (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    meets = (row == sieve["row"]) & (F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return tuple(docs.join(F.broadcast(sieve), meets, how) for how in ("left_anti", "left_semi"))


# ---------------------------------------------------------------- UTF-8 buffers


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; null rows are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8), at


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of whole rows."""
    data, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit word."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_POW = np.ones(1, _U64)
_INV = np.ones(1, _U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, CHUNK_BYTES + 1)
        back = pow(_BASE, -1, 1 << 64)
        for name, base in (("_POW", _BASE), ("_INV", back)):
            a = np.full(n, base, _U64)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)
    return _POW, _INV


def byte_values(fold_case: bool) -> np.ndarray:
    """A fixed random 64-bit value for each byte; A-Z count as a-z if fold_case."""
    t = mix(np.arange(1, 257, dtype=_U64) * _U64(0xD1342543DE82EF95))
    if fold_case:
        t[65:91] = t[97:123]
    return t


_VALUES = {fold_case: byte_values(fold_case) for fold_case in (False, True)}

#: Bytes \x20 and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def spans_of(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes within rows: starts, ends, and each row's first run."""
    n = len(inside)
    if not n:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(at), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, at)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """64-bit hashes of ascending byte ranges that don't overlap: a sum over the bytes, each mixed with its place in the range.

    No product of places carries from byte to byte, so texts built from a repeated pattern and its complement, which
    polynomials modulo 2**64 can't tell apart, are told apart here.
    """
    n = len(data)
    start = np.zeros(n, np.int64)
    if len(s):
        start[s] = np.diff(s, prepend=0)
    np.cumsum(start, out=start)
    place = np.arange(n)
    place -= start
    term = place.view(_U64)
    term *= _U64(0xA24BAED4963EE407)
    term += _VALUES[fold_case][data]
    term ^= term >> _U64(32)
    term *= _U64(0xD6E8FEB86659FD93)
    term ^= term >> _U64(29)
    total = np.zeros(n + 1, _U64)
    np.cumsum(term, out=total[1:])
    h = total[e] - total[s]
    h += (e - s).astype(_U64) * _U64(0xA0761D6478BD642F)
    return mix(h)


def feature_sums(data: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """Running sums of the bytes' values times powers of a fixed base, modulo 2**64: what feature_hashes of any ranges of data are made from."""
    power, _ = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U64)
    values = _VALUES[fold_case][data]
    values *= power[: len(data)]
    np.cumsum(values, out=total[1:])
    return total


def feature_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, fold_case: bool = False, sums: np.ndarray | None = None) -> np.ndarray:
    """Cheaper hashes of any byte ranges, for features and samples only: polynomial in a fixed base, modulo 2**64, then mixed.

    sums: feature_sums(data, fold_case), where they are there already.
    """
    total = feature_sums(data, fold_case) if sums is None else sums
    _, inverse = _powers(len(data) + 1)
    h = total[e] - total[s]
    h *= inverse[s]
    h += (e - s).astype(_U64) * _U64(0xA0761D6478BD642F)
    return mix(h)


def words(data: np.ndarray, at: np.ndarray, fold_case: bool = False):
    """Words `[^\\x20\\x09-\\x0D]+`: starts, ends, each row's first word, hashes."""
    s, e, first = spans_of(~SPACE[data], at)
    return s, e, first, span_hashes(data, s, e, fold_case)


_PLACE = mix(np.arange(101, 133, dtype=_U64) * _U64(0x9E3779B97F4A7C15)) | _U64(1)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes, in order."""
    m = max(0, len(h) - k + 1)
    out = np.zeros(m, _U64)
    for j in range(k):
        out += h[j : j + m] * _PLACE[j]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
