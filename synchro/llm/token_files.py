"""Token ids in ORC files (operator 3).

Documents are dealt by ranges of doc_id and sorted, encoded in Arrow batches, and written as ORC: the
ids are an integer list, so ORC's run-length encoding packs them; stripes are read in parallel; row
indexes and Bloom filters on doc_id let a reader that asks for documents skip row groups unread.
Each row also has its partition and the ids before it there.  Reading back adds the partitions'
sums (one row a file), so positions in the whole stream need no ordering of all rows again.

Null and empty texts hold the end id alone.  Rows that repeat a doc_id stand next to each other,
by text; rows without a doc_id come first.  Extra columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import Encoder

END_ID = 2
STRIPE_BYTES, ROWS_PER_INDEX, BLOOM_FPP = 16 << 20, 1000, 0.01
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_lists(ids: np.ndarray, first: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(first.astype(np.int32), pa.array(ids.view(np.int32)))


def with_end(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with the end id after each."""
    n = len(first) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    row = np.repeat(np.arange(n), np.diff(first))
    out[np.arange(len(ids)) + row] = ids
    return out, first + np.arange(n + 1)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, keeps_space: bool = True) -> None:
    """ORC files of (part, first, n_tokens, doc_id, ids) at path; parts and rows ascend by doc_id."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, before = TaskContext.get().partitionId(), 0
        encoder = Encoder.of(tokenizer, keeps_space)
        for batch in batches:
            for i, j, data, at in C.chunks(batch.column("text")):
                ids, first = with_end(*encoder.encode(data, at), end_id)
                columns = [pa.array(np.full(j - i, part, np.int32)), pa.array(before + first[:-1]), pa.array(np.diff(first)), batch.column("doc_id").slice(i, j - i), id_lists(ids, first)]
                before += int(first[-1])
                yield pa.RecordBatch.from_arrays(columns, names=["part", "first", "n_tokens", "doc_id", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(run, "part int, first long, n_tokens long, doc_id long, ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(BLOOM_FPP), "orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": str(ROWS_PER_INDEX), "orc.create.index": "true"}
    encoded.write.options(**options).orc(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; with doc_ids only those, of stripes whose indexes and filters may hold them."""
    rows = spark.read.schema("part int, first long, n_tokens long, doc_id long, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def _digests(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        lists = batch.column("ids")
        at = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8)
        crc = np.array([zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
        keep = [batch.column(k) for k in batch.schema.names if k != "ids"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(crc)], names=[*(k for k in batch.schema.names if k != "ids"), "ids_crc32"])


def digested(rows: DataFrame) -> DataFrame:
    """rows with ids_crc32, the checksum of ids as little-endian 32-bit integers, in place of ids."""
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "ids")
    return rows.mapInArrow(_digests, f"{kept}, ids_crc32 long")


def positions(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of rows that `read` gave."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    # one row a file: a small table, ordered whole
    before = sums.select(F.col("part").alias("p"), (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    each = digested(rows.select("part", "first", F.size("ids").cast("long").alias("n_tokens"), "doc_id", "ids"))
    return each.join(before, F.col("part") == F.col("p")).select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    path = C.scratch_path(spark, "token-files")
    write(C.documents(spark, sf_dir), path, tokenizer_path(TOKENIZER))
    return positions(read(spark, path))
