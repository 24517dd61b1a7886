"""Sequence packing with a bounded number of open windows (operator 9).

Each partition encodes its documents and keeps OPEN windows of LENGTH tokens.  A document's whole
windows leave at once; the rest goes to the open window that it fits best.  If none fits, a new window
opens, or, with OPEN of them open, the fullest leaves: topped up with the head of the document where
its gap is at least LEAST_CUT tokens, else with its gap as padding.  What a partition has open at its
end is merged with that of MERGE - 1 others in the same way, and so on to the last; the last
windows are run together.  So padding is under LEAST_CUT tokens a sequence, and one sequence more.

Memory is OPEN windows a task and a chunk of texts, merged groups are MERGE * OPEN windows, whatever
the input.  The packed pieces are written once, so windows and leftovers always fit together.

Null and empty texts hold the end id alone.  Repeated rows and ids are documents each; a row without
doc_id is packed, too.  Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .token_files import digested, id_lists, tokenizer_path, with_end
from .tokens import Encoder

LENGTH, OPEN, LEAST_CUT, MERGE = 2048, 16, 16, 16
END_ID, TOKENIZER = 1, "word_bpe_49k.json"
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, part int, is_open boolean, ids array<int>"


class Packer:
    """Places pieces of documents; `done` are pieces of sequences that left, as rows without part."""

    def __init__(self, part: int, merging: int):
        self.next, self.windows, self.done = (merging << 57) | (part << 32), [], []

    def _emit(self, window: list, is_open: bool = False) -> None:
        at = 0
        for doc, start, ids, total in window:
            self.done.append((doc, start, len(ids), total, self.next, at, is_open, ids))
            at += len(ids)
        self.next += 1

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        """One document, or a piece of one that starts at `start`."""
        while len(ids) >= LENGTH:
            self._emit([(doc, start, ids[:LENGTH], total)])
            start, ids = start + LENGTH, ids[LENGTH:]
        if not len(ids):
            return
        fits = [w for w in self.windows if w[0] >= len(ids)]
        if fits:
            best = min(fits, key=lambda w: w[0])
        else:
            if len(self.windows) == OPEN:
                full = min(self.windows, key=lambda w: w[0])
                self.windows.remove(full)
                if (gap := full[0]) >= LEAST_CUT:
                    full[1].append((doc, start, ids[:gap], total))
                    start, ids = start + gap, ids[gap:]
                self._emit(full[1])
            self.windows.append(best := [LENGTH, []])
        best[1].append((doc, start, ids, total))
        best[0] -= len(ids)
        if not best[0]:
            self.windows.remove(best)
            self._emit(best[1])

    def close(self, last: bool) -> None:
        """Open windows leave as such, or, at the last, run together."""
        if not last:
            for _, pieces in self.windows:
                self._emit(pieces, True)
            return
        room, now = LENGTH, []
        for _, pieces in sorted(self.windows, key=lambda w: w[0]):
            for doc, start, ids, total in pieces:
                while len(ids):
                    head, ids = ids[:room], ids[room:]
                    now.append((doc, start, head, total))
                    start, room = start + len(head), room - len(head)
                    if not room:
                        self._emit(now)
                        room, now = LENGTH, []
        if now:
            self._emit(now)

    def batch(self, part: int):
        """What is done as an Arrow batch; forgets it."""
        import pyarrow as pa

        rows, self.done = self.done, []
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        ids = np.concatenate(columns[7]) if rows else np.zeros(0, np.uint32)
        first = np.concatenate(([0], np.cumsum([len(x) for x in columns[7]]))).astype(np.int64)
        longs = [pa.array(c, pa.int64()) for c in columns[:6]]
        return pa.RecordBatch.from_arrays(
            [*longs, pa.array(np.full(len(rows), part, np.int32)), pa.array(columns[6], pa.bool_()), id_lists(ids, first)],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "part", "is_open", "ids"],
        )


def packed(docs: DataFrame, tokenizer: str, end_id: int = END_ID, keeps_space: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids."""

    def run(batches: Iterator) -> Iterator:
        part = TaskContext.get().partitionId()
        encoder, packer = Encoder.of(tokenizer, keeps_space), Packer(part, 0)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for i, j, data, at in C.chunks(batch.column("text")):
                ids, first = with_end(*encoder.encode(data, at), end_id)
                for r in range(j - i):
                    own = ids[first[r] : first[r + 1]]
                    packer.add(names[i + r], 0, own, len(own))
                yield packer.batch(part)
        packer.close(False)
        yield packer.batch(part)

    with C.small_batches(docs.sparkSession):
        pieces = C.saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA), "pieces")
    out = [pieces.where("not is_open")]
    left, merging = pieces.where("is_open"), 0
    while True:
        merging += 1
        parts = left.agg(F.max("part")).first()[0]
        if parts is None:
            break
        last = parts < MERGE
        left = C.saved(left.withColumn("part", (F.col("part") / MERGE).cast("int")).groupBy("part").applyInArrow(_merger(merging, last), SCHEMA), "merged")
        out.append(left.where("not is_open"))
        if last:
            break
        left = left.where("is_open")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.drop("part", "is_open")


def _merger(merging: int, last: bool):
    def run(table):
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).combine_chunks()
        part = table.column("part")[0].as_py()
        packer = Packer(part, merging)
        for batch in table.to_batches():
            lists = batch.column("ids")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.uint32)
            docs, starts, totals = (batch.column(k).to_pylist() for k in ("doc_id", "start", "doc_tokens"))
            for r in range(batch.num_rows):
                packer.add(docs[r], starts[r], flat[at[r] : at[r + 1]], totals[r])
        packer.close(last)
        import pyarrow as pa

        return pa.Table.from_batches([packer.batch(part)])

    return run


def query(spark, sf_dir: str) -> DataFrame:
    rows = packed(C.documents(spark, sf_dir), tokenizer_path(TOKENIZER))
    return digested(rows).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences, with their ids."""
    return packed(docs, tokenizer_path(TOKENIZER))
