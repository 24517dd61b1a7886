"""Passages repeated across documents, removed by suffix arrays (operator 11).

A byte goes if a string of MATCH bytes that covers it also starts in a document with a smaller doc_id.  Suffixes of
all texts in one array would not fit a task, so equal strings are first brought together:

1. Texts are written once, in flushes of some FLUSH_BYTES, in a table bucketed by flush: later passes read it in place.
2. A string's anchor is the least hash of its runs of ANCHOR bytes, so equal strings have equal anchors wherever they
   stand.  Each flush sends its distinct anchors, packed by range of the hash; what comes back is which of them are
   in several documents, and which are so common that their strings must be told apart further (by a hash of the whole string).
3. Around shared anchors a flush cuts segments: neighbouring strings of one anchor.  Each distinct segment of
   a flush goes once to the anchor's bucket, with its places and its smallest and largest doc_id.
4. A bucket lays its distinct segments end to end and sorts their suffixes by two-stage sorting (`suffixes`): directly those
   smaller than their successors, the others by a scan of buckets.  Neighbours in that order whose common prefix
   reaches MATCH bytes are one string; its smallest doc_id is the smallest of the run.
5. Places go back to their flush with that id; bytes of documents with larger ids are removed there.

Of documents with one text (by a 128-bit digest) only those of the smallest doc_id go through these steps: a copy loses all its bytes
to that one, and whatever a third document has in common with the copy it has in common with a smaller doc_id already.

No group grows with a passage's copies but by one row a flush; a bucket holds BUCKET_BYTES or so, whatever the table's size.

Null and empty texts have no bytes and lose none.  A null doc_id is neither smaller nor larger: its row loses
nothing and nothing is lost to it.  Rows that repeat a doc_id do not count against each other.  A text of any length is one flush at most, taken
in pieces.  An empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import contextlib
import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import suffixes
from .tokens import ragged

MATCH, ANCHOR = 50, 16
#: Bytes of texts in a flush, and of it that numpy takes at a time.
FLUSH_BYTES, PIECE = 8 << 20, 1 << 19
#: Bytes of anchors, and of segments, that a bucket holds on average; bytes of texts in a bucket of the table of flushes.
ANCHOR_BYTES, BUCKET_BYTES, TABLE_BYTES = 4 << 20, 4 << 20, 64 << 20
#: Neighbouring strings in a segment at most.
MOST_STRINGS = 64
#: An anchor in so many flushes, or at so many places of one flush, is common.
COMMON = 256
#: Bits of an anchor that are sent besides its bucket.
BITS = 38

_U64 = np.uint64
_A, _B = _U64(0x9FB21C651E98DF25), _U64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- flushes


def _flushes(batches: Iterator) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = batch.column("doc_id")
        for i, j, data, at in C.chunks(batch.column("text"), FLUSH_BYTES):
            whole, known = memoryview(data), ids.slice(i, j - i).is_valid().to_numpy(zero_copy_only=False)
            marks = [hashlib.blake2b(whole[a:b], digest_size=16).digest() if k and b - a >= MATCH else None for k, a, b in zip(known, at.tolist(), at[1:].tolist(), strict=False)]
            of, marks = (pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), x) for x in (ids.slice(i, j - i), pa.array(marks, pa.binary())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), of, marks, pa.array([at.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["flush", "ids", "marks", "offsets", "data"]
            )
            number += 1


def flushes(docs: DataFrame, total: int) -> DataFrame:
    """flush, ids, marks (digests of texts that may have copies), offsets, data: the texts end to end, in a table bucketed by flush in the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_flushes, "flush long, ids array<long>, marks array<binary>, offsets binary, data binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TABLE_BYTES))
    name = f"flushes_{uuid.uuid4().hex}"
    rows.write.bucketBy(min(parts, 100_000), "flush").option("path", C.scratch_path(spark, "flushes")).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018  resolved while the catalog knows the name
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE {name}")  # its files stay until the driver ends
    return table


def copies(table: DataFrame) -> DataFrame:
    """flush, copies: places in the flush of texts that a smaller doc_id has, too; one row a flush and text is compared."""
    each = table.select("flush", F.posexplode(F.arrays_zip("ids", "marks")).alias("place", "q")).where("q.marks IS NOT NULL")
    each = each.groupBy("flush", F.col("q.marks").alias("mark")).agg(F.min("q.ids").alias("low"), F.max("q.ids").alias("high"), F.collect_list(F.struct(F.col("q.ids").alias("id"), "place")).alias("rows"))
    first = each.groupBy("mark").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last").select("mark", "first")
    found = each.where("high IS NOT NULL").join(first, "mark").select("flush", F.expr("transform(filter(rows, x -> x.id > first), x -> x.place)").alias("places"))
    return found.groupBy("flush").agg(F.flatten(F.collect_list("places")).alias("copies"))


def _texts(table, more) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, bytes, offsets, ids (0 for null), which ids are known, and which texts are copies, of a flush; `more` may have its copies."""
    row = table.select(["flush", "ids", "offsets", "data"]).to_pylist()[0]
    ids = row["ids"] or []
    known, copy = np.array([i is not None for i in ids], bool), np.zeros(len(ids), bool)
    for places in more.column("copies").to_pylist():
        copy[places or []] = True
    return row["flush"], np.frombuffer(row["data"], np.uint8), np.frombuffer(row["offsets"], np.int64), np.array([i or 0 for i in ids], np.int64), known, copy


# ---------------------------------------------------------------- anchors


def anchors(data: np.ndarray, at: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of neighbouring strings of one anchor: first string's place, how many, hash; by pieces of the flush.

    Strings that leave their row, or whose row's id is not known, have none.
    """
    width = MATCH - ANCHOR + 1
    for a in range(0, len(data) - MATCH + 1, PIECE):
        own = data[a : a + PIECE + MATCH - 1]
        n = len(own) - MATCH + 1
        word = suffixes.words_at(own)
        low = C.mix(word[: n + width - 1] * _A + word[ANCHOR - 8 : n + width - 1 + ANCHOR - 8] * _B)
        size = 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        # strings that start within MATCH - 1 bytes of their row's end
        first, last = int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, a + n, "left"))
        ends, starts = at[first + 1 : last + 1], at[first:last]
        out = np.zeros(n + 1, np.int32)
        for lo, hi in ((np.maximum(starts, ends - MATCH + 1), ends), (starts[~known[first:last]], ends[~known[first:last]])):
            np.add.at(out, np.clip(lo - a, 0, n), 1)
            np.add.at(out, np.clip(hi - a, 0, n), -1)
        fine = np.cumsum(out[:n]) == 0
        new = fine.copy()
        edge = np.zeros(n, bool)
        inner = starts[(starts >= a) & (starts < a + n)] - a
        edge[inner] = True
        new[1:] &= (low[1:n] != low[: n - 1]) | ~fine[:-1] | edge[1:]
        s = np.flatnonzero(new)
        stop = np.flatnonzero(~fine | new)
        stop = np.append(stop, n)
        e = stop[np.searchsorted(stop, s, "right")]
        yield a + s, e - s, low[s]


def keys(hashes: np.ndarray, bits: int) -> np.ndarray:
    """BITS + bits bits of each hash; the uppermost `bits` are its bucket.  Least hashes are small, so they are mixed again."""
    return C.mix(hashes ^ _U64(0x2545F4914F6CDD1D)) >> _U64(64 - BITS - bits)


def _sent(bits: int):
    """Distinct anchors of each flush by bucket: BITS bits, whether it is common there, whether several documents of the flush have it."""

    def run(key, own, more):
        import pyarrow as pa

        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["bucket", "flush", "keys"])
        if not own.num_rows:
            return empty
        flush, data, at, ids, known, copy = _texts(own, more)
        found = [(keys(h, bits), s) for s, _, h in anchors(data, at, known & ~copy)]
        if not found:
            return empty
        key, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(key, kind="stable")
        key, owner = key[order], ids[np.searchsorted(at, place[order], "right") - 1]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        if not len(new):
            return empty
        many = np.minimum.reduceat(owner, new) < np.maximum.reduceat(owner, new)
        often = np.diff(np.append(new, len(key))) >= COMMON
        key = key[new]
        packed = ((key & _U64((1 << BITS) - 1)) << _U64(2) | (often.astype(_U64) << _U64(1)) | many.astype(_U64)).view(np.uint8).reshape(-1, 8)[:, :5]
        bucket = (key >> _U64(BITS)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        parts = [packed[x:y].tobytes() for x, y in zip(cut, np.append(cut[1:], len(bucket)), strict=True)]
        return pa.table([pa.array(bucket[cut]), pa.array(np.full(len(cut), flush)), pa.array(parts, pa.binary())], names=["bucket", "flush", "keys"])

    return run


def _shared(key, table):
    """For each flush its anchors in the bucket that several documents have: the key, then a bit that says whether it is common."""
    import pyarrow as pa

    raw = [np.frombuffer(x, np.uint8).reshape(-1, 5) for x in table.column("keys").to_pylist()]
    wide = np.zeros((sum(map(len, raw)), 8), np.uint8)
    wide[:, :5] = np.concatenate(raw)
    own = wide.view(np.uint64).ravel()
    flush = np.repeat(np.array(table.column("flush")), [len(x) for x in raw])
    order = np.argsort(own >> _U64(2), kind="stable")
    value, flag, flush = own[order] >> _U64(2), own[order] & _U64(3), flush[order]
    new = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    size = np.diff(np.append(new, len(value)))
    flags = np.bitwise_or.reduceat(flag, new)
    keep = np.repeat((size > 1) | (flags & _U64(1) > 0), size)
    common = np.repeat((size >= COMMON) | (flags & _U64(2) > 0), size)
    value = (((_U64(key[0].as_py()) << _U64(BITS)) | value) << _U64(1)) | common.astype(_U64)
    value, flush = value[keep], flush[keep]
    order = np.argsort(flush, kind="stable")
    value, flush = value[order], flush[order]
    cut = np.flatnonzero(np.append(True, flush[1:] != flush[:-1])) if len(flush) else np.zeros(0, np.int64)
    parts = [value[x:y].tobytes() for x, y in zip(cut, np.append(cut[1:], len(flush)), strict=False)]
    return pa.table({"flush": pa.array(flush[cut], pa.int64()), "anchors": pa.array(parts, pa.binary())})


# ---------------------------------------------------------------- segments

_SEGMENTS = "bucket long, flush long, sizes binary, copies binary, least binary, most binary, places binary, strings binary"


def _segments(bits: int, buckets: int):
    """A flush's distinct segments by bucket: bytes, how many copies, smallest and largest doc_id; places of the copies."""

    def run(key, own, sent):
        import pyarrow as pa

        names = [x.split()[0] for x in _SEGMENTS.split(", ")]
        types = [pa.int64(), pa.int64()] + [pa.binary()] * 6
        empty = pa.table([pa.array([], t) for t in types], names=names)
        shared = sent.column("anchors").drop_null().to_pylist()
        if not own.num_rows or not shared:
            return empty
        flush, data, at, ids, known, copy = _texts(own, sent)
        value = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in shared]))
        wanted, common = value >> _U64(1), (value & _U64(1)) > 0
        starts, counts, hashes = [], [], []
        for s, n, h in anchors(data, at, known & ~copy):
            h = keys(h, bits)
            k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            hit = wanted[k] == h
            s, n, h, far = s[hit], n[hit], h[hit], common[k[hit]]
            # common anchors: each string by itself; others: by MOST_STRINGS at most
            step = np.where(far, 1, MOST_STRINGS)
            pieces = -(-n // step)
            of = np.repeat(np.arange(len(s)), pieces)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = s[of] + nth * step[of]
            count = np.minimum(step[of], n[of] - nth * step[of])
            h = h[of]
            for_all = np.flatnonzero(far[of])
            if len(for_all):
                base = int(first[for_all[0]])
                word = suffixes.words_at(data[base : int(first[for_all[-1]]) + MATCH])
                whole = np.zeros(len(for_all), _U64)
                for j, k in enumerate([*range(0, MATCH - 8, 8), MATCH - 8]):
                    whole = C.mix(whole + word[first[for_all] - base + k] * C._PLACE[j])
                h[for_all] = whole
            starts, counts, hashes = [*starts, first], [*counts, count], [*hashes, h]
        start, count, h = (np.concatenate(x) for x in (starts, counts, hashes))
        if not len(start):
            return empty
        size = count + MATCH - 1
        flat, _ = ragged(data, start, size)
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(flat)])
        index = strings.dictionary_encode().indices.to_numpy()
        bucket = (h % _U64(buckets)).astype(np.int64)
        order = np.lexsort((start, index, bucket))
        index, bucket, start, size = index[order], bucket[order], start[order], size[order]
        new = np.flatnonzero(np.append(True, (index[1:] != index[:-1]) | (bucket[1:] != bucket[:-1])))
        copies = np.diff(np.append(new, len(index)))
        owner = ids[np.searchsorted(at, start, "right") - 1]
        least, most = np.minimum.reduceat(owner, new), np.maximum.reduceat(owner, new)
        of = bucket[new]
        cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        columns = [[] for _ in range(6)]
        for x, y in zip(cut, np.append(cut[1:], len(of)), strict=True):
            held = slice(new[x], new[y] if y < len(of) else len(index))
            text, _ = ragged(data, start[new[x:y]], size[new[x:y]])
            for column, v in zip(columns, (size[new[x:y]].astype(np.uint16), copies[x:y].astype(np.uint32), least[x:y], most[x:y], start[held].astype(np.uint32), text), strict=True):
                column.append(v.tobytes())
            columns[-1][-1] = pa.compress(columns[-1][-1], codec="zstd", asbytes=True)
        return pa.table([pa.array(of[cut]), pa.array(np.full(len(cut), flush))] + [pa.array(c, pa.binary()) for c in columns], names=names)

    return run


_FOUND = np.dtype([("place", "<u4"), ("strings", "<u4"), ("least", "<i8")])


def _sorted(key, table):
    """For each flush: places and numbers of neighbouring strings whose smallest doc_id is below that of a copy there."""
    import pyarrow as pa

    rows = table.to_pylist()
    part = {k: [np.frombuffer(r[k], t) for r in rows] for k, t in (("sizes", np.uint16), ("copies", np.uint32), ("least", np.int64), ("most", np.int64), ("places", np.uint32))}
    part["strings"] = [np.frombuffer(pa.decompress(r["strings"], int(n.sum(dtype=np.int64)), "zstd"), np.uint8) for r, n in zip(rows, part["sizes"], strict=True)]
    size, copies, least, most, places, text = (np.concatenate(part[k]) for k in ("sizes", "copies", "least", "most", "places", "strings"))
    size, copies = size.astype(np.int64), copies.astype(np.int64)
    # distinct segments of all flushes, and the smallest doc_id of each
    at = np.concatenate(([0], np.cumsum(size)))
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(text))])
    index = strings.dictionary_encode().indices.to_numpy()
    order = np.argsort(index, kind="stable")
    example = order[np.flatnonzero(np.append(True, index[order][1:] != index[order][:-1]))]
    known = np.full(len(example), np.iinfo(np.int64).max)
    np.minimum.at(known, index, least)
    # laid end to end, a zero after each
    width = size[example] + 1
    begin = np.cumsum(width) - width
    line = np.zeros(int(width.sum()), np.uint8)
    held = np.ones(len(line), bool)
    held[begin + width - 1] = False
    line[held], _ = ragged(text, at[example], size[example])
    whole = np.ones(len(line), bool)  # places with MATCH bytes left
    whole[np.repeat(begin + width - MATCH, MATCH) + np.tile(np.arange(MATCH), len(begin))] = False
    places_of = suffixes.suffix_order(line, whole)
    group = np.cumsum(~suffixes.alike(places_of, line, MATCH)) - 1
    owner = known[np.searchsorted(begin, places_of, "right") - 1]
    low = np.minimum.reduceat(owner, np.flatnonzero(np.append(True, group[1:] != group[:-1])))
    result = np.zeros(len(line), np.int64)
    result[places_of] = low[group]
    # runs of strings of one smallest id, by segment
    n = size - MATCH + 1
    value, _ = ragged(result, begin[index], n)
    of = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)
    ok = value < most[of]
    value, of, nth = value[ok], of[ok], nth[ok]
    if not len(value):
        return pa.table({"flush": pa.array([], pa.int64()), "found": pa.array([], pa.binary())})
    new = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1]) | (nth[1:] != nth[:-1] + 1)))
    length, value, of, nth = np.diff(np.append(new, len(value))), value[new], of[new], nth[new]
    times = copies[of]
    out = np.zeros(int(times.sum()), _FOUND)
    where, _ = ragged(places, (np.cumsum(copies) - copies)[of], times)
    out["place"], out["strings"], out["least"] = where + np.repeat(nth, times), np.repeat(length, times), np.repeat(value, times)
    flush = np.repeat(np.repeat(np.array([r["flush"] for r in rows]), [len(x) for x in part["sizes"]])[of], times)
    cut = np.flatnonzero(np.append(True, flush[1:] != flush[:-1]))  # segments of a flush stand together
    parts = [out[x:y].tobytes() for x, y in zip(cut, np.append(cut[1:], len(flush)), strict=True)]
    return pa.table({"flush": pa.array(flush[cut], pa.int64()), "found": pa.array(parts, pa.binary())})


# ---------------------------------------------------------------- removal


def _removed(key, own, found):
    """doc_id, n_bytes, the removed runs, and what is left of each text of a flush."""
    import pyarrow as pa

    _, data, at, ids, known, copy = _texts(own, found)
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, at[:-1][copy], 1)
    np.add.at(step, at[1:][copy], -1)
    hits = found.column("found").drop_null().to_pylist()
    if hits:
        hit = np.concatenate([np.frombuffer(x, _FOUND) for x in hits])
        place = hit["place"].astype(np.int64)
        hit, place = (x[ids[np.searchsorted(at, place, "right") - 1] > hit["least"]] for x in (hit, place))
        np.add.at(step, place, 1)
        np.add.at(step, place + hit["strings"] + MATCH - 1, -1)
    gone = np.cumsum(step[:-1]) > 0
    s, e, first = C.spans_of(gone, at)
    row_of = np.searchsorted(at, s, "right") - 1
    base = at[row_of]
    spans = pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - base)], names=["start", "stop"])
    left = np.concatenate(([0], np.cumsum(~gone)))[at]
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(left), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
    return pa.table({
        "doc_id": pa.array(ids, pa.int64(), mask=~known), "n_bytes": pa.array(np.diff(at)),
        "removed": pa.ListArray.from_arrays(pa.array(first, pa.int32()), spans), "kept": kept.cast(pa.binary()),
    })


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (runs of bytes that go: start, stop), kept (the other bytes) for every row of docs."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    table = flushes(docs, total)
    bits = max(0, math.ceil(math.log2(max(1, total * 5 / 18 / ANCHOR_BYTES))))
    by_flush, same = table.groupBy("flush"), C.saved(copies(table), "copies")
    with_same = lambda df: df.unionByName(same, allowMissingColumns=True).groupBy("flush")
    sent = by_flush.cogroup(same.groupBy("flush")).applyInArrow(_sent(bits), "bucket long, flush long, keys binary")
    shared = C.saved(sent.groupBy("bucket").applyInArrow(_shared, "flush long, anchors binary"), "anchors")
    count = (shared.agg(F.sum(F.octet_length("anchors").cast("long"))).first()[0] or 0) / 8
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(count * 67 / BUCKET_BYTES))
    segments = by_flush.cogroup(with_same(shared)).applyInArrow(_segments(bits, buckets), _SEGMENTS)
    found = C.saved(segments.groupBy("bucket").applyInArrow(_sorted, "flush long, found binary"), "found")
    schema = "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary"
    return by_flush.cogroup(with_same(found)).applyInArrow(_removed, schema)


def query(spark, sf_dir: str) -> DataFrame:
    rows = without_repeats(C.documents(spark, sf_dir))
    lengths = F.transform("removed", lambda x: x["stop"] - x["start"])
    return rows.select(
        "doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE = f"""
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT doc_id, 500 * j + k AS k, substr(x, 2 * k + 1, {2 * MATCH}) AS s FROM (
    SELECT doc_id, j, x, unnest(range(0, len(x) // 2 - {MATCH - 1})) AS k FROM (
      SELECT doc_id, j, substr(x, 1000 * j + 1, {1000 + 2 * MATCH - 2}) AS x FROM (SELECT doc_id, x, unnest(range(0, (n + 499) // 500)) AS j FROM h)
    ) WHERE len(x) // 2 >= {MATCH}
  )
), c AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id
), i AS (
  SELECT doc_id, k, sum(jump) OVER (PARTITION BY doc_id ORDER BY k) AS run
  FROM (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= {MATCH} THEN 0 ELSE 1 END AS jump FROM c)
), r AS (
  SELECT doc_id, min(k) AS a, max(k) + {MATCH} AS b FROM i GROUP BY doc_id, run
), g AS (
  SELECT r.doc_id, a, b, substr(x, 2 * coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0))) AS before
  FROM r JOIN h ON h.doc_id = r.doc_id
), s AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(before, '' ORDER BY a) AS kept FROM g GROUP BY doc_id
)
SELECT h.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN s ON s.doc_id = h.doc_id
"""
