"""Spelling variants by asymmetric q-chunks (operator 12).

Words are counted over all documents; two words are near if one code point is inserted, deleted or replaced.

1. One pass finds the runs of letters of each text, their CRC-32 and the deletion it may ask for, and counts
   words by block of texts, by their bytes; Spark sums the blocks, so a frequent word is one row a block.
2. A word of m code points is cut in two disjoint chunks, of m // 2 code points and of the rest.  One edit touches one of
   them at most, so the other stands in the near word whole, moved by no more than one place.
3. The other word, of m or m + 1 code points, gives its positional grams as long as those chunks.  Where the first chunk is preserved it is at
   place 0, and where the second one is, its shift is the difference of lengths; grams at places where only a chance match
   could stand are not made.  Chunk and gram meet in an equi-join on length, side and string.
4. What meets is verified by edit distance in the join itself, and a pair that shares both chunks counts once.  Only near pairs leave the join, and no row
   is made for the pairs of a chunk that fail; Spark splits the rows of a chunk that very many words share.
5. Forms rise in frequency, so following them ends; roots are found by doubling the steps, in rounds of joins.

Null and empty texts have no words.  A null doc_id has no CRC, so nothing is deleted there.  Texts of any length are
taken whole (a run of letters of any length is one word).  Rows that repeat a doc_id count each.  Ties of forms go to the word first in code-point order.  An empty
table, or one of rare words only, gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .merkle import CRC_TABLE, crc32_sql

#: Fixed values of the contract: every so many-th CRC asks for a deletion; least code points and occurrences of a word; how much more frequent a form is.
ONE_IN, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Bytes of text whose words are counted at a time (one longer text is taken whole).
BLOCK_BYTES = 2 << 20
#: Runs up to this many bytes have their CRC computed side by side.
SHORT = 48

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = np.where(v & 1, (v >> 1) ^ np.uint32(0xEDB88320), v >> 1)
    return v


_CRC = _crc_table()


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all maximal runs of letters one after the other, their offsets, and each run's row."""
    inside = _LETTER[data]
    if len(data) > 1:
        inside[1:] |= data[:-1] == 0xC3  # U+00C0 to U+00FF are 0xC3 and one more byte
    s, e, first = C.spans_of(inside, at)
    return _LOWER[data[inside]], np.concatenate(([0], np.cumsum(e - s))), np.repeat(np.arange(len(at) - 1), np.diff(first))


def crcs(ids: list, text: np.ndarray, off: np.ndarray, row: np.ndarray) -> np.ndarray:
    """crc32 of `<doc_id>:<run>` for each run; ids: of the rows."""
    head = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    crc = head[row[order]] ^ np.uint32(0xFFFFFFFF)
    sizes, start = size[order], off[:-1][order]
    long = int(np.searchsorted(-sizes, -SHORT, "left"))
    for k in range(int(sizes[long]) if long < len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -k, "left"))  # runs of more than k bytes
        c = crc[long:m]
        crc[long:m] = _CRC[(c ^ text[start[long:m] + k]) & 0xFF] ^ (c >> np.uint32(8))
    for j in range(long):
        crc[j] = zlib.crc32(text[start[j] : start[j] + sizes[j]].tobytes(), int(head[row[order[j]]])) ^ 0xFFFFFFFF
    out = np.empty(len(crc), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def edited(ids: list, text: np.ndarray, off: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and code points of the runs after the deletions."""
    begins = (text & 0xC0) != 0x80
    so_far = np.concatenate(([0], np.cumsum(begins)))
    points = so_far[off[1:]] - so_far[off[:-1]]
    h = crcs(ids, text, off, row).astype(np.int64)
    known = np.array([i is not None for i in ids], bool)
    hit = np.flatnonzero((h % ONE_IN == 0) & known[row])
    gone = np.zeros(len(text) + 1, bool)
    place = np.flatnonzero(begins)[so_far[off[:-1][hit]] + h[hit] % points[hit]]
    gone[place] = True
    gone[place + 1] |= text[place] == 0xC3
    gone = gone[:-1]
    points = points.copy()
    points[hit] -= 1
    return text[~gone], off - np.concatenate(([0], np.cumsum(gone)))[off], points


def _counted(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        all_ids = batch.column("doc_id").to_pylist()
        for i, j, data, at in C.chunks(batch.column("text"), BLOCK_BYTES):
            text, off, row = runs(data, at)
            if not len(row):
                continue
            text, off, points = edited(all_ids[i:j], text, off, row)
            words = pa.LargeStringArray.from_buffers(len(points), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text)))
            found = pc.value_counts(words.filter(pa.array(points >= LEAST_LENGTH)))
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: words of enough code points and occurrences."""
    counts = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def chunks(words: DataFrame) -> DataFrame:
    """x, m (its code points), side and chunk: two rows a word."""
    m = F.char_length("x")
    cut = F.floor(m / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("x", F.lit(1), cut).alias("chunk")), F.struct(F.lit(1).alias("side"), F.substring("x", cut + 1, m - cut).alias("chunk")))
    return words.select(F.col("word").alias("x"), F.col("n").alias("n_x")).select("x", "n_x", m.alias("m"), F.inline(sides))


def grams(words: DataFrame) -> DataFrame:
    """y and its positional grams that a chunk of a word of m code points can match: m is y's length, or one less."""
    rows = []
    for shorter in (0, 1):
        m = F.char_length("y") - shorter
        cut = F.floor(m / 2).cast("int")
        rows += [
            F.struct(m.alias("m"), F.lit(0).alias("side"), F.substring("y", F.lit(1), cut).alias("chunk")),
            F.struct(m.alias("m"), F.lit(1).alias("side"), F.substring("y", cut + 1 + shorter, m - cut).alias("chunk")),
        ]
    return words.select(F.col("word").alias("y"), F.col("n").alias("n_y")).select("y", "n_y", F.inline(F.array(*rows)))


def near(words: DataFrame) -> DataFrame:
    """x, n_x, y, n_y: every pair of near words once, the shorter first (of equal length: the one first in order)."""
    cut = F.floor(F.col("m") / 2).cast("int")
    both = F.substring("x", F.lit(1), cut) == F.substring("y", F.lit(1), cut)
    found = chunks(words).join(grams(words), ["m", "side", "chunk"]).where((F.char_length("y") > F.col("m")) | (F.col("x") < F.col("y")))
    found = found.where((F.col("side") == 0) | ~both).where(F.levenshtein("x", "y", 1) == 1)
    return found.select("x", "n_x", "y", "n_y")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for every word with a form: steps are doubled until none moves."""
    now = C.saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = C.saved(now.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word."""
    words = C.saved(vocabulary(docs), "words")
    pairs = near(words)
    sides = F.array(F.struct(F.col("x").alias("word"), F.col("y").alias("other"), F.col("n_y").alias("k")), F.struct(F.col("y").alias("word"), F.col("x").alias("other"), F.col("n_x").alias("k")))
    best = pairs.select(F.inline(sides)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("k")).alias("less"), F.col("other"))).alias("best"))
    out = words.join(best, "word", "left")
    most = -F.col("best.less")
    chosen = most >= RATIO * F.col("n")
    out = out.select("word", F.when(chosen, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, most).alias("form_n"))
    out = C.saved(out, "variants")
    out = out.join(roots(out.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(C.documents(spark, sf_dir))


_BYTES = "flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))"
ORACLE = f"""
WITH RECURSIVE {CRC_TABLE}, r AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
  ) GROUP BY doc_id, run
), h AS (
  SELECT run, c, {crc32_sql(_BYTES)} AS h FROM r, crc_table
), w AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {ONE_IN} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h
  ) WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}
), v AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), p AS (
  SELECT DISTINCT a.word AS x, b.word AS y, b.n AS n FROM v a JOIN v b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM w a JOIN v b ON b.d = a.word
  UNION SELECT b.word, a.word, a.n FROM w a JOIN v b ON b.d = a.word
), f AS (
  SELECT w.word, w.n, count(p.y) AS n_near, first(p.y ORDER BY p.n DESC, p.y) AS other, max(p.n) AS most FROM w LEFT JOIN p ON p.x = w.word GROUP BY w.word, w.n
), g AS (
  SELECT word, n, n_near, CASE WHEN most >= {RATIO} * n THEN other END AS form, CASE WHEN most >= {RATIO} * n THEN most END AS form_n FROM f
), t(word, top) AS (
  SELECT word, word FROM g UNION ALL SELECT t.word, g.form FROM t JOIN g ON g.word = t.top WHERE g.form IS NOT NULL
)
SELECT g.word, g.form, t.top AS root, g.n, g.n_near, g.form_n FROM g JOIN t ON t.word = g.word JOIN g e ON e.word = t.top AND e.form IS NULL
"""
