"""Near-duplicate classes with SetSketch registers (operator 2).

A document's set holds its distinct five-word shingles.  Every non-empty set gets a SetSketch:
M registers, each the floor of the (negated, base-B) logarithm of the smallest of the set's
exponential hash values, so registers of a union are the maxima of the parts' registers, and two
sets agree in a register with a probability close to their Jaccard similarity.

1. One pass over the texts makes set size, a 128-bit set digest and the registers.
2. Documents with equal sets fold into their smallest id; only these classes go on, so thousands
   of exact copies are one row here.
3. ROWS registers form a band.  Each band value has a few pivots (found by plain aggregates);
   its other members are paired with the pivots only, so pairs grow as the members.
4. A pair's similarity is estimated from its registers and set sizes together by maximum
   likelihood; clearly dissimilar pairs go.  The rest are confirmed on the full sets.
5. Classes are joined by contraction of the confirmed links.  Band values whose members are still
   in several components have their pairs across components found too: one by one where members
   are few, through an exact prefix filter on rare shingles where they are many.  So no link
   between documents that share a band is lost.

With similarity 0.75 a pair shares no band with probability (1 - 0.75**4)**32 = 5e-6.

Nulls and empty texts have an empty set, which is linked with nothing.  Rows that share a doc_id
are one document with the links of all of its rows.  A null doc_id is never linked and is kept.
Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

SHINGLE = 5
BANDS, ROWS = 32, 4
M = BANDS * ROWS
#: SetSketch's base, rate and number of register values.
B, RATE, Q = 1.001, 20.0, (1 << 16) - 2
#: Links hold 100 * intersection >= 75 * union.
PERCENT = 75
#: Estimates below this are no links: some five standard deviations under the threshold.
LEAST_ESTIMATE = 0.55
#: Band values with up to so many members have their pairs across components looked at one by one;
#: others go through an exact prefix filter.
FEW = 8
#: Documents whose ids are broadcast to pick texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of a shingle that make up one block; pairs are looked for in cells of two blocks.
CELL = 512

_U64 = np.uint64
_SEED = C.mix(np.arange(1, M + 1, dtype=_U64) * _U64(0x2545F4914F6CDD1D))
_ODD = C.mix(_SEED + _U64(77)) | _U64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and each row's first."""
    _, _, first, h = C.words(data, at, fold_case=True)
    win = C.windows(h, k)
    parts, size = [], np.zeros(len(at), np.int64)
    for r in range(len(at) - 1):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= k:
            x = np.sort(win[a : b - k + 1])
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            padded = np.concatenate((h[a:b], np.full(k - b + a, b - a, _U64)))
            x = C.windows(padded, k)
        else:
            continue
        parts.append(x)
        size[r + 1] = len(x)
    return (np.concatenate(parts) if parts else np.zeros(0, _U64)), np.cumsum(size)


def registers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SetSketch registers (rows x M) of non-empty sets given one after the other."""
    low = np.empty((M, len(starts)), _U64)
    for i in range(M):
        low[i] = np.minimum.reduceat((values ^ _SEED[i]) * _ODD[i], starts)
    u = (low.T.astype(np.float64) + 0.5) / 2.0**64
    smallest = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merged(left, right):
    """Registers of a union: the larger of either register (Spark columns of register arrays)."""
    return F.zip_with(left, right, lambda x, y: F.greatest(x, y))


def _sketch(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for i, j, data, at in C.chunks(batch.column("text")):
            values, first = shingle_sets(data, at)
            n = np.diff(first)
            full = np.flatnonzero(n)
            d1, d2 = np.zeros(j - i, _U64), np.zeros(j - i, _U64)
            bands = np.zeros((len(full), BANDS), np.int64)
            if len(full):
                starts = first[:-1][full]
                d1[full] = np.add.reduceat(C.mix(values ^ _U64(0x1F83D9ABFB41BD6B)), starts)
                d2[full] = np.add.reduceat(C.mix(values ^ _U64(0x5BE0CD19137E2179)), starts)
                bands = np.ascontiguousarray(registers(values, starts)).view(np.int64)
            where = np.concatenate(([0], np.cumsum((n > 0) * BANDS))).astype(np.int32)
            packed = pa.ListArray.from_arrays(where, pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array(n), pa.array(C.signed(d1)), pa.array(C.signed(d2)), packed],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set digest (d1, d2) and the registers, ROWS to a long, by band."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _sketch, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
    )


def _sets(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for i, j, data, at in C.chunks(batch.column("text")):
            values, first = shingle_sets(data, at)
            sets = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(C.signed(values)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), sets], names=["id", "items"])


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (B - 1) / B) / np.log(B)


def jaccard_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs from registers (pairs x M) and set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u / v, v / u)

    def likelihood(j):
        x, y = _p(np.maximum(u - v * j, 1e-12)), _p(np.maximum(v - u * j, 1e-12))
        return more * np.log(x) + less * np.log(y) + same * np.log(np.maximum(1 - x - y, 1e-12))

    low, high = np.zeros(len(u)), most.copy()
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(30):  # the likelihood has one peak
        p, q = high - golden * (high - low), low + golden * (high - low)
        left = likelihood(p) >= likelihood(q)
        high, low = np.where(left, q, high), np.where(left, low, p)
    return (low + high) / 2


def _estimate(batches: Iterator) -> Iterator:
    import pyarrow as pa

    def unpacked(column):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return np.ascontiguousarray(flat, np.int64).view(np.uint16).reshape(-1, M)

    for batch in batches:
        if batch.num_rows:
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
            est = jaccard_estimate(unpacked(batch.column("bands_a")), unpacked(batch.column("bands_b")), n_a, n_b)
            ok = np.flatnonzero(est >= LEAST_ESTIMATE)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(ok)), batch.column("b").take(pa.array(ok))], names=["a", "b"])


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and registers leave a link possible."""
    left = reps.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("bands").alias("bands_a"))
    right = reps.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("bands").alias("bands_b"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return both.mapInArrow(_estimate, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets hold the link."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return both.where(
        100 * shared >= PERCENT * (F.size("items_a") + F.size("items_b") - shared)
    ).select("a", "b").distinct()


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the given ids (column id, distinct)."""
    n = ids.count()
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"
    )


def _size_fits(x: str, y: str):
    return 100 * F.least(f"{x}.n_shingles", f"{y}.n_shingles") >= PERCENT * F.greatest(f"{x}.n_shingles", f"{y}.n_shingles")


def _across(rows: DataFrame, keys: list[str], fits=_size_fits) -> DataFrame:
    """Pairs (a, b) that share the keys, lie in different components and fit by size."""
    x, y = rows.alias("x"), rows.alias("y")
    return x.join(
        y,
        reduce(and_, (F.col(f"x.{key}") == F.col(f"y.{key}") for key in keys))
        & (F.col("x.rep") < F.col("y.rep"))
        & (F.col("x.component") != F.col("y.component"))
        & fits("x", "y"),
    ).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _place_fits(x: str, y: str):
    """Sizes fit, and enough shingles are left from the shared one's place on, as from the first shared one."""
    left = F.least(F.col(f"{x}.n_shingles") - F.col(f"{x}.place"), F.col(f"{y}.n_shingles") - F.col(f"{y}.place"))
    return _size_fits(x, y) & ((100 + PERCENT) * left >= PERCENT * (F.col(f"{x}.n_shingles") + F.col(f"{y}.n_shingles")))


def _prefix_pairs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs across components of the documents in rows that can hold a link, found exactly.

    Shingles are put in order from rare to frequent.  Two sets that hold the link share one of
    their first n - ceil(0.75 n) + 1 shingles, and these are rare: in a family of copies with
    many edits they are the edits, so pairs grow with real overlaps, not with the family squared.
    """
    docs = rows.select("rep", "component", "n_shingles").distinct()
    each = docs.join(sets.withColumnRenamed("id", "rep"), "rep").select("rep", F.explode("items").alias("item")).distinct()
    # aggregates by shingle are written before they are joined: Spark then sends small ones to all tasks and splits skewed ones
    often = C.saved(each.groupBy("item").agg(F.count("*").alias("f")), "often")
    first = F.col("n") - F.ceil(F.col("n") * (PERCENT / 100)) + 1
    prefix = each.join(often, "item").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("o"))
    prefix = prefix.withColumn("n", F.size("o")).select("rep", F.posexplode(F.slice("o", F.lit(1), first.cast("int"))).alias("place", "s"))
    prefix = prefix.where("s.f > 1").select("rep", "place", F.col("s.item").alias("item")).join(docs, "rep")
    prefix = C.saved(prefix, "prefixes")
    # a partner has as many shingles as the item's smallest set at least: rows that could not even meet that one go.
    # So a shingle of a whole family stays only in the sets that have it early, and these are mostly one component.
    smallest = prefix.groupBy("item").agg(F.min("n_shingles").alias("smallest"), F.min("component").alias("low"), F.max("component").alias("high"))
    smallest = C.saved(smallest.where("low < high").select("item", "smallest"), "smallest")
    can = (100 + PERCENT) * (F.col("n_shingles") - F.col("place")) >= PERCENT * (F.col("n_shingles") + F.col("smallest"))
    return _met(_dealt(C.saved(prefix.join(smallest, "item").where(can).drop("smallest"), "early")))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows with block and cell (low, high): all pairs across components of a shingle's rows meet in one cell, of two blocks at most.

    A shingle's largest component meets the others only, and these each other too, so copies of a row are at most some
    three in CELL of the pairs to look at; shingles of one component go.
    """
    of = rows.groupBy("item", "component").agg(F.count("*").alias("c"))
    of = of.groupBy("item").agg(F.max(F.struct("c", "component")).alias("most"), F.sum("c").alias("f")).where("most.c < f")
    blocks = lambda n: F.ceil(n / CELL).cast("int")
    of = of.select("item", F.col("most.component").alias("main"), blocks(F.col("most.c")).alias("mains"), blocks(F.col("f") - F.col("most.c")).alias("others"))
    rows = rows.join(C.saved(of, "blocks"), "item").withColumn("last", F.col("mains") + F.col("others") - 1)
    main, at = F.col("component") == F.col("main"), F.xxhash64("rep")
    rows = rows.withColumn("block", F.when(main, F.pmod(at, "mains")).otherwise(F.col("mains") + F.pmod(at, "others")).cast("int"))
    rows = rows.withColumn("meets", F.explode(F.sequence(F.when(main, F.col("mains")).otherwise(F.lit(0)), "last")))
    return rows.withColumn("low", F.least("block", "meets")).withColumn("high", F.greatest("block", "meets"))


def _met(cells: DataFrame) -> DataFrame:
    """Pairs (a, b) of a cell's rows; rows of one block meet in that block's own cell only."""
    apart = (F.col("x.block") != F.col("y.block")) | (F.col("x.low") == F.col("x.high"))
    return _across(cells, ["item", "low", "high"], lambda x, y: _place_fits(x, y) & apart)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    with C.small_batches(docs.sparkSession):  # all that runs Python is written in here
        return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    sk = C.saved(sketches(docs), "sketches")
    keys = ["d1", "d2", "n_shingles"]
    groups = sk.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy(keys).agg(F.min("doc_id").alias("rep"))
    groups = C.saved(groups, "classes")
    path = C.scratch_path(docs.sparkSession, "components")
    with C.passing(docs.sparkSession):
        parts = C.written(_parts(docs, sk, groups, keys), path)

    rows = sk.select("doc_id", *keys).join(groups, keys, "left")
    rows = rows.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    )


def _parts(docs: DataFrame, sk: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """node, component of every class that has links, from sketches and classes."""
    reps = C.saved(
        sk.join(groups, keys).where(F.col("doc_id") == F.col("rep")).select("rep", "n_shingles", "bands").dropDuplicates(["rep", "bands"]), "class-sketches"
    )
    banded = reps.select("rep", "n_shingles", F.posexplode("bands").alias("band", "value"))
    banded = banded.select("rep", "n_shingles", F.xxhash64("band", "value").alias("k"))

    # pivots: smallest ids in four orders of the ids
    orders = [0, -1, 0x5555555555555555, 0x333333333333333]
    picks = [F.min(F.col("rep").bitwiseXOR(F.lit(x))).alias(f"p{i}") for i, x in enumerate(orders)]
    buckets = banded.groupBy("k").agg(*picks)
    buckets = buckets.select(
        "k", F.array_distinct(F.array(*[F.col(f"p{i}").bitwiseXOR(F.lit(x)) for i, x in enumerate(orders)])).alias("pivots")
    ).where(F.size("pivots") > 1)
    buckets = C.saved(buckets, "buckets")
    members = C.saved(banded.join(buckets, "k").select("k", "rep", "n_shingles", "pivots"), "members")

    paired = members.select("rep", F.explode("pivots").alias("pivot")).where("rep <> pivot")
    pairs = paired.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    looked = C.saved(_likely(pairs, reps), "pairs")
    sets = C.saved(_texts(docs, members.select(F.col("rep").alias("id")).distinct()).mapInArrow(_sets, "id long, items array<long>"), "sets")
    links = C.saved(_confirmed(looked, sets), "links")
    parts = C.saved(components(links), "parts")

    # band values whose members lie in several components: the pairs across them
    placed = members.select("k", "rep", "n_shingles").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    split = placed.groupBy("k").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("of"))
    split = C.saved(split.where("low < high").select("k", "of"), "split")
    placed = C.saved(placed.join(split, "k"), "unsettled")
    across = _across(placed.where(F.col("of") <= FEW), ["k"]).unionByName(_prefix_pairs(placed.where(F.col("of") > FEW), sets))
    across = across.distinct().join(looked, ["a", "b"], "left_anti")
    more = C.saved(_confirmed(_likely(across, reps), sets), "more-links")
    # these join whole components
    for end in ("a", "b"):
        to = parts.select(F.col("node").alias(end), F.col("component").alias("to"))
        more = more.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    joined = C.saved(components(more).select(F.col("node").alias("part"), F.col("component").alias("whole")), "joined")
    known = parts.unionByName(joined.select(F.col("part").alias("node"), F.col("part").alias("component"))).distinct()
    parts = known.join(joined, F.col("component") == F.col("part"), "left").select("node", F.coalesce("whole", "component").alias("component"))
    return parts.distinct()


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest doc_id."""
    path = C.scratch_path(spark, "copies")
    with C.passing(spark):
        gone = C.written(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), path)
    return C.without(docs, gone)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE ws[i : i + 4] END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * shared >= 75 * (na.n + nb.n - shared)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c::BIGINT AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
