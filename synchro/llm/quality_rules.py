"""Quality rules with an isolation forest (operator 10).

Base rules count words, characters, symbols, repeated lines and repeated five-word windows.  Shares
made of them describe a document; an isolation forest of TREES random trees isolates unusual ones: the shorter the mean path, the
more anomalous.  All documents grow it: a hash of doc_id deals each to one tree, or in a small table to as many as give a tree
SUBSAMPLE rows.  The trees grow level by level together; for each level tasks send the ranges of the shares in every node.  A
tree has the levels of one of SUBSAMPLE rows; where it ends, paths go on by the mean for the rows there.  The verdict's threshold, a
multiple of 1 / GRID, has the least errors on all labelled rows.  A document is kept unless a base rule or the forest rejects it.

Null, empty and wordless texts have zero counts and fail the base rules.  Rows are judged one by one,
so repeated ids don't matter.  Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .rule_stats import statistics

TREES, SUBSAMPLE, GRID = 100, 256, 1 << 16
PARTS, HELD = 3, 1
#: A good row rejected weighs so much, where either label has as many rows; the corpus is mostly good.
GOOD_WEIGHT = 10
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = 8


def _mean_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n <= 1, 0.0, 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m)


class Forest:
    """Isolation trees in arrays; `path` holds a leaf's depth with what its rows would add."""

    def __init__(self, x: np.ndarray):
        self._start(len(x), x.shape[1])
        while self.level <= self.depth:
            self.grow(*self.ranges(x, np.arange(len(x))))

    @classmethod
    def blank(cls, n: int) -> Forest:
        """A forest for n rows of SHARES columns, to be grown level by level."""
        out = cls.__new__(cls)
        out._start(n, SHARES)
        return out

    def _start(self, n: int, columns: int) -> None:
        self.each = min(TREES, max(1, -(-TREES * SUBSAMPLE // max(n, 1))))
        size = n * self.each / TREES
        self.scale, self.depth = max(float(_mean_path(size)), 1e-9), max(1, int(np.ceil(np.log2(min(max(size, 2), SUBSAMPLE)))))
        self.level, self.columns = 0, columns
        shape = (TREES, 2 ** (self.depth + 1))
        self.feature, self.cut, self.path = np.full(shape, -1, np.int16), np.zeros(shape), np.zeros(shape)

    def ranges(self, x: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nodes of the level that is to be grown: number, rows, least and largest values; a row is in `each` trees from its mark on."""
        t = ((mark[:, None] + np.arange(self.each)) % TREES).reshape(-1)
        row, k = np.repeat(np.arange(len(x)), self.each), np.ones(len(t), np.int64)
        for _ in range(self.level):
            f = self.feature[t, k]
            right = x[row, np.maximum(f, 0)] >= self.cut[t, k]
            k = np.where(f >= 0, 2 * k + right, k)
        here = np.flatnonzero(k >= 2**self.level)
        node = t[here] * self.feature.shape[1] + k[here]
        order = np.argsort(node, kind="stable")
        nodes, first, n = np.unique(node[order], return_index=True, return_counts=True)
        own = x[row[here[order]]]
        if not len(nodes):
            return nodes, n, own, own
        return nodes, n, np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)

    def grow(self, nodes: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """One level more: a random cut in a random column that isn't constant, for each node (ascending numbers)."""
        rng = np.random.default_rng((10, self.level))
        t, k = np.divmod(nodes, self.feature.shape[1])
        wide = high > low
        leaf = (n <= 1) | ~wide.any(1) | (self.level == self.depth)
        self.path[t[leaf], k[leaf]] = self.level + _mean_path(n[leaf])
        t, k, wide, low, high = t[~leaf], k[~leaf], wide[~leaf], low[~leaf], high[~leaf]
        pick = (rng.random(len(t)) * wide.sum(1)).astype(int) + 1
        f = (wide & (wide.cumsum(1) == pick[:, None])).argmax(1)
        every = np.arange(len(t))
        self.feature[t, k], self.cut[t, k] = f, low[every, f] + rng.random(len(t)) * (high - low)[every, f]
        self.level += 1
        for child in (2 * k, 2 * k + 1):  # one without rows ends here
            self.path[t, child] = self.level

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; near 1 isolated after few splits."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for t in range(TREES):
            k = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, k]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[every, np.maximum(f, 0)] >= self.cut[t, k]
                k = np.where(inner, 2 * k + right, k)
            total += self.path[t, k]
        return 2 ** (-total / TREES / self.scale)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, whether there is a text, counts, base_failed and shares of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            given = batch.column("text").is_valid()
            for i, j, data, at in C.chunks(batch.column("text")):
                got = statistics(data, at)
                n, x = got["n_words"], got["shares"]
                failed = (n < LEAST_WORDS) | (100 * got["n_repeat_words"] > MOST_REPEATED_PERCENT * n)
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, SHARES, dtype=np.int32), pa.array(x.reshape(-1)))
                columns = [pa.array(got[k].astype(np.int64)) for k in COUNTS] + [pa.array(failed), lists]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), given.slice(i, j - i), *columns], names=["doc_id", "given", *COUNTS, "base_failed", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{k} long" for k in COUNTS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, given boolean, {counts}, base_failed boolean, x array<double>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, SHARES)


def grown(rows: DataFrame, n: int) -> Forest:
    """A forest of all n rows of `measured`."""
    forest = Forest.blank(n)
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(TREES)).alias("mark"), "x")
    low, high = [f"low{k}" for k in range(SHARES)], [f"high{k}" for k in range(SHARES)]
    names = ["node", "n", *low, *high]
    while forest.level <= forest.depth:
        sent = rows.sparkSession.sparkContext.broadcast(forest)  # of fixed size: TREES small trees

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                nodes, count, least, most = sent.value.ranges(_matrix(batch.column("x")), batch.column("mark").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (nodes, count, *least.T.copy(), *most.T.copy())], names=names)

        got = rows.mapInArrow(run, "node long, n long, " + ", ".join(f"{c} double" for c in low + high)).groupBy("node")
        got = got.agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in low), *(F.max(c).alias(c) for c in high)).toPandas().sort_values("node")  # one row a node
        forest.grow(got["node"].to_numpy(np.int64), got["n"].to_numpy(np.int64), got[low].to_numpy(float), got[high].to_numpy(float))
    return forest


def fit_measured(rows: DataFrame, marks: DataFrame) -> tuple[Forest, float] | None:
    """The forest of all rows and its threshold by all labelled ones; None without rows or without both labels."""
    n = rows.count()
    if not n:
        return None
    forest = grown(rows, n)
    labelled = C.labelled(marks, "quality", PARTS, HELD)
    own = anomalies(rows.where("given"), forest).join(labelled, "doc_id").groupBy("doc_id").agg(F.min("anomaly").alias("anomaly"), F.min("label").alias("label"))
    step = F.least(F.floor(F.col("anomaly") * GRID), F.lit(GRID - 1)).alias("step")
    got = own.groupBy("label", step).agg(F.count("*").alias("n")).toPandas()  # at most GRID steps
    by = np.zeros((2, GRID))
    by[got["label"].to_numpy(int), got["step"].to_numpy(int)] = got["n"]
    if not by.any(1).all():
        return None
    bad, good = by / by.sum(1, keepdims=True)
    return forest, C.least_errors(GOOD_WEIGHT * good, bad) / GRID


def fit(docs: DataFrame, marks: DataFrame) -> tuple[Forest, float] | None:
    return fit_measured(C.saved(measured(docs), "measured"), marks)


def anomalies(rows: DataFrame, forest: Forest | None) -> DataFrame:
    """Rows of `measured` with anomaly; 0 without a forest."""
    sent = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = sent.value.anomaly(_matrix(batch.column("x"))) if sent.value else np.zeros(batch.num_rows)
            yield batch.drop_columns(["x"]).append_column("anomaly", pa.array(x))

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "x"]
    return rows.mapInArrow(run, ", ".join([*kinds, "anomaly double"]))


def verdicts(rows: DataFrame, model: tuple[Forest, float] | None) -> DataFrame:
    """doc_id, counts, base_failed, anomaly, kept of rows of `measured`."""
    forest, cut = model or (None, 1.0)
    kept = ~F.col("base_failed") & (F.col("anomaly") < cut)
    return anomalies(rows, forest).select("doc_id", *COUNTS, "base_failed", "anomaly", kept.alias("kept"))


def judged(docs: DataFrame, model: tuple[Forest, float] | None) -> DataFrame:
    return verdicts(measured(docs), model)


def query(spark, sf_dir: str) -> DataFrame:
    rows = C.saved(measured(C.documents(spark, sf_dir)), "measured")  # texts are read once
    return verdicts(rows, fit_measured(rows, C.labels(spark, sf_dir)))
