"""Toxicity by a convolutional text classifier (operator 5).

Words (runs of letters, digits and non-ASCII characters, A-Z folded) and, of longer ones, their first
STEMS characters are hashed into BUCKETS embeddings; a word's embedding is the sum of these, so new forms of a known
stem are told from the stem alone.  A bucket is tagged with the hash of its most frequent training key; keys of another
hash read the zero embedding, so rare words of a large corpus don't pass for known ones.  Filters of
WIDTHS words slide over a text, their largest responses are pooled, and a dense layer gives a logit.
All labelled rows outside the held-out fold train the net: in each of EPOCHS rounds every task trains on its rows, and parameters move by
the mean of the tasks' moves.  Bucket tags count the keys of all training texts.  Scoring runs in Arrow batches and takes
whole texts.  As a filter is linear in its words' embeddings, scoring looks up every key's part of
every filter in one table of BUCKETS rows.

Thresholds are calibrated by language on logits of nets that have not seen the row: FOLDS nets are trained, each
without one part of the training rows, and the net that scores is trained on all of them.
The language is guessed from the text's own function words, never taken from a column.  The score
is the logistic of logit minus threshold, so 0.5 is the threshold in every language.

Empty and null texts have no words; they get the score of no response, as clean.  Without labelled
rows of both kinds every score is 0.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 6, 4, (1, 2, 3)
#: At least EPOCHS passes (twice as many over fewer than SMALL rows, by 4-fold validation) and STEPS steps over batches of BATCH rows.
EPOCHS, SMALL, STEPS, BATCH, RATE = 4, 8000, 100, 64, 0.01
PARTS, HELD, FOLDS, STEMS = 5, 0, 4, (4, 6, 8)
#: Widths of filters and places in them, in the order in which tables and parts have them.
PLACES = [(w, j) for w in WIDTHS for j in range(w)]
#: Steps of logits from -REACH to REACH that thresholds lie between, and blocks that a net's parameters travel in.
GRID, REACH, BLOCKS = 1 << 16, 32.0, 16
#: Rows that a training task has about, at least, and bytes of ids that it holds at a time.
TASK_ROWS, SEGMENT = 4000, 64 << 20
#: Share of a text's keys that a training step leaves out, so that no single word decides alone.
DROP = 0.5
#: Weight of rows of other languages in a language's threshold.
OTHER_LANGUAGE = 0.2
#: Frequent function words by language, to guess a text's language.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "this", "are", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "pas"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es"],
}
LANGUAGES = (*FUNCTION_WORDS, "other")

_INSIDE = np.zeros(256, bool)
_INSIDE[128:] = _INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = True


def keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (words x keys) of words and of their stems (0 where the word has no more characters), and each row's first word."""
    s, e, first = C.spans_of(_INSIDE[data], at)
    begins = (data & 0xC0) != 0x80
    points = np.concatenate((np.flatnonzero(begins), np.full(max(STEMS), len(data))))
    before = np.concatenate(([0], np.cumsum(begins)))  # characters that begin before a byte
    h, sums = np.zeros((len(s), 1 + len(STEMS)), np.uint64), C.feature_sums(data, fold_case=True)
    h[:, 0] = C.feature_hashes(data, s, e, fold_case=True, sums=sums)
    longer = np.arange(len(s))
    for k, size in enumerate(STEMS):  # ascending: what has no longer stem has none after it
        longer = longer[e[longer] - s[longer] > size]
        stem = points[before[s[longer]] + size]
        some = stem < e[longer]
        longer, stem = longer[some], stem[some]
        h[longer, k + 1] = C.mix(C.feature_hashes(data, s[longer], stem, fold_case=True, sums=sums) + np.uint64(size))
    return h, first


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS - 1)).astype(np.int32) + 1


def word_ids(h: np.ndarray, first: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Buckets (1..BUCKETS-1; 0 pads) of keys; rows end in padding."""
    pad = max(WIDTHS) - 1
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.zeros((len(h) + pad * (len(first) - 1), h.shape[1]), np.int32)
    at = _bucket(h)
    out[np.arange(len(h)) + pad * row] = np.where(tags[at] == h, at, 0)
    return out


def _counted(known: np.ndarray, n: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and how many texts hold each, with more texts (as distinct keys) counted in."""
    keys, place = np.unique(np.concatenate((known, *texts)), return_inverse=True)
    one = np.ones(sum(len(x) for x in texts), np.int64)
    return keys, np.bincount(place, np.concatenate((n, one)), len(keys)).astype(np.int64)


def _keyed(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of a column's texts, a bounded number of bytes at a time: they are many times as large as texts."""
    for _, _, data, at in C.chunks(column):
        yield keys(data, at)


def tagged(h: np.ndarray, n: np.ndarray, least: int = 3) -> np.ndarray:
    """For each bucket the key that most of the texts hold, 0 if under `least` do."""
    order = np.argsort(n, kind="stable")
    order = order[(n[order] >= least) & (h[order] != 0)]
    tags = np.zeros(BUCKETS, np.uint64)
    tags[_bucket(h[order])] = h[order]  # the last, most frequent one stays
    return tags


def _function_hashes() -> list[np.ndarray]:
    out = []
    for ws in FUNCTION_WORDS.values():
        raw = [w.encode() for w in ws]
        ends = np.cumsum([len(w) for w in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        out.append(np.sort(C.feature_hashes(data, np.concatenate(([0], ends[:-1])), ends, fold_case=True)))
    return out


def languages(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index in LANGUAGES for each row: most function words, 'other' without any."""
    known = _function_hashes()
    every = np.unique(np.concatenate(known))
    at = np.minimum(np.searchsorted(every, h), len(every) - 1)
    hit = np.flatnonzero(every[at] == h)
    row, at = np.searchsorted(first, hit, "right") - 1, at[hit]
    counts = np.array([np.bincount(row[np.isin(every, own)[at]], minlength=len(first) - 1) for own in known])
    return np.where(counts.max(0) > 0, counts.argmax(0), len(FUNCTION_WORDS))


def _summed(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each word the sum of its keys' rows of a table whose row 0 is zero."""
    x = table.take(ids[:, 0], axis=0)
    for key in range(1, ids.shape[1]):
        some = np.flatnonzero(ids[:, key])
        x[some] += table.take(ids[some, key], axis=0)
    return x


def _shifted(parts: np.ndarray, w: int, n: int) -> np.ndarray:
    """Responses of the filters of width w at the first n words (past the last word none adds): parts has a row for each place of each filter, as in PLACES."""
    at = FILTERS * PLACES.index((w, 0))
    z = parts[at : at + FILTERS, :n].copy()
    for j in range(1, w):
        more = parts[at + j * FILTERS : at + (j + 1) * FILTERS, j : j + n]
        z[:, : more.shape[1]] += more
    return z


class Net:
    """Embeddings, filters by width, and the dense layer, with Adam."""

    def __init__(self, log_odds: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"E": rng.normal(0, 0.1, (BUCKETS, DIM)), "v": np.full(FILTERS * len(WIDTHS), 0.5), "c": np.array([-1.0])}
        self.p["E"][:, 0] = log_odds
        self.p["E"][0] = 0
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 0.2, (w, DIM, FILTERS))
            self.p[f"W{w}"][0, 0] += 0.5
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.m = {k: np.zeros_like(x) for k, x in self.p.items()}
        self.s = {k: np.zeros_like(x) for k, x in self.p.items()}
        self.t = 0

    def step(self, ids: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One batch: rows are ids[first[r]:first[r + 1]], padded at their ends."""
        p, n = self.p, len(y)
        ids = np.concatenate((ids, np.zeros((1, ids.shape[1]), ids.dtype)))  # padding past the last row, for rows without a window
        x = _summed(p["E"], ids)
        parts = np.concatenate([p[f"W{w}"][j] for w, j in PLACES], 1).T @ x.T  # filters by words
        pooled, where = [], []
        for w in WIDTHS:
            z = _shifted(parts, w, len(ids) - w + 1)
            some = np.flatnonzero(np.diff(first) >= w)  # a row without words is shorter than the widest filter, which gives no response
            top, best = np.full((n, FILTERS), -np.inf), np.full((n, FILTERS), len(ids) - 1)
            for r in some:
                best[r] = first[r] + z[:, first[r] : first[r + 1] - w + 1].argmax(1)
            top[some] = np.take_along_axis(z.T, best[some], 0)
            pooled.append(top + p[f"b{w}"])
            where.append(best)
        a = np.concatenate(pooled, 1)
        active = np.maximum(a, 0)
        logit = active @ p["v"] + p["c"]
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / n
        g = {k: np.zeros_like(v) for k, v in p.items() if k != "E"}
        g["v"], g["c"] = active.T @ d, np.array([d.sum()])
        back = d[:, None] * p["v"] * (a > 0)
        touched, grads = [], []
        for k, w in enumerate(WIDTHS):
            b = back[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{w}"] = b.sum(0)
            for j in range(w):
                at = np.minimum(where[k] + j, len(ids) - 1)
                g[f"W{w}"][j] = np.einsum("nf,nfd->df", b, x[at])
                more = (b[:, :, None] * p[f"W{w}"][j].T).reshape(-1, DIM)
                for key in range(ids.shape[1]):
                    touched.append(ids[at, key].reshape(-1))
                    grads.append(more)
        rows, back_to = np.unique(np.concatenate(touched), return_inverse=True)
        ge = np.zeros((len(rows), DIM))
        np.add.at(ge, back_to, np.concatenate(grads))
        ge[rows == 0] = 0
        self.t += 1
        for k, grad, at in [*((k, v, slice(None)) for k, v in g.items()), ("E", ge, rows)]:
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * grad
            self.s[k][at] = 0.99 * self.s[k][at] + 0.01 * grad * grad
            hat = self.m[k][at] / (1 - 0.9**self.t)
            p[k][at] -= RATE * hat / (np.sqrt(self.s[k][at] / (1 - 0.99**self.t)) + 1e-7)

    def tables(self) -> dict:
        """What scoring needs: each word's part of each filter, by place in the filter."""
        parts = np.concatenate([self.p["E"] @ self.p[f"W{w}"][j] for w, j in PLACES], 1).astype(np.float32)
        return {"T": parts} | {f"b{w}": self.p[f"b{w}"].astype(np.float32) for w in WIDTHS} | {"v": self.p["v"], "c": float(self.p["c"][0])}


def logits(tables: dict, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of rows given as padded ids one after the other; first has each row's first id."""
    pooled, parts = [], np.ascontiguousarray(_summed(tables["T"], ids).T)
    for w in WIDTHS:
        z = _shifted(parts, w, len(ids))
        for j in range(1, w):  # a window may not leave its row
            z[:, first[1:] - j] = -np.inf
        pooled.append(np.maximum.reduceat(z, first[:-1], axis=1).T + tables[f"b{w}"])
    return np.maximum(np.concatenate(pooled, 1), 0) @ tables["v"] + tables["c"]


def _padded_first(first: np.ndarray) -> np.ndarray:
    return first + (max(WIDTHS) - 1) * np.arange(len(first))


def _threshold(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Cut between the labels' logits with least weight of errors; of ties the middle."""
    order = np.argsort(x, kind="stable")
    x, y, weight = x[order], y[order], weight[order]
    wrong = np.concatenate(([0], np.cumsum(weight * (y == 1)))) + np.concatenate((np.cumsum((weight * (y == 0))[::-1])[::-1], [0]))
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    cuts = np.concatenate(([x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]))
    return float(cuts[best[len(best) // 2]])


def thresholds(x: np.ndarray, y: np.ndarray, lang: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """By language the cut with least errors; a row of another language counts OTHER_LANGUAGE as much."""
    return np.array([_threshold(x, y, weight * np.where(lang == k, 1.0, OTHER_LANGUAGE)) for k in range(len(LANGUAGES))])


def _trained(rows: list[np.ndarray], y: np.ndarray, chosen: np.ndarray, seed: int) -> dict:
    """Tables of a net trained on the chosen rows."""
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, BUCKETS))
    for r in chosen:
        seen[int(y[r]), np.unique(rows[r])] += 1
    totals = np.array([(y[chosen] == k).sum() for k in (0, 1)])
    odds = np.log((seen[1] + 5) / (totals[1] + 10)) - np.log((seen[0] + 5) / (totals[0] + 10))
    net = Net(np.clip(odds, -3, 3) * 0.5, seed)
    weight = np.where(y == 1, 0.5 / max(1, totals[1]), 0.5 / max(1, totals[0])) * len(chosen)
    batches = max(1, len(chosen) // BATCH)
    for _ in range(max(EPOCHS, -(-STEPS // batches))):
        for part in np.array_split(rng.permutation(chosen), batches):
            ids = np.concatenate([rows[r] for r in part])
            net.step(np.where(rng.random(ids.shape, np.float32) < DROP, np.uint16(0), ids), _starts(rows, part), y[part], weight[part])
    return net.tables()


def _starts(rows: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(rows[r]) for r in part])))


def train(texts, y: np.ndarray, clean_weight: float = 1.0) -> dict | None:
    """The net's tables, tags and thresholds by language, or None without both labels.

    texts is a list or an Arrow column.  A clean row stands for clean_weight times as many rows as a toxic one.
    """
    if len(set(y)) < 2:
        return None
    import pyarrow as pa

    column = texts if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.string())
    counts = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for h, first in _keyed(column):
        counts = _counted(*counts, [np.unique(h[a:b]) for a, b in itertools.pairwise(first)])
    tags = tagged(*counts)
    rows, lang = [], []
    for h, first in _keyed(column):
        lang.append(languages(h[:, 0], first))
        rows += [word_ids(h[a:b], np.array([0, b - a]), tags).astype(np.uint16) for a, b in itertools.pairwise(first)]
    lang = np.concatenate(lang)
    order = np.random.default_rng(11).permutation(len(rows))
    order = np.concatenate((order[y[order] == 1], order[y[order] == 0]))  # parts of equal shares
    x = np.zeros(len(rows))
    for k in range(FOLDS):
        out, rest = order[k::FOLDS], np.concatenate([order[i::FOLDS] for i in range(FOLDS) if i != k])
        if len(out):
            own = _trained(rows, y, rest if len(set(y[rest])) == 2 else order, 11 + k)
            x[out] = logits(own, np.concatenate([rows[r] for r in out]), _starts(rows, out))
    cuts = thresholds(x, y, lang, np.where(y == 1, 1.0, clean_weight))
    return _trained(rows, y, order, 5) | {"cuts": cuts, "tags": tags}


def training_rows(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, text, label and part (0 to FOLDS - 1) of all labelled rows outside the held-out fold; of rows that repeat an id one counts."""
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(C.labelled(marks, "toxic", PARTS, HELD), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int"))


def _key_counts(batches: Iterator) -> Iterator:
    """Of chunks of texts: key, bucket, and by label and part how many texts hold the key."""
    import pyarrow as pa

    for batch in batches:
        cell = batch.column("label").to_numpy() * FOLDS + batch.column("part").to_numpy()
        for i, j, data, at in C.chunks(batch.column("text")):
            h, first = keys(data, at)
            own = [np.unique(h[a:b]) for a, b in itertools.pairwise(first)]
            all_, place = np.unique(np.concatenate(own), return_inverse=True)
            at_cell = np.repeat(cell[i:j], [len(x) for x in own])
            n = np.bincount(place * 2 * FOLDS + at_cell, minlength=len(all_) * 2 * FOLDS).reshape(len(all_), 2 * FOLDS)
            some = all_ != 0
            columns = [pa.array(C.signed(all_[some])), pa.array(_bucket(all_[some])), *(pa.array(n[some, k]) for k in range(2 * FOLDS))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "bucket", *(f"n{k}" for k in range(2 * FOLDS))])


def vocabulary(rows: DataFrame, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's most frequent key of all texts, 0 if under `least` hold it, and by label and part how many do (2 x FOLDS x BUCKETS)."""
    names = [f"n{k}" for k in range(2 * FOLDS)]
    got = rows.select("text", "label", "part").mapInArrow(_key_counts, "key long, bucket int, " + ", ".join(f"{c} long" for c in names))
    got = got.groupBy("bucket", "key").agg(*(F.sum(c).alias(c) for c in names)).withColumn("n", sum(F.col(c) for c in names)).where(F.col("n") >= least)
    got = got.groupBy("bucket").agg(F.max(F.struct("n", "key", *names)).alias("m")).select("bucket", "m.*").toPandas()  # one row a bucket
    tags, seen = np.zeros(BUCKETS, np.uint64), np.zeros((2 * FOLDS, BUCKETS))
    at = got["bucket"].to_numpy(np.int64)
    tags[at] = got["key"].to_numpy(np.int64).view(np.uint64)
    seen[:, at] = got[names].to_numpy(float).T
    return tags, seen.reshape(2, FOLDS, BUCKETS)


def _chosen(net: int) -> np.ndarray:
    """Parts that a net is trained on: all but its own, for the last net all."""
    return np.array([k != net for k in range(FOLDS)])


def encoded(rows: DataFrame, tags: np.ndarray) -> DataFrame:
    """doc_id, label, part, lang and padded ids (unsigned 16-bit) of training rows."""
    sent = rows.sparkSession.sparkContext.broadcast(tags)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, j, data, at in C.chunks(batch.column("text")):
                h, first = keys(data, at)
                ids, start = word_ids(h, first, sent.value).astype(np.uint16), _padded_first(first)
                own = [pa.array(languages(h[:, 0], first), pa.int32()), pa.array([ids[a:b].tobytes() for a, b in itertools.pairwise(start)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "label", "part")), *own], names=["doc_id", "label", "part", "lang", "ids"])

    return rows.select("doc_id", "label", "part", "text").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, part int, lang int, ids binary")


def _arrays(batch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).reshape(-1, 1 + len(STEMS)) for x in batch.column("ids").to_pylist()]


def _segments(batches: Iterator) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, labels and parts of a task's rows, SEGMENT bytes of ids or one batch more at a time, in the order of a hash of their ids."""
    kept, size = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            kept.append((_arrays(batch), *(batch.column(c).to_numpy() for c in ("label", "part", "o"))))
            size += sum(x.nbytes for x in kept[-1][0])
        if kept and (batch is None or size > SEGMENT):
            ids, (y, part, o) = [x for k in kept for x in k[0]], (np.concatenate([k[c] for k in kept]) for c in (1, 2, 3))
            order = np.argsort(o, kind="stable")
            yield [ids[r] for r in order], y[order].astype(float), part[order]
            kept, size = [], 0


def _flat(net: Net) -> np.ndarray:
    return np.concatenate([net.p[k].ravel() for k in sorted(net.p)])


def _filled(flat: np.ndarray) -> Net:
    """A net of the given parameters, with fresh moments."""
    net, at = Net(np.zeros(BUCKETS)), 0
    for k in sorted(net.p):
        net.p[k] = flat[at : at + net.p[k].size].reshape(net.p[k].shape).astype(float)
        at += net.p[k].size
    return net


def trained(rows: DataFrame, seen: np.ndarray, totals: np.ndarray) -> list[Net]:
    """FOLDS nets, each without one part, and one of all parts, from all encoded rows.

    In each of EPOCHS rounds every task trains the nets on all its rows; a parameter then moves by the mean of its moves in
    the tasks that moved it.  totals: rows by label and part.
    """
    nets = []
    for k in range(FOLDS + 1):
        own = _chosen(k)
        n, most = seen[:, own].sum(1), totals[:, own].sum(1)
        odds = np.log((n[1] + 5) / (most[1] + 10)) - np.log((n[0] + 5) / (most[0] + 10))
        nets.append(_flat(Net(np.clip(odds, -3, 3) * 0.5, 11 + k if k < FOLDS else 5)))
    for epoch in range(EPOCHS):
        sent = rows.sparkSession.sparkContext.broadcast(np.stack(nets).astype(np.float32))  # of fixed size: FOLDS + 1 nets

        def run(batches: Iterator, sent=sent, epoch=epoch) -> Iterator:
            import pyarrow as pa

            nets, n = {}, 0
            for ids, y, part in _segments(batches):
                n += len(y)
                for k in range(FOLDS + 1):
                    chosen, most = np.flatnonzero(_chosen(k)[part]), totals[:, _chosen(k)].sum(1)
                    if not len(chosen):
                        continue
                    net, rng = nets.setdefault(k, _filled(sent.value[k])), np.random.default_rng((k, epoch, n))
                    weight = np.where(y == 1, 0.5 / max(1, most[1]), 0.5 / max(1, most[0])) * most.sum()
                    parts = max(1, len(chosen) // BATCH)
                    for _ in range(max(2 if totals.sum() < SMALL else 1, -(-STEPS // parts // EPOCHS))):
                        for some in np.array_split(rng.permutation(chosen), parts):
                            x = np.concatenate([ids[r] for r in some])
                            net.step(np.where(rng.random(x.shape, np.float32) < DROP, np.uint16(0), x), _starts(ids, some), y[some], weight[some])
            for k, net in nets.items():
                for b, block in enumerate(np.array_split((_flat(net) - sent.value[k]).astype(np.float32), BLOCKS)):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([b]), pa.array([n]), pa.array([block.tobytes()], pa.binary())], names=["net", "block", "task", "moves"])

        def mean(key, table):
            import pyarrow as pa

            table = table.sort_by([("task", "ascending"), ("moves", "ascending")])
            total = n = 0.0
            for x in table.column("moves"):
                x = np.frombuffer(x.as_py(), np.float32)
                total, n = total + x.astype(float), n + (x != 0)
            return pa.table({"net": [key[0].as_py()], "block": [key[1].as_py()], "moves": [(total / np.maximum(n, 1)).tobytes()]})

        # few rows make small moves, so tasks have TASK_ROWS where there are so many
        moves = rows.coalesce(int(-(-totals.sum() // TASK_ROWS))).select("label", "part", "ids", F.xxhash64("doc_id", F.lit(71)).alias("o")).mapInArrow(run, "net long, block long, task long, moves binary")
        got = moves.groupBy("net", "block").applyInArrow(mean, "net long, block long, moves binary").collect()  # of fixed size
        for k in range(FOLDS + 1):
            own = [np.frombuffer(r["moves"], float) for r in sorted((r for r in got if r["net"] == k), key=lambda r: r["block"])]
            if own:
                nets[k] = sent.value[k] + np.concatenate(own)
    return [_filled(x) for x in nets]


def _steps(rows: DataFrame, tables: list[dict]) -> np.ndarray:
    """Rows by language, label and step of the logit that the net without the row's part gives."""
    sent = rows.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, part, step = _arrays(batch), batch.column("part").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for some in (k * 256 + np.arange(min(256, len(ids) - k * 256)) for k in range(-(-len(ids) // 256))):
                for k in range(FOLDS):
                    if len(own := some[part[some] == k]):
                        x = logits(sent.value[k], np.concatenate([ids[r] for r in own]), _starts(ids, own))
                        step[own] = np.clip(np.floor((x + REACH) / (2 * REACH) * GRID), 0, GRID - 1)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("label"), pa.array(step)], names=["lang", "label", "step"])

    out = np.zeros((len(LANGUAGES), 2, GRID))
    got = rows.select("lang", "label", "part", "ids").mapInArrow(run, "lang int, label int, step long").groupBy("lang", "label", "step").agg(F.count("*").alias("n")).toPandas()  # at most GRID steps
    out[got["lang"].to_numpy(int), got["label"].to_numpy(int), got["step"].to_numpy(int)] = got["n"]
    return out


def fit(docs: DataFrame, marks: DataFrame) -> dict | None:
    """A model of all labelled rows outside the held-out fold; tasks train, and nets, keys of buckets and counts come to the driver."""
    with C.passing(docs.sparkSession):  # the model is the driver's, so training rows go
        return _fitted(C.saved(training_rows(docs, marks), "training"))


def _fitted(rows: DataFrame) -> dict | None:
    totals = np.zeros((2, FOLDS))
    for r in rows.groupBy("label", "part").agg(F.count("*").alias("n")).collect():  # 2 x FOLDS
        totals[r["label"], r["part"]] = r["n"]
    if not totals.any(1).all():
        return None
    tags, seen = vocabulary(rows)
    ids = C.saved(encoded(rows, tags), "encoded")
    tables = [net.tables() for net in trained(ids, seen, totals)]
    by = _steps(ids, tables)
    cuts = []
    for k in range(len(LANGUAGES)):
        own = np.einsum("l,lys->ys", np.where(np.arange(len(LANGUAGES)) == k, 1.0, OTHER_LANGUAGE), by)
        cuts.append(C.least_errors(own[0], own[1]) / GRID * 2 * REACH - REACH)
    return tables[FOLDS] | {"cuts": np.array(cuts), "tags": tags}


def score_texts(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score for every row."""
    docs = docs.select("doc_id", "text")
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS rows

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, j, data, at in C.chunks(batch.column("text")):
                h, first = keys(data, at)
                x = logits(sent.value, word_ids(h, first, sent.value["tags"]), _padded_first(first)) - sent.value["cuts"][languages(h[:, 0], first)]
                score = 1 / (1 + np.exp(-np.clip(x, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(score)], names=["doc_id", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, score double")


def scores(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id and score for every row by a model of the labelled rows, written here, so that Python gets few texts at a time."""
    with C.small_batches(docs.sparkSession):
        return C.saved(score_texts(docs, fit(docs, marks)), "scores")


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    scored = scores(docs, C.labels(spark, sf_dir))
    held = F.coalesce(C.fold("doc_id", PARTS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go.  Rows that share a doc_id go together if one of them is toxic."""
    return C.without(docs, scores(docs, C.labels(spark, sf_dir)).where("score >= 0.5"))
