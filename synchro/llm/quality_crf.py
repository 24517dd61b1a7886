"""Document quality by a linear-chain conditional random field over lines (operator 1).

Every line of a text is good or bad.  A line's evidence is made of its own statistics (symbols,
capitals, repeats, length) and its two neighbours'; transitions carry a line's state to the next.
Labels exist for documents only, so the field is trained on what they say of lines: all lines of a
good document are good, some line of a bad one is bad.  Both likelihoods and their gradients follow
from the partition function Z, as the all-good path scores zero: log Z for good documents, and
log Z - log(Z - 1) for bad ones.

A document's quality is the share of its bytes in good lines, each weighted with its forward-backward
marginal, turned into a probability by a logistic curve fitted on the training rows.  Training takes
at most TRAIN_ROWS labelled rows (half of either label) on the driver; scoring runs in Arrow batches.

Null and empty texts have no lines and score as a text without bad lines.  Without labelled rows of
both kinds every score is 1.  Rows are scored one by one; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import rule_stats as S

TRAIN_ROWS, STEPS, RATE, DECAY = 4000, 250, 0.1, 1e-4
PARTS, HELD = 3, 1
#: A good row called bad weighs so much in the curve: the sample is half bad, the corpus is not.
GOOD_WEIGHT = 5
_OTHER = S._mask(b"~^_=@{}[]\\/`;:")
OWN = 11


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x 2 * neighbours + own), weights (bytes) and each row's first line."""
    s, e, first, h = C.words(data, at)
    a, b, row, w0, w1, again = S.lines(data, at, s)
    n, words = np.maximum(b - a, 1), np.maximum(w1 - w0, 1)
    letters = np.maximum(S.sums(S.LETTER[data], a, b), 1)
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = h[1:] == h[:-1]
        same[np.minimum(w0[w1 > w0], len(h) - 1)] = False
    upper = S.sums(S.UPPER[data], a, b) / letters
    own = np.stack(
        [
            np.minimum(S.sums(S.SYMBOL[data], a, b) / words, 1),
            np.minimum(S.sums(S.BANG[data], a, b) / words, 1),
            np.minimum(S.sums(S.PIPE[data], a, b) / words, 1),
            upper * (words > 3),
            (upper > 0.5) & (words > 3),
            np.minimum(S.sums(S.DIGIT[data], a, b) / n * 4, 1),
            S.sums(same, w0, w1) / words,
            again & (w1 > w0),
            np.minimum(S.sums(_OTHER[data], a, b) / words, 1),
            n < 20,
            np.minimum((e[np.minimum(w1, max(len(e), 1)) - 1] - s[np.minimum(w0, len(s) - 1)] if len(s) else n) / words / 20, 2),
        ],
        1,
    ).astype(np.float64) if len(a) else np.zeros((0, OWN))
    starts = np.searchsorted(row, np.arange(len(at)))
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own):
        before[1:] = own[:-1] * (row[1:] == row[:-1])[:, None]
        after[:-1] = own[1:] * (row[1:] == row[:-1])[:, None]
    return np.concatenate((np.ones((len(own), 1)), own, before[:, :9], after[:, :9]), 1), (n if len(a) else np.zeros(0)).astype(float), starts


class Chains:
    """Forward-backward over all rows at once, a place at a time, longest rows first."""

    def __init__(self, starts: np.ndarray):
        size = np.diff(starts)
        self.order = np.argsort(-size, kind="stable")
        self.order = self.order[size[self.order] > 0]
        self.first, self.size = starts[:-1][self.order], size[self.order]
        longest = int(self.size[0]) if len(self.size) else 0
        self.active = np.searchsorted(-self.size, -np.arange(longest), "left")

    def run(self, u: np.ndarray, trans: np.ndarray):
        """log Z by row of `order`, P(bad) by line, and summed P(pair of states) by row."""
        own = np.exp(np.stack((np.zeros_like(u), np.clip(u, -30, 30)), 1))
        t = np.exp(trans)
        forward, scale = np.zeros((len(u), 2)), np.ones(len(u))
        log_z = np.zeros(len(self.order))
        for k, n in enumerate(self.active):
            at = self.first[:n] + k
            x = own[at] if k == 0 else (forward[at - 1] @ t) * own[at]
            scale[at] = x.sum(1)
            forward[at] = x / scale[at][:, None]
            log_z[:n] += np.log(scale[at])
        marginal, pairs = np.zeros((len(u), 2)), np.zeros((len(self.order), 2, 2))
        back = np.ones((len(self.order), 2))
        for k in range(len(self.active) - 1, -1, -1):
            n = self.active[k]
            at = self.first[:n] + k
            later = self.size[:n] > k + 1
            m = int(later.sum())  # rows are ordered by size, so these are the first m
            if m:
                nxt = at[:m] + 1
                to = own[nxt] * back[:m] / scale[nxt][:, None]
                pairs[:m] += forward[at[:m]][:, :, None] * t[None] * to[:, None, :]
                back[:m] = to @ t.T
            back[m:n] = 1
            marginal[at] = forward[at] * back[:n]
        return log_z, marginal[:, 1], pairs


def train(x: np.ndarray, starts: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features for bad lines, and log transitions (good to good is 0)."""
    chains = Chains(starts)
    bad = bad[chains.order]
    weight = np.where(bad, 0.5 / max(bad.sum(), 1), 0.5 / max((~bad).sum(), 1))
    of = np.zeros(len(x), np.int64)
    of[:] = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = np.zeros(len(starts) - 1, np.int64)
    place[chains.order] = np.arange(len(chains.order))
    theta = np.zeros(x.shape[1] + 3)
    theta[0], theta[-3:] = -2.0, (-1.0, -1.0, 1.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        trans = np.array([[0, theta[-3]], [theta[-2], theta[-1]]])
        log_z, p, pairs = chains.run(x @ theta[:-3], trans)
        pull = np.where(bad, -1 / np.expm1(np.maximum(log_z, 1e-9)), 1.0) * weight
        grad = np.concatenate((x.T @ (p * pull[place[of]]), [pull @ pairs[:, 0, 1], pull @ pairs[:, 1, 0], pull @ pairs[:, 1, 1]])) + DECAY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta[:-3], np.array([[0, theta[-3]], [theta[-2], theta[-1]]])


def good_share(model: tuple, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By row the length-weighted share of good lines."""
    return _share(model, *line_features(data, at))


def _share(model: tuple, x: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    _, p, _ = Chains(starts).run(x @ model[0], model[1])
    total = np.concatenate((np.zeros((2, 1)), np.cumsum(np.stack((weight, weight * p)), 1)), 1)
    size, wrong = total[:, starts[1:]] - total[:, starts[:-1]]
    return 1 - wrong / np.maximum(size, 1e-9)


def _evidence(good: np.ndarray) -> np.ndarray:
    return np.log((good + 0.01) / (1 - good + 0.01))


def fit(docs: DataFrame, marks: DataFrame) -> tuple | None:
    """Weights, transitions and the curve (slope, offset); None without both labels."""
    sample = C.training_sample(docs, marks, "quality", PARTS, HELD, TRAIN_ROWS).toPandas()  # at most TRAIN_ROWS rows
    y = sample["label"].to_numpy()
    if len(set(y)) < 2:
        return None
    import pyarrow as pa

    parts = [line_features(data, at) for _, _, data, at in C.chunks(pa.array(sample["text"]))]
    x, weight = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    starts = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))))
    weights, trans = train(x, starts, y == 0)
    z = _evidence(_share((weights, trans), x, weight, starts))
    w = np.where(y == 1, GOOD_WEIGHT, 1.0)
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's method, slightly damped
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        g = np.array([(w * (p - y) * z).sum() + 0.1 * slope, (w * (p - y)).sum()])
        r = w * p * (1 - p) + 1e-6
        step = np.linalg.solve(np.array([[(r * z * z).sum() + 0.1, (r * z).sum()], [(r * z).sum(), r.sum()]]), g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        slope, offset = slope - step[0], offset - step[1]
    return weights, trans, (slope, offset)


def score_texts(docs: DataFrame, model: tuple | None) -> DataFrame:
    """doc_id, score (probability of label 1) and good_share for every row."""
    docs = docs.select("doc_id", "text")
    if model is None:
        return docs.select("doc_id", F.lit(1.0).alias("score"), F.lit(1.0).alias("good_share"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, j, data, at in C.chunks(batch.column("text")):
                good = good_share(model, data, at)
                slope, offset = model[2]
                score = 1 / (1 + np.exp(-np.clip(slope * _evidence(good) + offset, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(score), pa.array(good)], names=["doc_id", "score", "good_share"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, score double, good_share double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    scored = score_texts(docs, fit(docs, C.labels(spark, sf_dir)))
    held = F.coalesce(C.fold("doc_id", PARTS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
