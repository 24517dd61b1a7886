"""Secrets: base patterns, and formats inferred from credentials (operator 4).

Base spans come from the three given patterns, leftmost and non-overlapping by kind.  Grammar
inference adds what has a credential's format without its surroundings.  The values that base spans hold
are the labelled examples.  By kind their characters fall into classes whose neighbours have compatible
frequencies (the sixteen hexadecimal digits become one class, the letters of a fixed prefix stay on their own); a prefix tree over
classes then goes through ALERGIA, which merges states whose ends and next classes have statistically
compatible frequencies (of several, the one that the state's most frequent step leads to, else the best fitting), into a
probabilistic automaton: prefix, alphabet and length of the format.
Ordinary runs of the same characters, without those few that have a credential's format, give a chain: a state for every
two preceding characters, with the shares of what follows (Witten-Bell: backed by those after one character and after none).

Every run of LEAST_RUN or more such characters in a text (points and hyphens at its ends left out) is a candidate.  Its score is the
best log-likelihood under a credential automaton, which is minus infinity outside its language, less that under
the ordinary one: a sum over the characters, so a short run needs a likelier format than a long one.  The threshold is the
log of how many candidates there are for each credential, with a margin, and above all ordinary examples.
Candidates over it that touch no base span become spans of kind `format`.

All distinct values of all documents are examples.  States come from FIT_VALUES of a kind at a time: an automaton is inferred
from those of the smallest hashes, all values of the kind that are in its language give its probabilities, and those
outside go to the next automaton, until fewer than LEAST_SAMPLE are left; so no value is left out because others came first.  The
chain counts all distinct ordinary runs, and the threshold is above all of them.  The column `grammars` says how many automata there are.

Offsets are code points of the whole text, end exclusive; of an `assign` match the whole match.
Null and empty texts have no spans.  Rows are judged one by one; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("assign", "access", "hex", "format")
#: The base patterns, on UTF-8 bytes, and what a text must hold for the first.
_KEY = b"|".join(b"".join(b"[%c%c]" % (c - 32, c) if 97 <= c <= 122 else b"%c" % c for c in w) for w in (b"password", b"passwd", b"secret", b"token"))
ASSIGN = re.compile(b"(" + _KEY + rb"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_RUN = 6, 20, 24, 6
#: Values of a kind that an automaton's states are inferred from: at least, at most.
LEAST_SAMPLE, FIT_VALUES = 8, 400
#: Confidence of a merge, and the threshold's margin.
ALPHA, MARGIN = 0.05, math.log(100)
#: Ordinary examples over the threshold are taken for credentials, unless they are more than this share.
MOST_ALIKE = 0.05

_HEX, _RUN, _EDGE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_RUN[48:58] = _RUN[65:91] = _RUN[97:123] = True
_RUN[[43, 47, 95, 46, 61, 45]] = True
_EDGE[[46, 45]] = True
#: Codes of the characters of runs, from 1; 0 is what lies before and after a run.
_CODE = np.where(_RUN, np.cumsum(_RUN), 0)
WIDE = int(_RUN.sum()) + 1


def differ(f1: float, n1: float, f2: float, n2: float) -> bool:
    """Whether two frequencies are incompatible by Hoeffding's bound at ALPHA."""
    return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def character_classes(values: list[bytes]) -> dict[int, int]:
    """Class of each character in values: characters of compatible neighbours are one class."""
    near: dict[int, Counter] = {}
    for v in values:
        for i, c in enumerate(v):
            own = near.setdefault(c, Counter())
            own["n"] += 1
            own["after", v[i - 1] if i else None] += 1
            own["before", v[i + 1] if i + 1 < len(v) else None] += 1
    pools: list[Counter] = []
    out = {}
    for c in sorted(near, key=lambda c: (-near[c]["n"], c)):
        own = near[c]
        for k, pool in enumerate(pools):
            if not any(differ(own[x], own["n"], pool[x], pool["n"]) for x in own.keys() | pool.keys() if x != "n"):
                pool.update(own)
                out[c] = k
                break
        else:
            out[c] = len(pools)
            pools.append(Counter(own))
    return out


class Automaton:
    """A probabilistic deterministic automaton inferred from strings by state merging."""

    def __init__(self, values: list[bytes]):
        self.classes = character_classes(values)
        self.members = Counter(self.classes.values())
        uses = Counter(c for v in values for c in v)
        total = Counter()
        for c, n in uses.items():
            total[self.classes[c]] += n
        self.emit = {c: n / total[self.classes[c]] for c, n in uses.items()}
        self.n, self.end, self.to = [0], [0], [{}]
        for v in sorted(values):
            k = 0
            self.n[0] += 1
            for c in v:
                step = self.to[k].setdefault(self.classes[c], [len(self.n), 0])
                if step[0] == len(self.n):
                    self.n.append(0)
                    self.end.append(0)
                    self.to.append({})
                step[1] += 1
                k = step[0]
                self.n[k] += 1
            self.end[k] += 1
        self._merge()

    def _fit(self, a: int, b: int) -> float | None:
        """Log-likelihood of b's strings in a's place; None if a frequency on the way is incompatible."""
        todo, total = [(a, b)], 0.0
        while todo:
            a, b = todo.pop()
            n1, n2 = self.n[a], self.n[b]
            if differ(self.end[a], n1, self.end[b], n2):
                return None
            total += self.end[b] * math.log(max(self.end[a] / n1, 1e-6))
            for c in self.to[a].keys() | self.to[b].keys():
                x, y = self.to[a].get(c), self.to[b].get(c)
                if differ(x[1] if x else 0, n1, y[1] if y else 0, n2):
                    return None
                if y:
                    total += y[1] * math.log(x[1] / n1 if x else 1 / (n1 + len(self.members)))
                    x = x or self._wide(a)
                    if not x:  # outside the language: all that follows, too
                        total += (y[1] + self._steps(y[0])) * math.log(1e-6)
                    elif x[0] != y[0]:
                        todo.append((x[0], y[0]))
        return total

    def _steps(self, k: int) -> int:
        """Characters that the examples have after state k of the tree."""
        todo, seen, total = [k], {k}, 0
        while todo:
            for nxt, count in self.to[todo.pop()].values():
                total += count
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return total

    def _wide(self, a: int) -> list | None:
        """The most frequent step of a state by a class of several characters."""
        return max((step for c, step in self.to[a].items() if self.members[c] > 1), key=lambda step: (step[1], -step[0]), default=None)

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.n[a] += self.n[b]
            self.end[a] += self.end[b]
            for c, (k, count) in self.to[b].items():
                if c in self.to[a]:
                    self.to[a][c][1] += count
                    todo.append((self.to[a][c][0], k))
                else:
                    self.to[a][c] = [k, count]

    def _merge(self) -> None:
        red = [0]
        while True:
            blue = sorted((-self.n[k], r, c, k) for r in red for c, (k, _) in self.to[r].items() if k not in red)
            if not blue:
                break
            _, r, c, k = blue[0]
            fits = [(fit, -a) for a in red if (fit := self._fit(a, k)) is not None]
            if fits:
                a = -max(fits)[1]
                wide = self._wide(r)
                if wide and any(-x == wide[0] for _, x in fits):  # a rarer character in the same place
                    a = wide[0]
                self.to[r][c][0] = a
                self._fold(a, k)
            else:
                red.append(k)
        self.states = len(red)
        self.red = red

    def recount(self, n: np.ndarray) -> None:
        """Frequencies from counts (states x bytes, then ends) of more values of the language, as `steps` has them."""
        to, _, _ = self.tables()
        bytes_of = np.array([self.classes.get(c, -1) for c in range(256)])
        total = n[:, :256].sum(0)
        for k, own in zip(self.red, n, strict=True):
            self.n[k], self.end[k] = int(own.sum()), int(own[256])
        for i, k in enumerate(self.red):
            now: dict[int, list] = {}
            for c in np.flatnonzero(n[i, :256]).tolist():
                now.setdefault(self.classes[c], [self.red[to[i, c]], 0])[1] += int(n[i, c])
            self.to[k] = now
        self.emit = {c: total[c] / total[bytes_of == self.classes[c]].sum() for c in self.emit if total[c]}

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By state (0 the first) and byte: next state (-1: none) and log-probability; by state that of the end.

        Where a class of several characters leads on, any character of the language may stand in for it, with the
        probability of one not seen yet.
        """
        number = {k: i for i, k in enumerate(self.red)}
        to, p, end = np.full((len(self.red), 256), -1, np.int32), np.zeros((len(self.red), 256)), np.zeros(len(self.red))
        for k, i in number.items():
            end[i] = self.end[k] / self.n[k]
            wide = self._wide(k)
            for c, share in self.emit.items():
                step = self.to[k].get(self.classes[c])
                if step:
                    to[i, c], p[i, c] = number[step[0]], step[1] / self.n[k] * share
                elif wide:
                    to[i, c], p[i, c] = number[wide[0]], share / (self.n[k] + len(self.members))
        with np.errstate(divide="ignore"):
            return to, np.log(p), np.log(end)


def log_likelihoods(tables: tuple, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Of the byte ranges of data under an automaton's tables, all at once."""
    to, step, end = tables
    out, live, state, k = np.full(len(s), -np.inf), np.arange(len(s)), np.zeros(len(s), np.int32), 0
    so_far = np.zeros(len(s))
    while len(live):
        done = s[live] + k == e[live]
        out[live[done]] = so_far[done] + end[state[done]]
        live, state, so_far = live[~done], state[~done], so_far[~done]
        c = data[s[live] + k]
        so_far = so_far + step[state, c]
        state = to[state, c]
        on = (state >= 0) & (so_far > -np.inf)
        live, state, so_far = live[on], state[on], so_far[on]
        k += 1
    return out


def steps(tables: tuple, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """How often byte ranges of the language take each step (states x bytes), and at 256 how often they end in a state."""
    to, n = tables[0], np.zeros((len(tables[0]), 257), np.int64)
    live, state, k = np.arange(len(s)), np.zeros(len(s), np.int32), 0
    while len(live):
        done = s[live] + k == e[live]
        np.add.at(n, (state[done], 256), 1)
        live, state = live[~done], state[~done]
        c = data[s[live] + k]
        np.add.at(n, (state, c), 1)
        state = to[state, c]
        k += 1
    return n


def triples(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Counts of the byte ranges' characters, and ends, after the two before: codes as digits of a number to the base WIDE."""
    size = e - s + 2
    first = np.cumsum(size) - size + 2
    x = np.zeros(int(size.sum()) + 2, np.int64)
    within = np.arange(int((e - s).sum())) - np.repeat(np.cumsum(e - s) - (e - s), e - s)
    x[np.repeat(first, e - s) + within] = _CODE[data[np.repeat(s, e - s) + within]]
    three = (x[:-2] * WIDE + x[1:-1]) * WIDE + x[2:]
    keep = (x[2:] > 0) | (x[1:-1] > 0)  # not the second of the zeros between ranges
    return np.bincount(three[keep], minlength=WIDE**3)


def chain(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of ordinary runs from the counts of their triples; a state is two characters, and every step is possible."""

    def backed(n: np.ndarray, lower) -> np.ndarray:
        kinds = (n > 0).sum(-1, keepdims=True)
        return np.where(kinds > 0, (n + kinds * lower) / np.maximum(n.sum(-1, keepdims=True) + kinds, 1), lower)

    n = n.reshape(WIDE, WIDE, WIDE)
    p = np.log(backed(n, backed(n.sum(0), backed(n.sum((0, 1)), 1 / WIDE)))).reshape(-1, WIDE)
    to, step = np.full((len(p), 256), -1, np.int32), np.full((len(p), 256), -np.inf, np.float32)
    at = np.flatnonzero(_RUN)
    to[:, at], step[:, at] = np.arange(len(p))[:, None] % WIDE * WIDE + _CODE[at], p[:, _CODE[at]]
    return to, step, p[:, 0]


def candidates(data: np.ndarray, at: np.ndarray, found: dict[int, list]) -> tuple[np.ndarray, np.ndarray]:
    """Runs without the points and hyphens at their ends that touch no base match."""
    inner = _RUN[data] & ~_EDGE[data]
    before = np.concatenate(([0], np.cumsum(inner)))
    where = np.flatnonzero(inner)
    s, e, _ = C.spans_of(_RUN[data], at)
    a, b = before[s], before[e]
    some = b > a
    s, e = where[a[some]], where[b[some] - 1] + 1
    keep = e - s >= LEAST_RUN
    s, e = s[keep], e[keep]
    for row, spans in found.items():
        for first, _, last, _ in spans:
            i, j = np.searchsorted(e, at[row] + first, "right"), np.searchsorted(s, at[row] + last, "left")
            if j > i:
                s, e = np.delete(s, slice(i, j)), np.delete(e, slice(i, j))
    return s, e


def chunk_spans(data: np.ndarray, at: np.ndarray):
    """Base matches {row: [(start, kind, end, value)]}, in bytes of the row, and candidates: starts and ends in data."""
    raw = data.tobytes()
    found: dict[int, list] = {}

    def put(row: int, s: int, kind: int, e: int, value: bytes) -> None:
        found.setdefault(row, []).append((s, kind, e, value))

    low, rows = raw.lower(), set()
    for hint in HINTS:
        k = low.find(hint)
        while k >= 0:
            row = int(np.searchsorted(at, k, "right")) - 1
            rows.add(row)
            k = low.find(hint, k + 1)
    for row in sorted(rows):
        for m in ASSIGN.finditer(raw[at[row] : at[row + 1]]):
            if len(m[2]) >= LEAST_VALUE:
                put(row, m.start(), 0, m.end(), m[2])
    rows, k = set(), raw.find(b"AKIA")
    while k >= 0:
        rows.add(int(np.searchsorted(at, k, "right")) - 1)
        k = raw.find(b"AKIA", k + 1)
    for row in sorted(rows):
        for m in ACCESS.finditer(raw[at[row] : at[row + 1]]):
            if len(m[0]) >= LEAST_ACCESS:
                put(row, m.start(), 1, m.end(), m[0])
    s, e, _ = C.spans_of(_HEX[data], at)
    keep = e - s >= LEAST_HEX
    for a, b in zip(s[keep].tolist(), e[keep].tolist(), strict=True):
        row = int(np.searchsorted(at, a, "right")) - 1
        put(row, a - int(at[row]), 2, b - int(at[row]), raw[a:b])
    return found, *candidates(data, at, found)


def _values(batches: Iterator) -> Iterator:
    """Kind, value and how often it is there, by chunk of texts: of base spans (0 to 2) and ordinary runs (3)."""
    import pyarrow as pa

    for batch in batches:
        for _, _, data, at in C.chunks(batch.column("text")):
            found, s, e = chunk_spans(data, at)
            spans = Counter((kind, v) for own in found.values() for _, kind, _, v in own)
            size = e - s
            ends = np.concatenate(([0], np.cumsum(size)))
            own = data[np.repeat(s - ends[:-1], size) + np.arange(ends[-1])]
            runs = pa.StringArray.from_buffers(len(s), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(own)).value_counts()
            kinds = pa.array([kind for kind, _ in spans] + [3] * len(runs), pa.int32())
            values = pa.concat_arrays([pa.array([v.decode() for _, v in spans], pa.string()), runs.field("values")])
            counts = pa.concat_arrays([pa.array(spans.values(), pa.int64()), runs.field("counts")])
            yield pa.RecordBatch.from_arrays([kinds, values, counts], names=["kind", "value", "n"])


def _automata(values: DataFrame) -> list[tuple]:
    """Tables of the automata that a kind's distinct values (column value) give, whose languages leave out fewer than LEAST_SAMPLE of them."""
    out, session = [], values.sparkSession
    while True:
        picked = [r["value"].encode() for r in values.orderBy(F.xxhash64("value"), "value").limit(FIT_VALUES).collect()]  # at most FIT_VALUES
        if len(picked) < LEAST_SAMPLE:
            return out
        automaton = Automaton(picked)
        sent = session.sparkContext.broadcast(automaton.tables())

        def inside(batch, tables):
            data, at = C.utf8(batch.column("value"))
            return data, at[:-1], at[1:], log_likelihoods(tables, data, at[:-1], at[1:]) > -np.inf

        def count(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            n = np.zeros((len(sent.value[0]), 257), np.int64)
            for batch in batches:
                data, s, e, own = inside(batch, sent.value)
                n += steps(sent.value, data, s[own], e[own])
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at])], names=["at", "n"])

        def others(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                yield batch.filter(pa.array(~inside(batch, sent.value)[3]))

        n = np.zeros((automaton.states, 257), np.int64)
        for r in values.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # of fixed size: steps of the automaton
            n.flat[r["at"]] = r["n"]
        automaton.recount(n)
        out.append(automaton.tables())
        values = C.saved(values.mapInArrow(others, "value string"), "other-values")


def fit(docs: DataFrame) -> dict | None:
    """Tables of the credentials' automata and of ordinary runs, and the threshold; None without examples of both."""
    values = C.saved(docs.select("text").mapInArrow(_values, "kind int, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")), "values")
    n = {r["kind"]: (r["n"], r["distinct"]) for r in values.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()}
    good = [a for k in range(3) if n.get(k, (0, 0))[1] >= LEAST_SAMPLE for a in _automata(values.where(F.col("kind") == k).select("value"))]
    distinct = n.get(3, (0, 0))[1]
    if not good or distinct < LEAST_SAMPLE:
        return None
    runs = values.where("kind = 3").select("value")
    cut = least_cut({k: x for k, (x, _) in n.items()})

    def totals(of, value, size: int) -> np.ndarray:
        """Sums over all runs of what `of` makes of a batch's, given a value: `size` numbers."""
        sent = runs.sparkSession.sparkContext.broadcast(value)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros(size, np.int64)
            for batch in batches:
                data, at = C.utf8(batch.column("value"))
                total += of(sent.value, data, at[:-1], at[1:])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

        out = np.zeros(size, np.int64)
        got = runs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most `size` rows
        out[got["at"].to_numpy(np.int64)] = got["n"]
        return out

    # ordinary runs may be credentials: against characters alone these stand out
    first = {"good": good, "plain": memoryless(totals(lambda _, data, s, e: characters(data, s, e), None, 257)), "cut": cut}
    split = totals(lambda model, data, s, e: _split(model, data, s, e), first, 2 * WIDE**3 + 1)
    few = split[-1] <= MOST_ALIKE * distinct
    alike, others = split[: WIDE**3], split[WIDE**3 : -1]
    model = {"good": good, "plain": chain(others if few else alike + others), "cut": cut}
    sent = runs.sparkSession.sparkContext.broadcast((model, first if few else None))

    def top(batches: Iterator) -> Iterator:
        import pyarrow as pa

        most = -np.inf
        for batch in batches:
            data, at = C.utf8(batch.column("value"))
            most = max(most, _most(*sent.value, data, at[:-1], at[1:]))
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["most"])

    most = runs.mapInArrow(top, "most double").agg(F.max("most")).first()[0]
    model["cut"] = max(cut, most + MARGIN)
    return model


def least_cut(n: dict[int, int]) -> float:
    """Log of how many candidates there are for each credential, with a margin, from the numbers of values by kind."""
    return max(math.log(max(n.get(3, 1), 1) / max(sum(n.get(k, 0) for k in range(3)), 1)), 0.0) + MARGIN


def _split(model: dict, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Triples of the ranges over the model's cut, then of the others, then how many are over it."""
    over = scores(model, data, s, e) > model["cut"]
    return np.concatenate((triples(data, s[over], e[over]), triples(data, s[~over], e[~over]), [over.sum()]))


def _most(model: dict, first: dict | None, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> float:
    """The highest score of the ranges, but for those over the first model's cut."""
    if first:
        own = scores(first, data, s, e) <= first["cut"]
        s, e = s[own], e[own]
    return float(scores(model, data, s, e).max(initial=-np.inf))


def model_of(credentials: list[list[bytes]], plain: list[bytes], n: dict[int, int]) -> dict | None:
    """The model from examples by kind, ordinary examples, and the numbers of values that there are by kind; as `fit`, from lists."""
    good = [Automaton(v).tables() for v in credentials if len(v) >= LEAST_SAMPLE]
    if not good or len(plain) < LEAST_SAMPLE:
        return None
    cut, runs = least_cut(n), _joined(plain)
    first = {"good": good, "plain": memoryless(characters(*runs)), "cut": cut}
    split = _split(first, *runs)
    few = split[-1] <= MOST_ALIKE * len(plain)
    model = {"good": good, "plain": chain(split[WIDE**3 : -1] + (0 if few else split[: WIDE**3])), "cut": cut}
    return model | {"cut": max(cut, _most(model, first if few else None, *runs) + MARGIN)}


def characters(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Counts of the ranges' bytes, then of the ranges; the ranges follow one another."""
    return np.append(np.bincount(data[s[0] : e[-1]] if len(s) else data[:0], minlength=256), len(s))


def memoryless(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of one state: the frequencies of characters and of ends."""
    p = n[:256] + 1.0 * _RUN
    total = p.sum() + n[256]
    with np.errstate(divide="ignore"):
        return np.zeros((1, 256), np.int32), np.log(p / total)[None], np.log(np.array([n[256] / total]))


def _joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e = np.cumsum([len(v) for v in values])
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate(([0], e[:-1])).astype(np.int64), e


def scores(model: dict, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Log-likelihood ratios of the byte ranges; minus infinity outside every credential automaton's language."""
    out = np.full(len(s), -np.inf)
    for tables in model["good"]:
        out = np.maximum(out, log_likelihoods(tables, data, s, e))
    some = np.flatnonzero(out > -np.inf)
    out[some] -= log_likelihoods(model["plain"], data, s[some], e[some])
    return out


def scanned(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and spans: array of (kind, start, end), by start, then kind as listed."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of some hundred states at most

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind_of = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for i, j, data, at in C.chunks(batch.column("text")):
                found, s, e = chunk_spans(data, at)
                if sent.value is not None and len(s):
                    for k in np.flatnonzero(scores(sent.value, data, s, e) > sent.value["cut"]):
                        row = int(np.searchsorted(at, s[k], "right")) - 1
                        found.setdefault(row, []).append((int(s[k] - at[row]), 3, int(e[k] - at[row]), b""))
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                out = []
                for r in range(j - i):
                    own = sorted(x[:3] for x in found.get(r, ()))
                    base = points[at[r]]
                    out.append([{"kind": KINDS[k], "start": int(points[at[r] + s] - base), "end": int(points[at[r] + e] - base)} for s, k, e in own])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(out, pa.list_(kind_of))], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = fit(docs)
    found = scanned(docs, model)

    def count(kind: str):
        return F.size(F.filter("spans", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def written(spans):
        return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")

    base = written(F.filter("spans", lambda m: m["kind"] != "format"))
    return found.select("doc_id", *[count(k) for k in KINDS], F.lit(len(model["good"]) if model else 0).cast("long").alias("grammars"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    """base_sha256 of spans in order."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
