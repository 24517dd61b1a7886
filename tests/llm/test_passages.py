"""Repeated passages against plain Python, and suffix arrays against sorted strings."""

import random

import numpy as np
import pytest

from synchro.llm import passages, suffixes

SCHEMA = "doc_id long, text string, flush long, data string"


def _plain(rows, match=50):
    least = {}
    for i, text in rows:
        b = (text or "").encode()
        for k in range(len(b) - match + 1 if i is not None else 0):
            s = b[k : k + match]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - match + 1 if i is not None else 0):
            if least[b[k : k + match]] < i:
                gone[k + 1 : k + 1 + match] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1])
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        kept = bytes(c for c, g in zip(b, gone[1:-1], strict=True) if not g)
        out.append((str(i), len(b), spans, kept))
    return sorted(out)


def _found(spark, rows, parts):
    df = spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA).repartition(parts)
    return sorted((str(r.doc_id), r.n_bytes, [(x.start, x.stop) for x in r.removed], bytes(r.kept)) for r in passages.without_repeats(df).collect())


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("parts", [1, 9])
def test_equals_plain_python(spark, parts):
    """Copies, near copies, passages in every document, matches of 49 and 50 bytes, long runs of one byte, repeated and null ids, empty and null texts."""
    rng = random.Random(parts)
    common, edge = _words(rng, 25), "x0123456789" * 6
    texts = [_words(rng, rng.randint(0, 60)) for _ in range(60)]
    for k in range(60):
        t = texts[rng.randrange(60)]
        at = rng.randrange(len(t) + 1)
        texts.append(rng.choice([t, t[:at] + "Q" + t[at:], t[at:] + common, common + t, t + t, common[:80] + t[at:], t[: at + 49] + "!" + common[3:]]))
    texts += [f"{edge[:49]}A", f"{edge[:49]}B", f"C{edge[:50]}D", f"E{edge[:50]}F", edge[1:51] + edge[:52], "", None, "short"]
    texts += [" " * n for n in (49, 50, 51, 3000)] + ["ab" * 700 + common, "ab" * 500, "\0" * 60 + "z", "\0" * 70]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(None, common), (None, texts[0]), (rows[0][0], rows[0][1]), (rows[1][0], common + "again"), (rows[1][0], common)]
    got = _found(spark, rows, parts)
    assert got == _plain(rows) and sum(len(r[2]) for r in got) > 60


def test_common_strings_and_long_texts(spark):
    """A line at hundreds of places of one flush with other neighbours each time, and a text of several pieces."""
    rng = random.Random(4)
    line = "this line stands in very many places of the texts"
    rows = [(i, "\n".join(f"{rng.random()}{line}{rng.random()}" for _ in range(120))) for i in range(8)]
    long = "".join(rng.choice("abcdefghij ") for _ in range(passages.PIECE + 5_000))
    cut = passages.PIECE - 20
    rows += [(20, long), (21, "before " + long[cut : cut + 300] + " after"), (22, long[-60:]), (23, "." * 30 + long[:51])]
    assert _found(spark, rows, 2) == _plain(rows)


def test_empty_table(spark):
    assert passages.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    (r,) = passages.without_repeats(spark.createDataFrame([(1, None, 0, "")], SCHEMA)).collect()
    assert (r.n_bytes, r.removed, bytes(r.kept)) == (0, [], b"")


def test_suffixes_are_sorted():
    rng = np.random.default_rng(0)
    for trial in range(200):
        data = (rng.integers(0, rng.integers(1, 5), rng.integers(0, 300)) + rng.integers(0, 2) * 97).astype(np.uint8)
        data = np.tile(data, 4)[:300] if trial % 3 == 0 else data
        wanted = rng.random(len(data)) < rng.random()
        order, padded = suffixes.suffix_order(data, wanted), data.tobytes() + b"\0" * 56
        own = [padded[i : i + 50] for i in order]
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist() and own == sorted(own)
        same = suffixes.alike(order, data, 20)
        assert same.tolist() == [k > 0 and padded[order[k - 1] : order[k - 1] + 20] == padded[order[k] : order[k] + 20] for k in range(len(order))]


def test_only_small_suffixes_are_sorted_directly(monkeypatch):
    data = np.frombuffer(b"mississippi river banks", np.uint8)
    seen = []
    direct = suffixes._direct
    monkeypatch.setattr(suffixes, "_direct", lambda places, word: seen.extend(places.tolist()) or direct(places, word))
    text = data.tobytes() + b"\0"
    order = suffixes.suffix_order(data, np.ones(len(data), bool))
    assert order.tolist() == sorted(range(len(data)), key=lambda i: text[i:])
    assert sorted(seen) == [i for i in range(len(text)) if i == len(text) - 1 or text[i:] < text[i + 1 :]]


def test_whole_copies_take_no_part(spark):
    """Texts that a smaller doc_id has whole lose all bytes and send no anchors; rows of one doc_id, short texts and null ids stay as they are."""
    rng = np.random.default_rng(12)
    words = lambda k: " ".join(f"w{v}" for v in rng.integers(0, 10**6, k))
    one, two, shared = words(60), words(60), words(20)
    rows = [(5, one), (3, one), (3, one), (9, one), (None, one), (4, shared + one), (7, two + shared), (8, two + shared), (2, "short"), (6, "short"), (1, ""), (0, None)]
    docs = spark.createDataFrame(rows * 1, "doc_id long, text string").repartition(3)
    got = {}
    for r in passages.without_repeats(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, [(x.start, x.stop) for x in r.removed], bytes(r.kept).decode()))
    n = len(one)
    assert got[3] == [(n, [], one)] * 2 and got[None] == [(n, [], one)] and got[5] == got[9] == [(n, [(0, n)], "")]
    assert got[4] == [(len(shared) + n, [(len(shared), len(shared) + n)], shared)]
    assert got[7] == [(len(two + shared), [(len(two), len(two + shared))], two)] and got[8] == [(len(two + shared), [(0, len(two + shared))], "")]
    assert got[2] == got[6] == [(5, [], "short")] and got[1] == got[0] == [(0, [], "")]
    table = passages.flushes(docs, 10_000)
    assert sum(len(r.copies) for r in passages.copies(table).collect()) == 3
