"""Spelling variants against plain Python."""

import collections
import random
import re
import zlib

import numpy as np

from synchro.llm import common, spelling

SCHEMA = "doc_id long, text string, word string, n long"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(rows):
    out = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(_LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 5}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _plain(rows):
    words, out = _words(rows), {}
    near = {w: [v for v in words if v != w and _near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def _edit(rng, word):
    k, c = rng.randrange(len(word) + 1), rng.choice("abéÿ÷z")
    return rng.choice([word[:k] + c + word[k:], word[:k] + c + word[k + 1 :], word[:k] + word[k + 1 :]])


def test_equals_plain_python(spark):
    """Edits at every place, repeated letters, accents, ties, chains of forms, long runs, null ids and texts, repeated rows."""
    rng, rows = random.Random(5), []
    bag = []
    for stem in ("straße", "aaaaaa", "Ångström", "notation", "bananaÀ", "x" * 60, "é" * 40, "ab" * 700):
        bag += [stem] * 40
        for _ in range(12):
            bag += [_edit(rng, stem)] * rng.choice([5, 6, 8])
    chain = ["planet", "planetx", "planetxy", "planetxyz", "planetxyzw"]
    for k, w in enumerate(chain):
        bag += [w.upper() if k % 2 else w] * (5 * 6 ** (len(chain) - 1 - k))
    rng.shuffle(bag)
    for i in range(0, len(bag), 23):
        rows.append((None if i % 17 == 0 else i, rng.choice([" ", "\n", "1", " × ", "Ā"]).join(bag[i : i + 23])))
    rows += [(3, None), (4, ""), (5, "short words"), rows[1], rows[1], (6, "12 34 …")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(7)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}
    want = _plain(rows)
    assert got == want and want["planetxyzw"][1] == "planet" and sum(w[3] for w in want.values()) > 100


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "rare words only", None, None)], SCHEMA)).count() == 0


def test_pairs_leave_the_join_once(spark):
    """A thousand words that share a chunk: as many rows leave the join as there are near pairs."""
    rng = random.Random(2)
    words = sorted({"common" + "".join(rng.choice("abcd") for _ in range(6)) for _ in range(1_500)})
    got = [(r.x, r.y) for r in spelling.near(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()]
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if _near(a, b)}
    assert len(got) == len(want) and set(got) == want


def test_crcs():
    texts = ["a" * k + " é" * (k % 3) + " ÿz" for k in range(1, 120)]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    text, off, row = spelling.runs(np.concatenate(raw), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    ids = list(range(len(texts)))
    want = [zlib.crc32(f"{i}:{w}".encode()) for i, t in zip(ids, texts) for w in t.split()]
    assert spelling.crcs(ids, text, off, row).tolist() == want and common.CHUNK_BYTES < spelling.BLOCK_BYTES
