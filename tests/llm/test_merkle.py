"""The Merkle manifest against a plain recursive tree."""

import hashlib
import zlib

import pytest

from synchro.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def _paths(nodes, fanout):
    """The root of nodes and each node's (siblings before, siblings after) by level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            run = nodes[p - p % fanout : p - p % fanout + fanout]
            paths[k].append((run[: p % fanout], run[p % fanout + 1 :]))
        nodes, place = [_h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)], [p // fanout for p in place]
    return nodes[0], paths


def _plain(rows, fanout):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for x in langs}
    trees = {x: _paths([_leaf(r) for r in own], fanout) for x, own in groups.items()}
    root, above = _paths([trees[x][0] for x in langs], fanout)
    out = []
    for x, up in zip(langs, above, strict=True):
        for r, path in zip(groups[x], trees[x][1], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = _leaf((*r[:3], r[3] + 1, r[4])) if hit else _leaf(r)
            for before, after in path + up:
                node = _h(*before, node, *after)
            out.append((str(r[0]), _leaf(r), trees[x][0], root, _h(*("".join(b + a) for b, a in path + up)), node, node == root))
    return sorted(out)


def _rows(sizes):
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((i * 3, None if i % 5 == 0 else f"src{i % 4}", lang, None if i % 11 == 0 else i, ["", "é" * (i % 9), None, "word " * i][i % 4], "extra"))
            i += 1
    rows += [rows[1], rows[1], (None, None, None, None, None, "x"), (None, "a", "de", 3, "t", None)]
    return rows


@pytest.mark.parametrize("sizes, height, fanout", [
    ({None: 1, "de": 13, "en": 37, "zh": 1, "é": 8, "a": 4}, 2, 2),
    ({"de": 13, "en": 70, "": 9}, 1, 3),
    ({"en": 5}, 12, 2),
])
def test_equals_a_plain_tree(spark, sizes, height, fanout):
    """Many partitions and languages, virtual partitions, single leaves, repeated rows, null ids and fields, one language."""
    rows = _rows(sizes)
    got = sorted((str(r[0]), *r[1:]) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), height, fanout).collect())
    assert got == _plain(rows, fanout)
    assert {r[6] for r in got} == {True, False} or len(sizes) == 1


def test_one_leaf_and_none(spark):
    row = (7, "s", "en", 2, "ab", None)
    (got,) = merkle.manifest(spark.createDataFrame([row], SCHEMA)).collect()
    assert got.leaf == got.subroot == got.root == _leaf(row) and got.proof_sha256 == _h() and got.verified
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
