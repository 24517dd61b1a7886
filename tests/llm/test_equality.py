"""Equal hashes of unequal texts, bounded samples, captures of any layout, and scores that don't depend on indexes."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from synchro.llm import common, decontaminate, neardup, packing, quality_crf, quality_rules, token_files, tokens, toxicity, warc

COLUMNS = "doc_id long, text string"


def _thue_morse(n):
    bits = "a"
    while len(bits) < n:
        bits += bits.translate(str.maketrans("ab", "ba"))
    return bits, bits.translate(str.maketrans("ab", "ba"))


def _raw(*texts):
    parts = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


@pytest.mark.parametrize("n", [256, 1024, 2048, 4096])
def test_a_pattern_and_its_complement_differ(n):
    data, at = _raw(*_thue_morse(n))
    a, b = common.span_hashes(data, at[:-1], at[1:])
    assert a != b
    alone = [common.span_hashes(*_raw(t)[:1], np.array([0]), np.array([n]))[0] for t in _thue_morse(n)]
    assert [a, b] == alone  # wherever a range stands


@pytest.mark.parametrize("module", [token_files, packing])
def test_token_ids_of_the_pair(spark, module):
    """Ids are the library's, whichever text comes first."""
    file = module.tokenizer_path(module.TOKENIZER)
    for pair in (_thue_morse(1024), _thue_morse(1024)[::-1]):
        own = tokens.Encoder(file, module is token_files)
        ids, first = own.encode(*_raw(*pair, "plain words", *pair))
        for k, t in enumerate((*pair, "plain words", *pair)):
            assert ids[first[k] : first[k + 1]].tolist() == own.whole(t)


@pytest.mark.parametrize("module", [token_files, packing])
def test_unequal_pieces_of_one_hash(monkeypatch, module):
    """Were all pieces of one length to collide, ids would still be the library's."""
    monkeypatch.setattr(tokens.C, "span_hashes", lambda data, s, e, fold_case=False: common.mix((e - s).astype(np.uint64)))
    own = tokens.Encoder(module.tokenizer_path(module.TOKENIZER), module is token_files)
    texts = ["one two six ten", "abc, abd: abe", "a long pieceoverSixteenBytes pieceoverSixteenBytez", "  spaces\n\nand\tmore", "12 34 56", ""]
    for _ in range(2):
        ids, first = own.encode(*_raw(*texts))
        assert [ids[first[k] : first[k + 1]].tolist() for k in range(len(texts))] == [own.whole(t) for t in texts]


def test_sets_and_terms_of_the_pair(spark):
    a, b = _thue_morse(1024)
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"x {a}"), (4, f"{b} one two three four"), (5, f"{a} one two three four"), (6, a)], COLUMNS)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1}
    items = spark.createDataFrame([(1, f"{a} one two three four")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.leaks(docs, items).collect()] == [5]


def test_lines_and_windows_of_the_pair(spark):
    a, b = _thue_morse(1024)
    docs = spark.createDataFrame([(1, f"{a}\n{b}\n{a}")], COLUMNS)
    assert quality_rules.judged(docs, None).first().n_dup_lines == 1


@pytest.mark.parametrize("place", range(6))
def test_long_texts_don_t_empty_the_sample(spark, monkeypatch, place):
    monkeypatch.setattr(common, "TRAIN_BYTES", 20_000)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, "y" * 9_000 if k == place * 7 else "z" * 30_000 if k == place * 7 + 1 else "x" * 90) for k, i in enumerate(ids)], COLUMNS)
    marks = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    got = common.training_sample(docs, marks, "toxic", 5, 0, 100).toPandas()
    sizes = got.text.str.len()
    assert collections.Counter(got.label) == pytest.approx({0: 50, 1: 50}, abs=2) and sizes.sum() <= 20_000
    marks = spark.createDataFrame([(i, i % 2) for i in ids if i % 2 == 0 or i in ids[place * 7 : place * 7 + 1]] + [(ids[place * 7], 1)], "doc_id long, toxic int")
    assert set(common.training_sample(docs, marks, "toxic", 5, 0, 100).toPandas().label) >= {0}


def test_contradictory_labels(spark):
    """Of labels that contradict one another the lower one counts, and the classifiers still fit."""
    rows = [(i, f"good words in line {i}\nand more of them {i}" if i % 2 else f"@@ ## {i} !!\n%% $$ vile scum {i}") for i in range(120)]
    docs = spark.createDataFrame(rows, COLUMNS)
    marks = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(120)] + [(i, 1 - i % 2, i % 2) for i in range(0, 120, 10)], "doc_id long, quality int, toxic int")
    for mark, parts, held in (("quality", 3, 1), ("toxic", 5, 0)):
        got = common.training_sample(docs, marks, mark, parts, held, 400).toPandas()
        assert got.doc_id.is_unique and set(got[got.doc_id % 10 == 0].label) == {0}
    assert quality_rules.judged(docs, quality_rules.fit(docs, marks)).count() == 120
    assert quality_crf.score_texts(docs, quality_crf.fit(docs, marks)).count() == toxicity.score_texts(docs, toxicity.fit(docs, marks)).count() == 120


@pytest.mark.parametrize("layout", ["scan", "repartition", "by key", "sorted"])
def test_captures_of_any_layout(spark, layout):
    """Each payload has one response, whatever frame the pages come from; equal rows, null ids and clashing columns included."""
    rows = [(i, f"http://h/{i % 7}", f"<p>{i % 300}</p>", "x") for i in range(2_000)] + [(5, "http://h/5", "<p>5</p>", "y")] * 3 + [(None, "u", "<p>5</p>", "z")] * 2 + [(9_000, None, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, own string")
    pages = {"scan": pages, "repartition": pages.repartition(13), "by key": pages.repartition(5, "html"), "sorted": pages.orderBy(F.rand(3))}[layout]
    got = warc.captures(pages).select("page_id", "own", "url", "sha", "first").collect()
    assert len(got) == len(rows)
    responses = collections.Counter(r.sha for r in got if r.first is None and r.page_id is not None)
    assert len(responses) == 301 and set(responses.values()) == {1}
    known = {(r.page_id, r.own, r.url, r.sha) for r in got if r.first is None}
    assert all(tuple(r.first) in known for r in got if r.first) and len({(r.page_id, r.own, r.url, r.sha) for r in got}) == len(rows)


def test_scores_don_t_depend_on_indexes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    draw = lambda n: [f"w{k}" for k in rng.zipf(1.3, n) % 4_000]
    items = [(i, " ".join(draw(int(n)))) for i, n in enumerate(rng.integers(8, 400, 40))] + [(99, "just two"), (98, None)]
    docs = spark.createDataFrame([(i, " ".join(draw(60)) + " " + (t or "") + " " + " ".join(draw(30))) for i, t in items], COLUMNS)
    items = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "INDEX_WORDS", 1_000)
    parts = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    assert len(whole) >= 40 and [r[:2] for r in whole] == [r[:2] for r in parts]
    assert [x for r in parts for x in r[2:]] == pytest.approx([x for r in whole for x in r[2:]], abs=1e-6)


def test_packing_hands_tasks_few_rows_at_a_time(spark, monkeypatch):
    """Encoders and windows lie beside the batches, so these are small; the session's setting is there again afterwards."""
    name, seen, saved = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, common.saved
    before = spark.conf.get(name)
    monkeypatch.setattr(common, "saved", lambda df, what: seen.setdefault(what, int(spark.conf.get(name))) and saved(df, what))
    docs = spark.range(2500).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    pieces = packing.packed(docs, token_files.tokenizer_path(packing.TOKENIZER))
    assert pieces.agg({"length": "sum"}).first()[0] == sum(len(tokens.Encoder.of(token_files.tokenizer_path(packing.TOKENIZER), False).whole(f"text {i}")) + 1 for i in range(2500))
    assert 0 < seen["pieces"] <= common.BATCH_ROWS and spark.conf.get(name) == before
    with common.small_batches(spark):
        rows = spark.range(0, 2500, 1, 1).mapInArrow(lambda batches: (b.slice(0, 1).from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert max(r.n for r in rows) <= common.BATCH_ROWS and sum(r.n for r in rows) == 2500


def test_stages_hand_tasks_few_rows_at_a_time(spark, sf_dir, monkeypatch):
    """What runs Python in toxicity, near-dedup and decontamination runs with small batches; the session's setting is there again afterwards."""
    name, seen, saved = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, common.saved
    before = spark.conf.get(name)
    monkeypatch.setattr(common, "saved", lambda df, what: seen.setdefault(what, int(spark.conf.get(name))) and saved(df, what))
    for step in ("vocabulary", "trained", "_steps"):
        monkeypatch.setattr(toxicity, step, lambda *a, step=step, f=getattr(toxicity, step): seen.setdefault(step, int(spark.conf.get(name))) and f(*a))
    docs = common.documents(spark, sf_dir)
    for stage in (toxicity.stage, neardup.stage, decontaminate.stage):
        plan = stage(spark, docs, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and spark.conf.get(name) == before  # what is still to run has no Python
    assert {"vocabulary", "encoded", "trained", "_steps", "scores", "sketches", "pairs", "sets", "more-links", "leaks"} <= set(seen)
    assert {k: v for k, v in seen.items() if v > common.BATCH_ROWS} == {}


def test_memory_of_pieces_is_tight_and_keeps_wide_ids():
    """Ids take two bytes until one needs more, arrays grow by a quarter, and all ids come back as they went in."""
    memory, rng = tokens.Memory(), np.random.default_rng(4)
    h = np.unique(rng.integers(1, 1 << 63, 300_000).astype(np.uint64))
    sizes = rng.integers(1, 5, len(h))
    ids = rng.integers(0, 50_000, sizes.sum()).astype(np.uint32)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for a in range(0, len(h), 10_000):
        b = min(a + 10_000, len(h))
        memory.add(h[a:b], ids[at[a] : at[b]], sizes[a:b], h[a:b], [b"x"] * (b - a))
    assert memory.ids.nbytes <= 2.5 * len(ids) + 10_000 and len(memory.first) <= 1.25 * len(h) + 10_000
    got, n = memory.gather(memory.find(h))
    assert got.dtype == np.uint32 and (got == ids).all() and (n == sizes).all()
    memory.add(np.array([5], np.uint64), np.array([70_000, 3], np.uint32), np.array([2]), np.array([5], np.uint64), [b"y"])
    got, n = memory.gather(memory.find(np.concatenate((h, [np.uint64(5)]))))
    assert (got == np.concatenate((ids, [70_000, 3]))).all()
