"""Empty tables, many partitions, many lines, and what the token files' indexes leave unread."""

import collections

import numpy as np
import pytest

from synchro.llm import common, packing, quality_crf, quality_rules, token_files, toxicity

COLUMNS = "doc_id long, text string"


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def test_operators_of_an_empty_table(spark, nothing, tmp_path):
    token_files.write(nothing, str(tmp_path / "ids"), token_files.tokenizer_path(token_files.TOKENIZER))
    assert token_files.positions(token_files.read(spark, str(tmp_path / "ids"))).count() == 0
    assert packing.packed(nothing, packing.tokenizer_path(packing.TOKENIZER)).count() == 0
    assert quality_rules.judged(nothing, None).count() == 0
    assert quality_crf.score_texts(nothing, None).count() == toxicity.score_texts(nothing, None).count() == 0


def test_packing_of_many_partitions(spark):
    """Fifty partitions: leftovers are merged on two levels, sixteen windows overflow, and no id is lost."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 999, int(rng.integers(1, 700))))) for i in range(2_000)]
    file = packing.tokenizer_path(packing.TOKENIZER)
    got = packing.packed(spark.createDataFrame(rows, COLUMNS).repartition(50, "doc_id"), file).collect()
    one = packing.packed(spark.createDataFrame(rows, COLUMNS).coalesce(1), file).collect()
    whole = []
    for pieces in (got, one):
        by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
        for r in pieces:
            by_doc[r.doc_id].append(r)
            by_seq[r.sequence_id].append(r)
        for p in by_seq.values():
            at = 0
            for r in sorted(p, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= packing.LENGTH
        padding = sum(packing.LENGTH - sum(r.length for r in p) for p in by_seq.values())
        assert padding < packing.LENGTH + packing.LEAST_CUT * len(by_seq)
        whole.append({i: [x for r in sorted(p, key=lambda r: r.start) for x in r.ids] for i, p in by_doc.items()})
        assert all(len(ids) == by_doc[i][0].doc_tokens for i, ids in whole[-1].items())
    assert whole[0] == whole[1]
    assert len({r.sequence_id >> 57 for r in got}) >= 3  # first windows, and two levels of merging


def test_fullest_window_leaves_when_none_fits():
    packer = packing.Packer(0, 0)
    for k in range(packing.OPEN):  # windows of 1030, 1031, ... ids: none has room for another
        packer.add(k, 0, np.zeros(1030 + k, np.uint32), 1030 + k)
    assert len(packer.windows) == packing.OPEN and not packer.done
    packer.add(99, 0, np.zeros(1025, np.uint32), 1025)
    gone = {d[0]: d for d in packer.done}
    assert set(gone) == {packing.OPEN - 1, 99} and len(packer.windows) == packing.OPEN  # the fullest left, topped up with the new document's head
    packer.add(100, 0, np.zeros(1018, np.uint32), 1018)
    assert any(w[0] == 0 for w in packer.windows) or any(d[0] == 100 for d in packer.done)  # fits the window of 1030 exactly


def test_text_of_many_lines():
    """A text of 20,000 lines among short ones scores as it does alone."""
    rng = np.random.default_rng(2)
    model = (rng.normal(0, 0.3, 1 + quality_crf.OWN + 18), np.array([[0, -0.5], [-0.3, 0.6]]))
    texts = ["one line", "\n".join(f"line {k} of many {'!' * (k % 3)}" for k in range(20_000)), "", "two\nlines"]

    def shares(own):
        raw = [np.frombuffer(t.encode(), np.uint8) for t in own]
        return quality_crf.good_share(model, np.concatenate(raw), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))

    assert shares(texts) == pytest.approx([shares([t])[0] if t else 1.0 for t in texts])


def test_token_files_are_indexed(spark, tmp_path):
    """The footer has Bloom filters on doc_id, and a reader of one document leaves row groups unread."""
    rows = spark.range(60_000).selectExpr("id * 2 AS doc_id", "concat('word ', id, ' and more of it') AS text")
    path = str(tmp_path / "ids")
    token_files.write(rows, path, token_files.tokenizer_path(token_files.TOKENIZER))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = [str(p) for p in (tmp_path / "ids").glob("*.orc")]
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(files[0]), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == token_files.ROWS_PER_INDEX
    stripe = reader.getStripes().get(0)
    footer = reader.rows().readStripeFooter(stripe) if hasattr(reader.rows(), "readStripeFooter") else None
    if footer is not None:
        kinds = [str(footer.getStreams(k).getKind()) for k in range(footer.getStreamsCount())]
        assert any("BLOOM" in k for k in kinds) and "ROW_INDEX" in kinds

    def rows_read(ids):
        df = token_files.read(spark, path, ids).select("doc_id")
        n = df.count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "doc_id" in plan
        df.collect()
        scan = [m for m in _scans(df)]
        return n, sum(scan)

    def _scans(df):
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        for k in range(leaves.size()):
            metric = leaves.apply(k).metrics().get("numOutputRows")
            if metric.isDefined():
                yield metric.get().value()

    found, read = rows_read([30_000])
    assert found == 1 and 0 < read <= token_files.ROWS_PER_INDEX
    found, read = rows_read([30_001])  # between others, so only the Bloom filter can tell
    assert found == 0 and read <= token_files.ROWS_PER_INDEX


def test_training_texts_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(40)], COLUMNS)
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert common.training_sample(docs, marks, "toxic", 5, 0, 100).count() > 10
    monkeypatch.setattr(common, "TRAIN_BYTES", 10_000)
    assert common.training_sample(docs, marks, "toxic", 5, 0, 100).count() == 10


def test_toxicity_learns_from_labelled_texts_without_words(spark):
    """A row without words gives no response: it neither fails a training step nor moves an embedding or a filter."""
    docs = spark.range(400).selectExpr("id AS doc_id", "CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN '#*! |' WHEN id % 4 = 2 THEN 'you are awful' ELSE 'a fine day' END AS text").repartition(3)
    marks = spark.range(400).selectExpr("id AS doc_id", "int(id % 4 = 2) AS toxic")
    rows = toxicity.score_texts(docs, toxicity.fit(docs, marks)).join(marks, "doc_id").collect()
    assert len(rows) == 400 and all((r.score >= 0.5) == (r.toxic == 1) for r in rows)
    wordless = docs.where("doc_id % 4 < 2").coalesce(1)  # a batch, and a task, of nothing else
    tags, seen = toxicity.vocabulary(toxicity.training_rows(wordless, marks))
    assert not tags.any() and not seen.any()
    net, pad = toxicity.Net(np.zeros(toxicity.BUCKETS)), max(toxicity.WIDTHS) - 1
    before = {k: v.copy() for k, v in net.p.items()}
    net.step(np.zeros((2 * pad, 1 + len(toxicity.STEMS)), np.uint16), np.array([0, pad, 2 * pad]), np.array([0.0, 1.0]), np.array([1.0, 1.0]))
    assert all((net.p[k] == before[k]).all() for k in ("E", "W3", "b3")) and all(np.isfinite(v).all() for v in net.p.values())
