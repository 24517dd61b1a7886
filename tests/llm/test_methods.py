"""The operators' methods against plain loops: decontamination, formats, personal data, toxicity, forward-backward, the pipeline."""

import collections
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from synchro.llm import common, decontaminate, neardup, packing, pii, quality_crf, quality_rules, secret_scan, toxicity

# ------------------------------------------------------------------ decontamination


def _pairs(w):
    return [tuple(w[i : i + 2]) for i in range(len(w) - 1)] if len(w) > 1 else [(*w, None)]


def _exhaustive(items, texts):
    """BM25 shares of every passage and part by dictionaries: {(text, item): best} at or above the threshold."""
    d = decontaminate
    parts, owner = [], []
    for k, w in enumerate(items):
        for a in [*range(0, len(w) - d.PART, d.PART_STEP), max(len(w) - d.PART, 0)]:
            parts.append(_pairs(w[a : a + d.PART]))
            owner.append(k)
    df = collections.Counter(t for w in items for t in set(_pairs(w)))
    mean, impacts = np.mean([len(p) for p in parts]), []
    for p in parts:
        one = {}
        for t, c in collections.Counter(p).items():
            idf = math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5))
            one[t] = idf * c * (d.K1 + 1) / (c + d.K1 * (1 - d.B + d.B * len(p) / mean))
        impacts.append({t: x / sum(one.values()) for t, x in one.items()})
    out = {}
    for r, w in enumerate(texts):
        p, half = _pairs(w), d.PASSAGE // 2
        halves = [set(p[a : a + half]) for a in range(0, len(w), half)]
        for q in [halves[0]] if len(halves) == 1 else [a | b for a, b in itertools.pairwise(halves)]:
            for k, impact in enumerate(impacts):
                score = sum(x for t, x in impact.items() if t in q)
                if score >= d.THRESHOLD:
                    out[r, owner[k]] = max(out.get((r, owner[k]), 0), score)
    return out


@pytest.mark.parametrize("at_once", [1 << 20, 128])
def test_search_equals_exhaustive_bm25(monkeypatch, at_once):
    """Every passage, every item, ties and near misses included; words are Zipf-distributed, so many pairs are common."""
    monkeypatch.setattr(decontaminate, "ENTRIES_AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    share = 1 / np.arange(1, 2001)
    draw = lambda n: [f"w{k}" for k in rng.choice(2000, n, p=share / share.sum())]
    items = [draw(n) for n in [*rng.integers(2, 60, 80), 20, 64, 65, 100, 300, 700, 2000]]
    items.append(items[5])  # a tie
    texts = []
    for i in range(150):
        w = draw(int(rng.integers(1, 400)))
        if i % 2:
            item = items[int(rng.integers(0, len(items)))]
            k = int(rng.integers(0, len(w) + 1))
            w[k:k] = item[int(rng.integers(0, max(1, len(item) // 2))) :]
        texts.append(w)
    index, got = decontaminate.Index([" ".join(w) for w in items]), {}
    for i, _, data, at in common.chunks(pa.array([" ".join(w) for w in texts])):
        _, _, first, h = decontaminate.tokens(data, at)
        got |= {(i + r, k): score for r, k, score in index.search(h, first)}
    assert got == pytest.approx(_exhaustive(items, texts), abs=1e-5)


def test_index_of_long_items_is_sparse():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 20_000, 300)) for _ in range(2_000)]
    assert decontaminate.Index(texts).nbytes() < 100e6


def test_repeated_items_and_narrow_ids(spark):
    """2,001 rows of one item are one item; ids keep their type; one text under many ids is found under each."""
    one = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = spark.createDataFrame([(1, one)] * 2_001 + [(None, one), (2, one), (3, None), (4, "  ")], "item_id int, text string")
    docs = spark.createDataFrame([(5, f"So: {one}!"), (6, "nothing of it"), (7, None), (None, one)], "doc_id int, text string")
    got = decontaminate.leaks(docs, items)
    assert [f.dataType.simpleString() for f in got.schema.fields[:2]] == ["int", "int"]
    assert sorted(map(str, ((r.doc_id, r.item_id) for r in got.collect()))) == sorted(map(str, itertools.product((5, None), (1, 2, None))))
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), items).count() == 0


# ------------------------------------------------------------------ formats of secrets

ALNUM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _credentials(rng, n):
    return [b"key_" + bytes(rng.choice(list(ALNUM), 36).tolist()) for _ in range(n)]


def _ordinary(rng, n):
    part = [b"tion", b"ing", b"the", b"er", b"and", b"keit", b"sch", b"ment"]
    words = [b"".join(part[k] for k in rng.integers(0, 8, rng.integers(2, 6))) for _ in range(n)]
    return list(dict.fromkeys(words)) + [b"%d.%d.%d.%d" % tuple(rng.integers(1, 255, 4)) for _ in range(40)] + [bytes(rng.choice(list(b"0123456789"), 16).tolist()) for _ in range(40)]


def test_automata_tell_formats_that_letters_cannot():
    """Shuffled credentials have the credentials' characters, so no unigram model tells them apart."""
    rng = np.random.default_rng(3)
    known, new, plain = _credentials(rng, 100), _credentials(rng, 100), _ordinary(rng, 900)
    assert secret_scan.Automaton(known).states > 30  # prefix and length are states
    model = secret_scan.model_of([known, [], []], plain, {0: 100, 3: 10_000_000})
    shuffled = [bytes(rng.permutation(list(v)).tolist()) for v in new]
    cut = [v[:-8] for v in new]
    accepted = lambda values: secret_scan.scores(model, *secret_scan._joined(values)) > model["cut"]
    assert accepted(new).mean() > 0.97 and not accepted(shuffled).any() and not accepted(cut).any() and not accepted(_ordinary(rng, 500)).any()


def test_likelihood_by_hand():
    """Of a x 3 and a b x 1: P(a) = 1, then P(end) = 3/4 and P(b) = 1/4 where states stay apart."""
    tables = secret_scan.Automaton([b"a"] * 300 + [b"ab"] * 100).tables()
    at = np.array([0, 1, 3])
    got = secret_scan.log_likelihoods(tables, np.frombuffer(b"aabba", np.uint8), np.array([0, 1, 3]), np.array([1, 3, 5]))
    assert at[0] == 0 and got[:2] == pytest.approx([math.log(3 / 4), math.log(1 / 4)]) and got[2] == -np.inf


def test_formats_are_found_in_documents(spark):
    rng = np.random.default_rng(4)
    keys, words = [v.decode() for v in _credentials(rng, 90)], [v.decode() for v in _ordinary(rng, 900)]
    rows = [(i, f'so token = "{k}" it is') for i, k in enumerate(keys[:50])]
    rows += [(100 + i, f"é {' '.join(rng.choice(words, 30))} {k}. and") for i, k in enumerate(keys[50:])]
    rows += [(200 + i, " ".join(rng.choice(words, 60))) for i in range(60)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secret_scan.fit(docs)
    text = dict(rows)
    found = {r.doc_id: [text[r.doc_id][m.start : m.end] for m in r.spans if m.kind == "format"] for r in secret_scan.scanned(docs, model).collect()}
    assert {i: v for i, v in found.items() if v} == {100 + i: [k] for i, k in enumerate(keys[50:])}
    assert secret_scan.fit(docs.limit(0)) is None and secret_scan.scanned(docs.limit(0), None).count() == 0


def test_formats_come_from_all_values(spark):
    """A format of 14 values among thousands of others is in a language, and frequencies are those of all values."""
    rng = np.random.default_rng(5)
    draw = lambda n, of: ["".join(map(chr, rng.choice(list(of), 24))) for _ in range(n)]
    common_, rare = draw(3000, b"0123456789"), draw(14, b"abcdefghijklmnopqrstuvwxyz")
    rows = [(i, f'token = "{v}" it is') for i, v in enumerate(common_ + rare)]
    rows += [(5000 + i, " ".join(w.decode() for w in _ordinary(rng, 60)[:60])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secret_scan.fit(docs)
    inside = lambda values: [any(x > -np.inf for x in own) for own in zip(*(secret_scan.log_likelihoods(t, *secret_scan._joined([v.encode() for v in values])) for t in model["good"]), strict=True)]
    assert inside(common_ + rare).count(False) < secret_scan.LEAST_SAMPLE
    # frequencies are those of all values, not of those that gave the states
    automaton = secret_scan.Automaton([b"ab"] * 500 + [b"ac"] * 500)
    data, s, e = secret_scan._joined([b"ab"] * 900 + [b"ac"] * 100)
    automaton.recount(secret_scan.steps(automaton.tables(), data, s, e))
    assert np.exp(secret_scan.log_likelihoods(automaton.tables(), data, s[-101:], e[-101:])[[0, -1]]) == pytest.approx([0.9, 0.1])


def test_chain_of_ordinary_runs():
    """Every context's shares sum to one, and a run's triples are counted once, its end included."""
    data, s, e = secret_scan._joined([b"abab", b"b"])
    n = secret_scan.triples(data, s, e)
    assert n.sum() == 7
    _, step, end = secret_scan.chain(n)
    assert np.exp(step).sum(1) + np.exp(end) == pytest.approx(np.ones(len(end)), abs=1e-5)


# ------------------------------------------------------------------ personal data


def test_reliabilities_against_loops():
    """Two rounds of expectation-maximisation, written out row by row."""
    table = [((2, 2, 0, 0, 0), 30), ((0, 1, 1, 0, 0), 50), ((0, 0, 2, 0, 2), 9), ((2, 0, 2, 2, 2), 40)]
    _, _, got = pii.reliabilities(table, 2)
    rows = [v for v, n in table for _ in range(n)]
    post = [0.5 if (s := sum((x == 2) - (x == 1) for x in v)) == 0 else 0.9 if s > 0 else 0.1 for v in rows]
    for _ in range(2):
        prior = (sum(post) + 1) / (len(rows) + 2)
        p = {}
        for j, k, vote in itertools.product(range(5), (0, 1), range(3)):
            strength = 1 + pii.BELIEF * len(rows)
            hits = sum((q if k else 1 - q) for q, v in zip(post, rows) if v[j] == vote)
            p[j, k, vote] = (strength * pii.EXPECTED[k][vote] + hits) / (strength + sum(q if k else 1 - q for q in post))
        good = [prior * math.prod(p[j, 1, v[j]] for j in range(5)) for v in rows]
        bad = [(1 - prior) * math.prod(p[j, 0, v[j]] for j in range(5)) for v in rows]
        post = [g / (g + b) for g, b in zip(good, bad)]
    at = np.cumsum([0] + [n for _, n in table[:-1]])
    assert got == pytest.approx([post[i] for i in at], abs=1e-6)


def test_span_classifier_refuses_decoys(spark):
    """Sixteen digits that fail the check digit and order numbers are no personal data; what the base patterns drop is found."""

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    rng = np.random.default_rng(5)
    numbers = ["4" + "".join(map(str, rng.integers(0, 10, 15))) for _ in range(2000)]
    good, bad = [n for n in numbers if luhn(n)][:120], ["9" + n[1:] for n in numbers if not luhn("9" + n[1:])][:120]
    phone = lambda i: f"+1 (212) 555-{i:04d}"
    rows = [(i, f"card {n} here") for i, n in enumerate(good[:80])] + [(200 + i, f"seen {n} here") for i, n in enumerate(bad)]
    rows += [(400 + i, f"call {phone(i)} now") for i in range(80)] + [(500 + i, f"write a{i}@b.org now") for i in range(80)]
    rows += [(600 + i, f"both {phone(i)} {n} there") for i, n in enumerate(good[80:])]
    text = dict(rows)
    spans = {r.doc_id: [text[r.doc_id][m.s : m.e] for m in r.spans if m.kind == "other"] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(v for i, v in spans.items() if i < 600)
    assert all(spans[600 + i] == [phone(i), n] for i, n in enumerate(good[80:]))


# ------------------------------------------------------------------ toxicity


def test_words_and_stems_share_one_pass_over_the_bytes(monkeypatch):
    """Keys of a text are hashes of its words and of their first 4, 6 and 8 characters; the bytes are summed up once for all of them."""
    texts = ["Abcd abcde ABCDEFGHIJ äöüßé äöüß naïvetés a", "", "日本語テキストです ok", "x1y2z3w4v5"]
    _, _, data, at = next(common.chunks(pa.array(texts)))
    calls, sums = [], common.feature_sums
    monkeypatch.setattr(common, "feature_sums", lambda *a, **k: calls.append(1) or sums(*a, **k))
    h, first = toxicity.keys(data, at)
    assert len(calls) == 1

    def hashed(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return common.feature_hashes(raw, np.array([0]), np.array([len(raw)]), fold_case=True)

    words = [w for t in texts for w in t.split()]
    assert first.tolist() == [0, 7, 7, 9, 10] and len(h) == len(words)
    for own, w in zip(h, words, strict=True):
        assert own[0] == hashed(w)[0]
        for k, size in enumerate(toxicity.STEMS):
            assert own[k + 1] == (common.mix(hashed(w[:size]) + np.uint64(size))[0] if len(w) > size else 0)


def test_convolution_and_pooling_against_loops():
    rng = np.random.default_rng(6)
    texts = ["one two three four five six", "", "seven", "two two seven nine ten eleven twelve one", "Überwältigend größere Straßenbahnhaltestellen"]
    buffers = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    data, at = np.concatenate(buffers), np.concatenate(([0], np.cumsum([len(b) for b in buffers])))
    h, first = toxicity.keys(data, at)
    stems = {w[:4] for t in texts for w in re.findall(r"\w+", t.lower()) if len(w) > 4}
    assert len(np.unique(h[:, 1])) == len(stems) + 1 and not h[len("one two".split()) - 2, 1:].any()
    tags = toxicity.tagged(*np.unique(h, return_counts=True), least=1)
    net = toxicity.Net(rng.normal(0, 1, toxicity.BUCKETS))
    ids = toxicity.word_ids(h, first, tags)
    got = toxicity.logits(net.tables(), ids, toxicity._padded_first(first))
    starts = toxicity._padded_first(first)
    for r in range(len(texts)):
        x = [sum(net.p["E"][k] for k in row) for row in ids[starts[r] : starts[r + 1]]]
        pooled = []
        for w in toxicity.WIDTHS:
            z = [sum(x[i + j] @ net.p[f"W{w}"][j] for j in range(w)) + net.p[f"b{w}"] for i in range(len(x) - w + 1)]
            pooled.append(np.max([*z, np.zeros(toxicity.FILTERS)], 0))
        assert got[r] == pytest.approx(np.concatenate(pooled) @ net.p["v"] + net.p["c"][0], abs=1e-4)


# ------------------------------------------------------------------ quality


def test_forward_backward_against_enumeration():
    """log Z, marginals and pairs of states of chains of 1 to 6 lines, over all paths."""
    rng = np.random.default_rng(7)
    starts = np.array([0, 1, 1, 4, 10])
    u, trans = rng.normal(0, 1, 10), np.array([[0, -0.7], [-0.4, 1.1]])
    chains = quality_crf.Chains(starts)
    log_z, marginal, pairs = chains.run(u, trans)
    for place, r in enumerate(chains.order):
        own, n = u[starts[r] : starts[r + 1]], starts[r + 1] - starts[r]
        paths = {p: math.exp(sum(own[i] * s for i, s in enumerate(p)) + sum(trans[a, b] for a, b in itertools.pairwise(p))) for p in itertools.product((0, 1), repeat=int(n))}
        z = sum(paths.values())
        assert log_z[place] == pytest.approx(math.log(z))
        assert marginal[starts[r] : starts[r + 1]] == pytest.approx([sum(w for p, w in paths.items() if p[i]) / z for i in range(n)])
        for a, b in itertools.product((0, 1), repeat=2):
            assert pairs[place, a, b] == pytest.approx(sum(w * sum(q == (a, b) for q in itertools.pairwise(p)) for p, w in paths.items()) / z, abs=1e-9)


def test_gradient_of_the_field_against_differences():
    """Training's gradient, d log Z / d theta and d log(Z - 1) / d theta, by finite differences of enumerated sums."""
    rng = np.random.default_rng(8)
    x, trans = rng.normal(0, 1, (4, 3)), np.array([[0, -0.5], [-0.3, 0.6]])
    weights = rng.normal(0, 1, 3)

    def log_z(w):
        u = x @ w
        return math.log(sum(math.exp(sum(u[i] * s for i, s in enumerate(p)) + sum(trans[a, b] for a, b in itertools.pairwise(p))) for p in itertools.product((0, 1), repeat=4)))

    z, p, _ = quality_crf.Chains(np.array([0, 4])).run(x @ weights, trans)
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        good = (log_z(weights + step) - log_z(weights - step)) / 2e-6
        bad = good - (math.log(math.expm1(log_z(weights + step))) - math.log(math.expm1(log_z(weights - step)))) / 2e-6
        assert (x.T @ p)[k] == pytest.approx(good, abs=1e-5)
        assert (x.T @ p)[k] * -1 / math.expm1(z[0]) == pytest.approx(bad, abs=1e-5)


def test_vocabulary_of_all_training_rows(spark):
    """All labelled rows outside the fold count, more than 3,000 of them, and a word of three texts has a tag."""
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('plain ', if(id % 2000 = 1, 'zzz', 'qqq')) AS text")
    rows = toxicity.training_rows(docs, spark.range(5000).selectExpr("id AS doc_id", "int(id % 10 = 0) AS toxic"))
    tags, seen = toxicity.vocabulary(rows)
    n = rows.count()
    assert n > 3800 and seen.sum((0, 1)).max() == n and (tags != 0).sum() >= 2
    assert toxicity.encoded(rows, tags).count() == n


def test_forest_and_threshold_from_all_rows(spark, monkeypatch):
    """The nodes' ranges are those of all rows, in every batch alike, and all labelled rows are counted."""
    monkeypatch.setattr(quality_rules, "SUBSAMPLE", 8)
    rng = np.random.default_rng(2)
    rows = [(i, True, i % 7 == 0, rng.random(quality_rules.SHARES).tolist()) for i in range(6000)]
    rows += [(6000, True, False, [99.0] * quality_rules.SHARES), (6001, True, False, [-99.0] * quality_rules.SHARES)]
    table = spark.createDataFrame(rows, "doc_id long, given boolean, base_failed boolean, x array<double>")
    forest = quality_rules.grown(table, len(rows))
    assert forest.each == 1 and forest.depth == 3
    marks = {r.doc_id: r.m for r in table.selectExpr("doc_id", f"pmod(xxhash64(doc_id, 10), {quality_rules.TREES}) AS m").collect()}
    x, mark = np.array([r[3] for r in rows]), np.array([marks[r[0]] for r in rows])
    again = quality_rules.Forest.blank(len(rows))
    while again.level <= again.depth:
        again.grow(*again.ranges(x, mark))
    assert (again.cut == forest.cut).all() and (again.path == forest.path).all()
    assert (forest.cut[mark[-2:], 1] != 0).all() and np.abs(forest.cut[:, 1]).max() > 1  # the two far rows are in their trees
    labels = spark.createDataFrame([(i, 1 - (i >= 5990)) for i in range(6002)], "doc_id long, quality int")
    assert quality_rules.fit_measured(table, labels)[1] > 0
    assert common.least_errors(np.array([5.0, 0, 1]), np.array([0, 1.0, 9])) == 1


def test_path_lengths_against_a_walk():
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (300, 4))
    forest = quality_rules.Forest(x)
    for row in [*x[:5], np.full(4, 9.0)]:
        total = 0.0
        for t in range(quality_rules.TREES):
            k = 1
            while forest.feature[t, k] >= 0:
                k = 2 * k + int(row[forest.feature[t, k]] >= forest.cut[t, k])
            total += forest.path[t, k]
        assert forest.anomaly(row[None])[0] == pytest.approx(2 ** (-total / quality_rules.TREES / forest.scale))
    assert forest.anomaly(np.full((1, 4), 9.0))[0] > np.quantile(forest.anomaly(x), 0.99)


# ------------------------------------------------------------------ pipeline

STAGE_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _copy(spark, sf_dir, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _redacted(text, spans):
    out, at = "", 0
    for s, e, kind in sorted((m.s, -m.e, m.kind) for m in spans):
        if s >= at:
            out += text[at:s] + f"<{kind.upper()}>"
        at = max(at, -e)
    return out + text[at:]


def test_pipeline_equals_a_plain_one(spark, sf_dir):
    """run()'s ids against a pipeline in plain Python over the same models: nothing lost, added or altered on the way."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tests.llm.test_llm import _classes

    docs = common.documents(spark, sf_dir)
    model = toxicity.fit(docs, common.labels(spark, sf_dir))
    toxic = {r.doc_id for r in toxicity.score_texts(docs, model).collect() if r.score >= 0.5}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    _, comp = _classes(rows)
    rows = {i: t for i, t in rows.items() if comp[i] == i}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    rows = {i: t for i, t in rows.items() if not any(plain(x) in plain(t) for x in items.values())}
    left = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.spans(left).collect()}
    tok = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    want = {i: tok.encode(_redacted(t or "", found[i]), add_special_tokens=False).ids + [packing.END_ID] for i, t in rows.items()}
    got = collections.defaultdict(dict)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id][r.start] = r.ids
    assert {i: [x for k in sorted(p) for x in p[k]] for i, p in got.items()} == want


@pytest.mark.parametrize("extra", ["gone", "spans", "_t", "n_base", "row", "base", "item_id", "score", "component_id", "rep", "kept", "bytes"])
def test_stages_leave_other_columns_alone(spark, sf_dir, extra):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"mail a{i}@b.org of document {i} with some words", "en", "s", 7, f"x{i}") for i in range(6)] + [(None, None, None, None, None, "none")], f"{STAGE_COLUMNS}, `{extra}` string")
    before = {r.doc_id: r[extra] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert {r.doc_id: r[extra] for r in out.collect()} == before


def test_pipeline_of_an_empty_table(spark, sf_dir, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, _copy(spark, sf_dir, tmp_path, spark.createDataFrame([], STAGE_COLUMNS))).count() == 0


def test_near_duplicates_keep_the_rows_of_the_smallest_id(spark):
    docs = spark.createDataFrame([(3, "a b c d e f g"), (1, "A b c d e f g"), (2, "other words are in this one"), (None, "a b c d e f g")], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in neardup.stage(spark, docs, "").collect()))) == ["1", "2", "None"]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        class _jsc:
            class sc:
                def getCheckpointDir(self):
                    class Nothing:
                        def isDefined(self):
                            return False

                    return Nothing()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        common.scratch_dir(Session())


def test_rows_of_a_frequent_shingle_are_dealt_to_cells(spark, monkeypatch):
    """10,000 copies with edits share a shingle: each pair across components is found once, and no cell holds many rows."""
    rng = np.random.default_rng(5)
    rows = [("hot", i, 0 if i % 50 else i, 100 + int(rng.integers(0, 4)), int(rng.integers(0, 20))) for i in range(10_000)]
    rows += [("two", i, i % 2, 40 + i % 30, i % 9) for i in range(60)] + [("one", i, 3, 50, 0) for i in range(40)] + [("single", 9, 9, 50, 1)]
    df = spark.createDataFrame(rows, "item string, rep long, component long, n_shingles long, place int")
    monkeypatch.setattr(neardup, "CELL", 128)
    cells = neardup._dealt(df)
    sizes = cells.groupBy("item", "low", "high").count().toPandas()
    assert sizes["count"].max() < 4 * 128
    assert sizes["count"].sum() < 10_000 * 3 + 300 * 80
    got = [(item, r["a"], r["b"]) for item in ("hot", "two", "one", "single") for r in neardup._met(cells.where(f"item = '{item}'")).collect()]

    def fits(x, y):
        left = min(x[3] - x[4], y[3] - y[4])
        return 100 * min(x[3], y[3]) >= 75 * max(x[3], y[3]) and 175 * left >= 75 * (x[3] + y[3])

    want = set()
    for item in ("hot", "two", "one"):
        own = [r for r in rows if r[0] == item]
        few = [r for r in own if r[2] != 0] if item == "hot" else own
        for x in few:
            for y in own:
                if x[2] != y[2] and fits(x, y):
                    want.add((item, min(x[1], y[1]), max(x[1], y[1])))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100_000
