"""Benchmark decontamination by a BM25 index of test items with block-max WAND (operator 8).

Terms are pairs of neighbouring words: single words of a test item are common in any text, so bounds
on them would skip little.  Every text is cut into passages of PASSAGE words that overlap by half, and every passage queries an
inverted index of the test items.  Impacts are BM25 term weights divided by the item's own score
(its text as a query), so one threshold suits all items.  Postings are ordered by item and cut into
blocks of BLOCK; a block that holds a term has an entry with the largest impact there, and no other
block takes space.  A passage whose terms' largest impacts stay below the threshold is skipped.  Else
its terms are ordered by them: up to the pivot, where their sum reaches the threshold, they cannot
retrieve an item alone, so only blocks of the later terms are candidates.  Candidates are bounded by
block maxima, and the postings of those that may reach the threshold are scored exactly.  All items
at or above the threshold are retrieved.  An item of more than PART words is indexed as
overlapping parts of PART words, each divided by its own score: any PART words in a row lie whole
in some passage, so an item's length doesn't matter.  Its best part counts as the item.

Retrieved pairs are verified on the document's whole text: an item's last ANSWER_PART of words is its
answer, the rest its question (its words before the last sentence mark that leaves an answer of at
least three words, where there is one).  A document leaks an item if it holds at least OVERLAP
of the question's and of the answer's five-word shingles; a shingle belongs to the part in which its
last word lies.  An item of fewer than five words is one shingle: it is found in texts of just these words.

The index holds the test items only.  Items go into indexes of at most INDEX_WORDS words (a longer item has one
of its own), so what is broadcast has a bound whatever the size of the benchmark; each index reads
the texts once, and one index holds tens of thousands of usual items.  Rarities and the mean length are those of the
whole benchmark in every index, so scores don't depend on how items are dealt.

Words are runs of letters, digits and non-ASCII characters, A-Z folded; so punctuation, symbols,
case and white space don't hide a leak.  Null or empty texts leak nothing; null or wordless items
are never found.  Rows that repeat an item_id and its text are one item; texts that share an id are one
item each.  Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .toxicity import _INSIDE

PASSAGE, SHINGLE, PAIR, BLOCK = 128, 5, 2, 4
K1, B = 1.2, 0.75
#: Share of the item's own score that retrieves it, and of shingles that verifies it.
THRESHOLD, OVERLAP, ANSWER_PART = 0.4, 0.5, 0.25
#: Words of an item's parts, and from one part's first word to the next one's.
PART, PART_STEP = PASSAGE // 2, PASSAGE // 4
#: Words of items (of all their parts) that one index holds; some 40 bytes a word are broadcast.
INDEX_WORDS = 2_000_000
#: Block entries that a search expands at a time.
ENTRIES_AT_ONCE = 1 << 20


def tokens(data: np.ndarray, at: np.ndarray):
    s, e, first = C.spans_of(_INSIDE[data], at)
    return s, e, first, C.span_hashes(data, s, e, fold_case=True)


def _shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    if not len(h):
        return h
    return C.windows(h if len(h) >= k else np.concatenate((h, np.full(k - len(h), len(h), np.uint64))), k)


def _answer_from(text: bytes, s: np.ndarray, e: np.ndarray) -> int:
    """Index of the first word of the answer."""
    n = len(s)
    cut = max(1, n - max(3, round(n * ANSWER_PART)))
    for i in range(n - 3, n // 2, -1):
        if any(c in text[e[i - 1] : s[i]] for c in b".?!\n"):
            return i
    return min(cut, max(n - 1, 0))


def _parts(h: np.ndarray) -> list[np.ndarray]:
    """The words of an item by overlapping parts."""
    return [h[i : i + PART] for i in [*range(0, len(h) - PART, PART_STEP), max(len(h) - PART, 0)]]


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start[i] .. start[i] + count[i] - 1 for every i, one after the other, and each one's i."""
    of = np.repeat(np.arange(len(count)), count)
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(start, count), of


class Index:
    """BM25 inverted index of the items' parts with the maxima of the blocks that hold a term."""

    def __init__(self, texts: list[str], totals: tuple | None = None):
        """totals: items, mean length of their parts, and terms with how many items hold them, of the whole benchmark; else of these texts."""
        self.item, self.question, self.answer, self.owner, words, whole = [], [], [], [], [], []
        for k, text in enumerate(texts):
            t = text.encode()
            data = np.frombuffer(t, np.uint8)
            s, e, _, h = tokens(data, np.array([0, len(data)]))
            if len(h):
                cut = _answer_from(t, s, e)
                own = [_shingles(part, PAIR) for part in _parts(h)]
                self.owner += [len(self.item)] * len(own)
                self.item.append(k)
                words += own
                whole.append(np.unique(_shingles(h, PAIR)))
                own = _shingles(h)  # a shingle belongs to the part its last word lies in
                cut = min(max(cut - SHINGLE + 1, 1), len(own))
                self.question.append(np.unique(own[:cut]))
                self.answer.append(np.unique(own[cut:]))
        n = len(words)
        self.blocks = max(1, -(-n // BLOCK))
        size = np.array([len(h) for h in words], np.int64)
        cat = lambda x: np.concatenate(x) if n else np.zeros(0, np.uint64)
        self.terms = np.unique(cat(words))
        # a term is as rare as the items that hold it, whatever their parts
        if totals:
            items, mean, known, held = totals
            df = held[np.searchsorted(known, self.terms)]
        else:
            items, mean = len(whole), max(size.mean() if n else 1, 1)
            df = np.bincount(np.searchsorted(self.terms, cat(whole)), minlength=len(self.terms))
        idf = np.log(1 + (items - df + 0.5) / (df + 0.5))
        key, c = np.unique(np.searchsorted(self.terms, cat(words)) * np.int64(max(n, 1)) + np.repeat(np.arange(n), size), return_counts=True)
        term, part = key // max(n, 1), key % max(n, 1)
        impact = idf[term] * c * (K1 + 1) / (c + K1 * (1 - B + B * size[part] / mean))
        impact = (impact / np.bincount(part, impact, minlength=max(n, 1))[part]).astype(np.float32)
        self.post_part, self.post_impact = part.astype(np.int32), impact
        entry = term * np.int64(self.blocks) + part // BLOCK
        first = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1]))) if len(entry) else np.zeros(0, np.int64)
        self.entry, self.entry_max = entry[first], np.maximum.reduceat(impact, first) if len(first) else impact
        self.entry_post = np.concatenate((first, [len(entry)])).astype(np.int32)
        self.entry_first = np.searchsorted(self.entry, np.arange(len(self.terms) + 1) * np.int64(self.blocks))
        self.term_max = np.maximum.reduceat(self.entry_max, self.entry_first[:-1]) if len(self.terms) else impact
        self.hint = np.zeros(1 << 22, bool)
        self.hint[self.terms & np.uint64(len(self.hint) - 1)] = True

    def nbytes(self) -> int:
        return sum(x.nbytes for v in vars(self).values() for x in (v if isinstance(v, list) else [v]) if isinstance(x, np.ndarray))

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that hold a term of the index, and the terms."""
        at = np.flatnonzero(self.hint[h & np.uint64(len(self.hint) - 1)])
        term = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        ok = self.terms[term] == h[at]
        return at[ok], term[ok]

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, part, score) at or above the threshold, for distinct terms by passage (0, 1, ...; ascending)."""
        order = np.lexsort((self.term_max[term], passage))
        passage, term = passage[order], term[order]
        low = np.searchsorted(passage, np.arange(passage[-1] + 2 if len(passage) else 1))
        total = np.concatenate(([0.0], np.cumsum(self.term_max[term], dtype=float)))
        before = total[low[passage]]
        late = total[1:] - before >= THRESHOLD - 1e-6  # from the pivot on
        early = np.bincount(passage[~late], self.term_max[term[~late]], minlength=len(low) - 1)
        pivot = low[:-1] + np.bincount(passage[~late], minlength=len(low) - 1)
        p, t = passage[late], term[late]
        count = self.entry_first[t + 1] - self.entry_first[t]
        cuts = np.concatenate(([0], np.cumsum(count)))
        got: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        i = 0
        while i < len(p):
            j = int(np.searchsorted(cuts, cuts[i] + ENTRIES_AT_ONCE, "right")) - 1
            j = int(np.searchsorted(p, p[min(max(j, i), len(p) - 1)], "left"))  # whole passages
            if j <= i:
                j = int(np.searchsorted(p, p[i], "right"))
            e, of = _ranges(self.entry_first[t[i:j]], count[i:j])
            key, back = np.unique(p[i:j][of] * np.int64(self.blocks) + self.entry[e] % self.blocks, return_inverse=True)
            late_sum = np.bincount(back, self.entry_max[e])
            can = late_sum + early[key // self.blocks] >= THRESHOLD - 1e-6
            got += self._score(key[can], late_sum[can], low, pivot, term)
            i = j
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))

    def _entries(self, own: np.ndarray, block: np.ndarray, term: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries that candidates' blocks have for terms a[passage] to b[passage] - 1, and each one's candidate."""
        place, of = _ranges(a[own], b[own] - a[own])
        want = term[place] * np.int64(self.blocks) + block[of]
        at = np.minimum(np.searchsorted(self.entry, want), len(self.entry) - 1)
        hit = self.entry[at] == want
        return at[hit], of[hit]

    def _score(self, key: np.ndarray, late_sum: np.ndarray, low: np.ndarray, pivot: np.ndarray, term: np.ndarray) -> list:
        """Candidates (passage * blocks + block) bounded by the block maxima before the pivot, too, then scored by postings."""
        out = []
        for i in range(0, len(key), ENTRIES_AT_ONCE // PASSAGE):
            part = key[i : i + ENTRIES_AT_ONCE // PASSAGE]
            own, block = part // self.blocks, part % self.blocks
            at, of = self._entries(own, block, term, low, pivot)
            live = late_sum[i : i + len(part)] + np.bincount(of, self.entry_max[at], minlength=len(own)) >= THRESHOLD - 1e-6
            own, block = own[live], block[live]
            at, of = self._entries(own, block, term, low, low[1:])
            post, which = _ranges(self.entry_post[at], self.entry_post[at + 1] - self.entry_post[at])
            cell = of[which] * np.int64(BLOCK) + self.post_part[post] % BLOCK
            score = np.bincount(cell, self.post_impact[post], minlength=len(own) * BLOCK)
            good = np.flatnonzero(score >= THRESHOLD - 1e-6)
            out.append((own[good // BLOCK], block[good // BLOCK] * BLOCK + good % BLOCK, score[good]))
        return out

    def search(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float]]:
        """(row, item, best score) of all passages of the rows, given as word hashes."""
        if not len(self.terms) or not len(h):
            return []
        n = np.diff(first)
        pairs = np.concatenate((C.windows(h, PAIR), h[:1] * 0))[: len(h)]
        ends = first[1:][n > 0] - 1  # a row's last word starts no pair
        alone = first[:-1][n == 1]
        pairs[ends] = 0
        for r in alone:
            pairs[r] = _shingles(h[r : r + 1], PAIR)[0]
        at, term = self.lookup(pairs)
        if not len(at):
            return []
        # a row's passages are two neighbouring halves each; a short row is one half
        half = PASSAGE // 2
        per = -(-n // half)
        halves = np.concatenate(([0], np.cumsum(per)))
        row = np.searchsorted(first, at, "right") - 1
        own = np.unique((halves[row] + (at - first[row]) // half) * np.int64(len(self.terms)) + term)
        where, term = own // len(self.terms), own % len(self.terms)
        bound = np.bincount(where, weights=self.term_max[term], minlength=halves[-1] + 1)
        starts = np.searchsorted(where, np.arange(halves[-1] + 2))
        row = np.repeat(np.arange(len(n)), per)
        last = halves[row + 1] - 1
        k = np.arange(halves[-1])
        keep = np.flatnonzero(((k < last) | (per[row] == 1)) & (bound[k] + np.where(k < last, bound[k + 1], 0) >= THRESHOLD - 1e-6))
        if not len(keep):
            return []
        place, of = _ranges(starts[keep], starts[np.minimum(keep + 1, last[keep]) + 1] - starts[keep])
        own = np.unique(of * np.int64(len(self.terms)) + term[place])
        passage, part, score = self.retrieve(own // len(self.terms), own % len(self.terms))
        best: dict[tuple[int, int], float] = {}
        for r, p, s in zip(row[keep[passage]].tolist(), part.tolist(), score.tolist(), strict=True):
            key = (r, self.owner[p])
            best[key] = max(best.get(key, 0.0), s)
        return [(r, i, s) for (r, i), s in sorted(best.items())]


def _share(part: np.ndarray, there: np.ndarray) -> float:
    """Of part's shingles those in there (both sorted and distinct)."""
    if not len(part):
        return 1.0
    return float((there[np.minimum(np.searchsorted(there, part), len(there) - 1)] == part).mean())


def _blocks(items: DataFrame) -> Iterator:
    """The distinct items (item_id, text) as Arrow tables of at most INDEX_WORDS words, or of one item, on the driver; and whether all are in this one."""
    count = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    items = items.distinct().withColumn("n", count).where("n > 0")
    size = F.when(F.col("n") > PART, F.col("n") * (PART // PART_STEP)).otherwise(F.col("n"))
    items = items.withColumn("n", F.greatest(size, F.octet_length("text") / 16).cast("long"))
    total = items.agg(F.sum("n")).first()[0] or 0
    hashes = 1 if total <= INDEX_WORDS else -(-2 * total // INDEX_WORDS)
    for k in range(hashes if total else 0):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(hashes)) == k) if hashes > 1 else items
        own = own.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])  # half an index, as hashes are even
        first = held = 0
        for i, n in enumerate(own.column("n").to_pylist()):
            if held and held + n > INDEX_WORDS:  # long items met by hash
                yield own.slice(first, i - first), False
                first, held = i, 0
            held += n
        if len(own) > first:
            yield own.slice(first), hashes == 1 and not first


def _statistics(batches: Iterator) -> Iterator:
    """Each item's distinct terms (index, term), and on a row without a term its parts and their lengths' sum."""
    import pyarrow as pa

    for batch in batches:
        for i, j, data, at in C.chunks(batch.column("text")):
            _, _, first, h = tokens(data, at)
            terms, parts = [], []
            for r in range(j - i):
                own = h[first[r] : first[r + 1]]
                if len(own):
                    terms.append(np.unique(_shingles(own, PAIR)))
                    parts.append([len(_shingles(part, PAIR)) for part in _parts(own)])
            flat = np.concatenate(terms) if terms else np.zeros(0, np.uint64)
            counts = [(len(p), sum(p)) for p in parts]
            columns = [pa.array([*C.signed(flat).tolist(), *[None] * len(counts)], pa.int64()), pa.array([*[None] * len(flat), *(c[0] for c in counts)], pa.int64()), pa.array([*[None] * len(flat), *(c[1] for c in counts)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "parts", "words"])


def _totals(items: DataFrame) -> tuple[int, float, DataFrame]:
    """Items, mean length of their parts, and by term how many items hold it: over the whole benchmark, whatever the indexes."""
    rows = C.saved(items.distinct().mapInArrow(_statistics, "term long, parts long, words long"), "benchmark-terms")
    n = rows.agg(F.count("parts").alias("items"), F.sum("parts").alias("parts"), F.sum("words").alias("words")).first()
    terms = C.saved(rows.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df")), "benchmark-frequencies")
    return n["items"], max(n["words"] / n["parts"], 1), terms


def _held(texts: list[str], terms: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the texts of one index, ascending, and how many items of the benchmark hold them."""
    spark = terms.sparkSession
    import pyarrow as pa

    own = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        h = tokens(data, np.array([0, len(data)]))[3]
        own.append(np.unique(_shingles(h, PAIR)))
    wanted = spark.createDataFrame(pa.table({"term": C.signed(np.unique(np.concatenate(own)))}))  # INDEX_WORDS at most
    got = terms.join(wanted, "term", "left_semi").toArrow()
    term, df = np.array(got.column("term")).view(np.uint64), np.array(got.column("df"))
    order = np.argsort(term)
    return term[order], df[order]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, bm25 (share of the item's own score), question_overlap, answer_overlap for every leak."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    items = items.select("item_id", "text").where(F.col("text").isNotNull())
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, bm25 double, question_overlap double, answer_overlap double"
    out = totals = None
    for own, one in _blocks(items):
        texts = own.column("text").to_pylist()
        if not one:  # rarities are those of the whole benchmark
            totals = totals or _totals(items)
        index = Index(texts, None if one else (*totals[:2], *_held(texts, totals[2])))
        sent = spark.sparkContext.broadcast((index, own.column("item_id").combine_chunks()))  # INDEX_WORDS words at most

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            index, names = sent.value
            for batch in batches:
                ids = batch.column("doc_id")
                got: list[list] = [[], [], [], [], []]
                for i, _, data, at in C.chunks(batch.column("text")):
                    _, _, first, h = tokens(data, at)
                    mine, there = -1, h
                    for r, item, score in index.search(h, first):
                        if r != mine:
                            mine, there = r, np.unique(_shingles(h[first[r] : first[r + 1]]))
                        q, a = _share(index.question[item], there), _share(index.answer[item], there)
                        if q >= OVERLAP and a >= OVERLAP:
                            for x, v in zip(got, (i + r, index.item[item], score, q, a), strict=True):
                                x.append(v)
                columns = [ids.take(pa.array(got[0], pa.int64())), names.take(pa.array(got[1], pa.int64())), *(pa.array(x, pa.float64()) for x in got[2:])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "bm25", "question_overlap", "answer_overlap"])

        with C.small_batches(spark):
            found = C.saved(docs.mapInArrow(run, schema), "leaks")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a test item go."""
    return C.without(docs, leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
