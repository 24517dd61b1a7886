"""Personal data by weak supervision (operator 6), in DataFrame functions only.

Base spans come from the four patterns below, leftmost and non-overlapping by kind, with failing
matches dropped.  Further candidates are loosely mail-like and number-like runs.  Labelers vote on
every candidate: the base patterns, a checksum, gazetteers (top-level domains, calling codes, card
issuers), the words before it and its grouping.  Votes and a candidate's shape have a few values
each, so all candidates of the corpus fold into a bounded table of counts; on it expectation-
maximisation estimates the labelers' reliabilities without labels, and a logistic span classifier is
trained on shapes and votes (all but the base patterns', which know no further span) with the posteriors as soft labels.  Its weights go back into the plan as
literals.  Candidates that it accepts and that touch no base span become spans of kind `other`.

Patterns are the same as given ones but possessive where nothing can be given back, so Java's
matcher neither recurses nor scans a long run once for every start.  Offsets are code points, end
exclusive.  Null and empty texts have no spans.  Every row is judged alone, so repeated ids and
rows don't matter; extra columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone", "other")
#: Marks set around matches; the text's own are replaced by a third character beforehand.
_OPEN, _SHUT, _SPARE = "\ue000", "\ue001", "\ue002"
_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Loose candidates, gazetteers and cue words of the labelers.
CANDIDATES = {
    "mail": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9.-]++",
    "number": "|".join(
        (
            r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,3}(?![0-9])",
            r"(?<![0-9A-Za-z+])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9A-Za-z])",
            r"(?<![0-9A-Za-z+])\+?[0-9](?:(?:[).-]|\)?\x20(?=\(?[0-9]{1,4}(?![0-9])))?\(?[0-9]){7,}+(?![0-9A-Za-z])",
        )
    ),
}
DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu"]
CALLING = ["1", "7", "20", "30", "31", "32", "33", "34", "36", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91"]
ISSUERS = "^(?:4|5[1-5]|2[2-7]|6011|65|3[47]).*"
CUES = "mail|tel|phone|call|mobile|fax|card|visa|credit|iban|account|konto|carte|tarjeta|addr|contact|ssn|ip[: ]"
COUNTER_CUES = r"order|invoice|isbn|issn|version|page|item|sku|price|total|[$€#]\s?$"
#: Characters before a candidate that the context labeler reads.
CONTEXT = 24
#: P(no opinion, against, for) that labelers are expected to have by class, and the weight of that.
EXPECTED, BELIEF = ((0.55, 0.35, 0.1), (0.45, 0.1, 0.45)), 0.2
VOTES = ("pattern", "checksum", "gazetteer", "context", "grouping")
#: What the span classifier sees: a candidate's shape, and the votes but for that of the base patterns.
SHAPES = ("mail", "plus", "parens", "dots", "spaced", "d8", "d10", "d13", "d16", "d20", "glued")

OPINIONS = [(f"v_{k}", vote) for k in VOTES[1:] for vote in (1, 2)]

_SPAN = "array<struct<s:int,e:int,x:string>>"


def plain(text: Column) -> Column:
    """The text with its own mark characters, if it has any, replaced one for one."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains(_OPEN) | text.contains(_SHUT), F.translate(text, _OPEN + _SHUT, _SPARE * 2)).otherwise(text)


def matches(text: Column, pattern: str, hint: Column) -> Column:
    """Array of (s, e, x) of the pattern's matches; empty where the hint is false."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}$0{_SHUT}")), f"[{_OPEN}{_SHUT}]")
    none = F.array().cast(_SPAN)

    def step(acc, x):
        end = acc["at"] + F.length(x)
        span = F.struct(acc["at"].alias("s"), end.alias("e"), x.alias("x"))
        out = F.when(acc["inside"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("out"))
    return F.when(hint, F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(none)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    def add(acc, i):
        v = F.substring(d, F.length(d) + 1 - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, 2 * v - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def base_spans(t: Column) -> dict[str, Column]:
    """By kind the spans of the base patterns in a plain text."""
    digit = t.rlike("[0-9]")
    found = {
        "email": matches(t, PATTERNS["email"], t.contains("@")),
        "ip": matches(t, PATTERNS["ip"], t.rlike(r"[0-9]\.[0-9]")),
        "card": matches(t, PATTERNS["card"], digit),
        "phone": matches(t, PATTERNS["phone"], t.contains("+")),
    }
    keep = {
        "ip": lambda m: m["x"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": lambda m: F.when(_between(F.length(digits(m["x"])), 16, 19), luhn(digits(m["x"]))).otherwise(False),
        "phone": lambda m: _between(F.length(digits(m["x"])), 8, 15),
    }
    return {k: F.filter(v, keep[k]) if k in keep else v for k, v in found.items()}


def _candidates(t: Column) -> Column:
    """Array of (s, e, x, mail, before) of loose candidates in a plain text."""

    def more(mail: bool):
        def one(m):
            before = F.lower(F.substring(t, F.greatest(m["s"] - CONTEXT, F.lit(0)) + 1, F.least(m["s"], F.lit(CONTEXT))))
            return F.struct(m["s"].alias("s"), m["e"].alias("e"), m["x"].alias("x"), F.lit(mail).alias("mail"), before.alias("before"))

        return one

    mails = matches(t, CANDIDATES["mail"], t.contains("@") | t.contains("[at]") | t.contains("(at)"))
    return F.concat(F.transform(mails, more(True)), F.transform(matches(t, CANDIDATES["number"], t.rlike("[0-9]")), more(False)))


def _touches(m: Column, base: Column) -> Column:
    return F.exists(base, lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"]))


def _vote(yes: Column, no: Column | None = None) -> Column:
    """2 for, 1 against, 0 no opinion."""
    out = F.when(yes, 2)
    return (out if no is None else out.when(no, 1)).otherwise(0)


def judged(m: Column, base: Column) -> Column:
    """Struct of a candidate's place, votes and shape."""
    x, d = m["x"], digits(m["x"])
    n, mail = F.length(d), m["mail"]
    card = ~mail & _between(n, 16, 19)
    calling = F.regexp_extract(x, r"^\+([0-9]{1,3})", 1)
    known_code = F.lit(False)
    for c in CALLING:
        known_code = known_code | calling.startswith(c)
    domain = F.lower(F.regexp_extract(x, r"\.([A-Za-z]+)\.?$", 1))
    votes = {
        "pattern": _vote(_touches(m, base)),
        "checksum": _vote(F.when(card, luhn(d)).otherwise(False), card),
        "gazetteer": _vote(
            F.when(mail, domain.isin(DOMAINS)).otherwise((x.startswith("+") & (calling != "") & known_code) | (card & d.rlike(ISSUERS))), mail | card
        ),
        "context": _vote(m["before"].rlike(CUES), m["before"].rlike(COUNTER_CUES)),
        "grouping": _vote(
            F.when(mail, x.contains("@")).otherwise(x.rlike(r"^\+?[0-9(]{1,4}(?:[\x20().-]{1,2}[0-9]{2,4}){2,6}$")), ~mail & x.rlike("^[0-9]+$") & ~card
        ),
    }
    shape = {
        "mail": mail,
        "plus": x.startswith("+"),
        "parens": x.contains("("),
        "dots": ~mail & x.contains("."),
        "spaced": ~mail & x.rlike(r"[\x20-]"),
        "d8": ~mail & (n < 10),
        "d10": ~mail & _between(n, 10, 12),
        "d13": ~mail & _between(n, 13, 15),
        "d16": card,
        "d20": ~mail & (n > 19),
        "glued": m["before"].rlike("[a-z0-9=_/-]$"),
    }
    return F.struct(
        m["s"].alias("s"), m["e"].alias("e"), *[votes[k].cast("tinyint").alias(f"v_{k}") for k in VOTES], *[F.coalesce(shape[k], F.lit(False)).alias(f"f_{k}") for k in SHAPES]
    )


def _steps(docs: DataFrame, keep: Column) -> DataFrame:
    """keep (as `row`), base spans by kind (as a struct `base`) and together (`all`), and candidates (`found`) of docs' texts."""
    docs = docs.select(keep.alias("row"), plain(F.col("text")).alias("t"))
    docs = docs.select("row", "t", F.struct(*[v.alias(k) for k, v in base_spans(F.col("t")).items()]).alias("base"), _candidates(F.col("t")).alias("found"))
    return docs.select("row", "base", F.concat(*[F.col(f"base.{k}") for k in KINDS[:4]]).alias("all"), "found")


def reliabilities(table: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list, list[float]]:
    """Expectation-maximisation over (votes, count): the prior, P(vote | class) by labeler, the posteriors.

    Starts from the majority of votes.  Counts are smoothed towards labelers that are right more often
    than not (BELIEF of all rows), so that the classes keep their meaning.
    """
    post = [0.5 if (s := sum((v == 2) - (v == 1) for v in votes)) == 0 else 0.9 if s > 0 else 0.1 for votes, _ in table]
    total = sum(n for _, n in table)
    prior, odds = 0.5, []
    for _ in range(rounds):
        prior = (sum(p * n for p, (_, n) in zip(post, table, strict=True)) + 1) / (total + 2)
        odds = []
        for j in range(len(VOTES)):
            counts = [[(1 + BELIEF * total) * p for p in row] for row in EXPECTED]
            for p, (votes, n) in zip(post, table, strict=True):
                counts[1][votes[j]] += p * n
                counts[0][votes[j]] += (1 - p) * n
            odds.append([[c / sum(row) for c in row] for row in counts])
        post = []
        for votes, _ in table:
            x = math.log(prior / (1 - prior)) + sum(math.log(odds[j][1][v] / odds[j][0][v]) for j, v in enumerate(votes))
            post.append(1 / (1 + math.exp(-max(-40.0, min(40.0, x)))))
    return prior, odds, post


def span_classifier(rows: list[tuple[tuple[bool, ...], int, float]], rounds: int = 600, rate: float = 1.0) -> tuple[float, list[float]]:
    """Bias and weights of a logistic model of features, from (features, count, posterior)."""
    size = len(rows[0][0])
    bias, weights, total = 0.0, [0.0] * size, sum(n for _, n, _ in rows)
    for _ in range(rounds):
        gb, gw = 0.0, [1e-4 * w for w in weights]
        for f, n, p in rows:
            d = (1 / (1 + math.exp(-(bias + sum(w for w, on in zip(weights, f, strict=True) if on)))) - p) * n / total
            gb += d
            for j, on in enumerate(f):
                gw[j] += d * on
        bias -= rate * gb
        weights = [w - rate * g for w, g in zip(weights, gw, strict=True)]
    return bias, weights


def fit(docs: DataFrame) -> tuple[float, list[float]] | None:
    """The span classifier trained on all candidates of docs, or None if there are none."""
    names = [f"v_{k}" for k in VOTES] + [f"f_{k}" for k in SHAPES]
    each = _steps(docs.select("text"), F.lit(0))
    # outer: the filter that an inner explode implies would find all candidates a second time
    each = each.select("all", F.explode_outer("found").alias("m")).where(F.col("m").isNotNull())
    each = each.select(judged(F.col("m"), F.col("all")).alias("j")).select("j.*")
    rows = sorted(each.groupBy(names).count().collect())  # at most 3**5 votes by the few shapes there are
    if not rows:
        return None
    _, _, post = reliabilities([(tuple(int(r[f"v_{k}"]) for k in VOTES), r["count"]) for r in rows])
    features = [tuple(bool(r[f"f_{k}"]) for k in SHAPES) + tuple(r[v] == vote for v, vote in OPINIONS) for r in rows]
    return span_classifier([(f, r["count"], p) for f, r, p in zip(features, rows, post, strict=True)])


def _found(docs: DataFrame, keep: Column) -> DataFrame:
    """keep (as `row`), spans: array of (kind, s, e), by kind as listed, then start."""
    model = fit(docs)
    out = _steps(docs, keep)

    def tagged(kind: str, column) -> Column:
        return F.transform(column, lambda m: F.struct(F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e")))

    base = [tagged(k, F.col(f"base.{k}")) for k in KINDS[:4]]
    if model is None:
        other = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    else:
        bias, weights = model

        def accepted(m):
            score = F.lit(bias)
            on = [m[f"f_{k}"] for k in SHAPES] + [m[v] == vote for v, vote in OPINIONS]
            for x, w in zip(on, weights, strict=True):
                score = score + F.when(x, w).otherwise(0.0)
            return (score > 0) & (m["v_pattern"] == 0)

        found = F.transform("found", lambda m: judged(m, F.col("all")))
        other = F.array_sort(tagged("other", F.filter(found, accepted)))
    return out.select("row", F.concat(*base, other).alias("spans"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, s, e), by kind as listed, then start."""
    return _found(docs.select("doc_id", "text"), F.col("doc_id")).select(F.col("row").alias("doc_id"), "spans")


def _written(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda m: F.concat_ws(":", m["kind"], m["s"].cast("string"), m["e"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = spans(C.documents(spark, sf_dir).select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [count(k) for k in KINDS[:4]]
    base = F.filter("spans", lambda m: m["kind"] != "other")
    return found.select("doc_id", *n, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    ordered = F.array_sort(F.transform(found, lambda m: F.struct(m["s"].alias("s"), (-m["e"]).alias("e"), m["kind"].alias("kind"))))

    def step(acc, m):
        end = -m["e"]
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["s"] - acc["at"]), F.lit("<"), F.upper(m["kind"]), F.lit(">"))
        fresh = m["s"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(fresh, put).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; spans in their texts give way to their kind, and n_chars follows."""
    found = _found(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)))  # one struct, so that no name of theirs is in the way
    none, text = F.size("spans") == 0, F.col("row")["text"]
    out = found.select("row", none.alias("none"), F.when(text.isNull() | none, text).otherwise(redacted(text, F.col("spans"))).alias("text"))
    columns = []
    for field in docs.schema.fields:
        own = F.col("row")[field.name]
        if field.name == "text":
            own = F.col("text")
        elif field.name == "n_chars":
            own = F.when(F.col("none"), own).otherwise(F.length("text").cast(field.dataType))
        columns.append(own.alias(field.name))
    return out.select(*columns)
