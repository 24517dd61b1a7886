"""Merkle dataset manifest by butterfly exchange (operator 13).

Every row is a leaf: the SHA-256 of its fields, each with its length, so no two rows read alike.  Leaves of a language
ascend by doc_id; runs of FANOUT nodes become their hash, level by level, up to the language's root, and the languages'
roots, in order of their names, become the dataset's root in the same way.

1. Rows are put in order by ranges once and written; a row's place in its language follows from counts of the
   ranges, so no language comes together in a task.
2. BLOCK = FANOUT**HEIGHT neighbouring leaves form a partition, which hashes its own subtree.
3. Butterfly: in round r the partitions that differ in digit r of their number only, FANOUT of them, swap the
   roots of their subtrees.  Each hashes the parent itself, so after the last round every partition has the
   root and, from what it was sent, its siblings on all levels above: no pass leads down again.  A
   language has virtual partitions up to the next power of FANOUT, which hold no leaves and take part in the exchange, so
   groups are always aligned and no partition answers more than FANOUT - 1 others.
4. Between languages the same goes on with groups of FANOUT subtrees of languages; one row a subtree is sent to all.
5. A second read of the leaves hashes the subtree of each partition again and yields every leaf's proof.

Nulls are `-` in a leaf; a null language is one of its own and comes first.  A null doc_id comes before all others and is never tampered with.
Rows that repeat a doc_id are leaves of their own, in order of their hashes.  Texts are hashed where they are read, of any
length.  An empty table has no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

FANOUT, HEIGHT = 2, 12
#: Languages up to which the roots of one round are broadcast (a hundred bytes each); more are joined by shuffle.
BROADCAST_LANGS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 over the fields in order: `-` for null, else byte count, `:` and the value."""
    parts = []
    for c in fields.values():
        c = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _joined(run: Column) -> Column:
    return F.sha2(F.concat_ws("", run).cast("binary"), 256)


def ordered(docs: DataFrame) -> DataFrame:
    """key (the language, null first), doc_id, leaf, changed (the tampered leaf, null if none), at (range and place in it), written once."""
    fields = {c: F.col(c) for c in FIELDS}
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    rows = docs.select(
        F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash(fields).alias("leaf"),
        F.when(hit, leaf_hash(fields | {"n_chars": F.col("n_chars") + 1})).alias("changed"),
        F.monotonically_increasing_id().alias("own"),  # parts rows of equal leaves
    )
    order = ["key", F.col("doc_id").asc_nulls_first(), "leaf", "own"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return C.saved(rows.select("key", "doc_id", "leaf", "changed", F.monotonically_increasing_id().alias("at")), "leaves")


def placed(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Leaves with lang_no, n (leaves of the language), pos and block; and the languages (lang_no, n).

    One row a range and language meets in windows here, and one a range in a single task.
    """
    rows = rows.withColumn("p", F.shiftright("at", 33)).withColumn("k", F.col("at").bitwiseAND((1 << 33) - 1))
    edges = C.saved(rows.groupBy("p", "key").agg(F.count("*").alias("rows"), F.min("k").alias("k0")), "edges")
    langs = edges.groupBy("key").agg(F.min("p").alias("p"), F.sum("rows").alias("n"))
    starts = langs.groupBy("p").agg(F.count("*").alias("c"))
    starts = starts.select(F.col("p").alias("q"), (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("before"))
    langs = langs.join(starts, F.col("p") == F.col("q")).select(
        "key", "n", (F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("key")) - 1).cast("long").alias("lang_no")
    )
    langs = C.saved(langs, "languages")
    so_far = F.sum("rows").over(Window.partitionBy("key").orderBy("p"))
    edges = edges.withColumn("first", so_far - F.col("rows") - F.col("k0")).join(langs, "key").select("p", "key", "first", "n", "lang_no")
    rows = rows.join(edges, ["p", "key"]).withColumn("pos", F.col("first") + F.col("k"))
    rows = rows.withColumn("block", F.floor(F.col("pos") / block).cast("long"))
    return C.saved(rows.select("lang_no", "n", "block", "pos", "doc_id", "leaf", "changed"), "placed"), langs.select("lang_no", "n")


def _h(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def subtree(leaves: list[str], n: int, height: int, fanout: int) -> list[list[str]]:
    """Levels of a partition's own tree, leaves first: `height`, or fewer if the language's n leaves have a root before."""
    levels, width = [leaves], 1
    while width < n and len(levels) <= height:
        below = levels[-1]
        levels.append([_h(below[i : i + fanout]) for i in range(0, len(below), fanout)])
        width *= fanout
    return levels


def _root(key, table, height: int, fanout: int):
    import pyarrow as pa

    table = table.sort_by("pos")
    top = subtree(table.column("leaf").to_pylist(), table.column("n")[0].as_py(), height, fanout)[-1][0]
    return pa.table({"lang_no": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "root": [top]})


def _proofs(key, leaves, upper, height: int, fanout: int):
    import pyarrow as pa

    leaves, upper = leaves.sort_by("pos"), upper.to_pylist()[0]
    own = leaves.column("leaf").to_pylist()
    levels = subtree(own, leaves.column("n")[0].as_py(), height, fanout)
    above = [(p["before"], p["after"]) for p in upper["path"]]
    proofs, folded = [], []
    for i, (leaf, changed) in enumerate(zip(own, leaves.column("changed").to_pylist(), strict=True)):
        path, at = [], i
        for level in levels[:-1]:
            first = at - at % fanout
            path.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
            at //= fanout
        path += above
        proofs.append(_h([before + after for before, after in path]))
        node = leaf if changed is None else changed
        for before, after in path:
            node = _h([before, node, after])
        folded.append(node)
    k = len(own)
    return pa.table({
        "doc_id": leaves.column("doc_id"), "leaf": leaves.column("leaf"), "subroot": [upper["subroot"]] * k, "root": [upper["root"]] * k,
        "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": [x == upper["root"] for x in folded],
    })


def _swapped(state: DataFrame, run: Column, digit: Column, active: Column) -> DataFrame:
    """Partitions after a round: run has (digit, root) of the group's subtrees in order; roots of virtual ones are null."""
    state = state.withColumn("run", F.filter(run, lambda x: x["root"].isNotNull())).withColumn("digit", digit)
    side = lambda keep: F.concat_ws("", F.transform(F.filter("run", keep), lambda x: x["root"]))
    sent = F.struct(side(lambda x: x["digit"] < F.col("digit")).alias("before"), side(lambda x: x["digit"] > F.col("digit")).alias("after"))
    return (
        state.withColumn("path", F.when(active, F.concat("path", F.array(sent))).otherwise(F.col("path")))
        .withColumn("root", F.when(active, F.when(F.size("run") > 0, _joined(F.transform("run", lambda x: x["root"])))).otherwise(F.col("root")))
        .drop("run", "digit")
    )


def butterfly(roots: DataFrame, langs: DataFrame, block: int, fanout: int) -> DataFrame:
    """lang_no, part, subroot, root, path (before, after: siblings of a level) of every partition, from the roots of their own subtrees.

    roots: lang_no, part, root; langs: lang_no, n.
    """
    parts = F.ceil(F.col("n") / block).cast("long")
    width = F.expr(" + ".join(["1L"] + [f"CASE WHEN parts > {fanout**k}L THEN {fanout ** (k + 1) - fanout**k}L ELSE 0L END" for k in range(62 // fanout.bit_length())]))
    state = langs.withColumn("parts", parts).withColumn("width", width).select("lang_no", "parts", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("part"))
    state = state.join(roots, ["lang_no", "part"], "left").withColumn("path", F.expr("CAST(array() AS array<struct<before:string,after:string>>)"))
    state = C.saved(state, "round")
    most = state.agg(F.max("width").alias("w"), F.max("lang_no").alias("l")).first()
    step = 1
    while step < (most["w"] or 0):
        digit = F.floor(F.col("part") / step) % fanout
        group = Window.partitionBy("lang_no", F.col("part") - digit * step)
        run = F.array_sort(F.collect_list(F.struct(digit.alias("digit"), F.col("root").alias("root"))).over(group))
        state = C.saved(_swapped(state, run, digit, F.col("width") > step), "round")
        step *= fanout
    state = state.where("part < parts").withColumn("subroot", F.col("root"))
    step, count = 1, (most["l"] or 0) + 1
    while step < count:
        own = F.floor(F.col("lang_no") / step)
        sent = state.where((F.col("part") == 0) & (F.col("lang_no") % step == 0)).select(own.alias("subtree"), "root")
        sent = sent.groupBy(F.floor(F.col("subtree") / fanout).alias("grp")).agg(F.array_sort(F.collect_list(F.struct((F.col("subtree") % fanout).alias("digit"), F.col("root").alias("root")))).alias("sent"))
        sent = F.broadcast(sent) if count <= BROADCAST_LANGS else sent
        state = state.withColumn("grp", F.floor(own / fanout)).join(sent, "grp")
        state = C.saved(_swapped(state, F.col("sent"), own % fanout, F.lit(True)).drop("sent", "grp"), "round")
        step *= fanout
    return state.select("lang_no", F.col("part").alias("block"), "subroot", "root", "path")


def manifest(docs: DataFrame, height: int = HEIGHT, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs."""
    leaves, langs = placed(ordered(docs), fanout**height)
    groups = leaves.groupBy("lang_no", "block")
    roots = groups.applyInArrow(lambda key, table: _root(key, table, height, fanout), "lang_no long, part long, root string")
    upper = butterfly(roots, langs, fanout**height, fanout)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return groups.cogroup(upper.groupBy("lang_no", "block")).applyInArrow(lambda key, own, above: _proofs(key, own, above, height, fanout), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return manifest(C.documents(spark, sf_dir))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_CHANGED = "sha256(" + " || ".join(_FIELD.format("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS) + ")"
#: crc32 of the decimal doc_id, byte by byte; the table of the polynomial comes from a rule.
CRC_TABLE = """crc_bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bits WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS tb FROM crc_bits WHERE k = 8)"""


def crc32_sql(byte_list: str, table: str = "tb") -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte_list}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE}, d AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, {_LEAF} AS leaf,
    CASE WHEN {crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)")} % 7 = 0 AND n_chars IS NOT NULL THEN {_CHANGED} ELSE {_LEAF} END AS tampered
  FROM documents, crc_table
), lv(lang, lev, pos, n, h) AS (
  SELECT lang, 0, pos, n, leaf FROM d
  UNION ALL
  SELECT lang, lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY lang, lev, pos // 2, n
), sr AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1
), up(lev, pos, n, h) AS (
  SELECT 0, pos, n, h FROM sr
  UNION ALL
  SELECT lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lev, pos // 2, n
), sib AS (
  SELECT lang, 0 AS tree, lev, pos, n, h FROM lv UNION ALL SELECT NULL, 1, lev, pos, n, h FROM up
), fold(doc_id, lang, tree, lev, pos, n, acc, proof) AS (
  SELECT doc_id, lang, 0, 0, pos, n, tampered, '' FROM d
  UNION ALL
  SELECT f.doc_id, f.lang, CASE WHEN f.n > 1 THEN f.tree ELSE 1 END, CASE WHEN f.n > 1 THEN f.lev + 1 ELSE 0 END,
    CASE WHEN f.n > 1 THEN f.pos // 2 ELSE r.pos END, CASE WHEN f.n > 1 THEN (f.n + 1) // 2 ELSE r.n END,
    CASE WHEN f.n = 1 THEN f.acc WHEN f.pos % 2 = 0 THEN sha256(f.acc || coalesce(s.h, '')) ELSE sha256(s.h || f.acc) END,
    CASE WHEN f.n > 1 THEN f.proof || coalesce(s.h, '') ELSE f.proof END
  FROM fold f LEFT JOIN sib s ON s.tree = f.tree AND s.lev = f.lev AND s.pos = xor(f.pos, 1) AND (f.tree = 1 OR s.lang IS NOT DISTINCT FROM f.lang)
    LEFT JOIN sr r ON r.lang IS NOT DISTINCT FROM f.lang
  WHERE f.n > 1 OR f.tree = 0
)
SELECT d.doc_id, d.leaf, r.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = t.h AS verified
FROM d JOIN sr r ON r.lang IS NOT DISTINCT FROM d.lang JOIN fold f ON f.doc_id = d.doc_id AND f.tree = 1 AND f.n = 1 CROSS JOIN (SELECT h FROM up WHERE n = 1) t
"""
