"""Merkle dataset manifest (operator 13): slot pivot.

Leaves of a group are numbered in order. At each level conditional aggregates spread the eight
children of a parent into eight slot columns; the slots concatenated give the parent's digest,
the slots without one's own give the siblings. Proofs come from walking the written levels down
again, parent to child, so each join key meets at most one parent and eight children at every
level, however large a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitree.llm.shared import materialize, numbered

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row: each value as its byte count, a colon and itself, a null as a minus sign."""
    texts = [f.cast("string") for f in fields]
    return sha(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def _height(most: int) -> int:
    levels = 0
    while most > 1:
        most, levels = -(-most // FANOUT), levels + 1
    return levels


def _slots() -> list[str]:
    return [f"s{j}" for j in range(FANOUT)]


def fold_up(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(levels, tops) of nodes (g, cnt, idx, h): each level holds the parents (g, cnt, p) with their
    children's slots, written to the shared folder; tops are (g, h), one a group. cnt is the number of
    children's peers in the group: where it is 1, the lone node is carried on unchanged."""
    levels = []
    for _ in range(_height(nodes.agg(F.max("cnt")).first()[0] or 0)):
        slot = F.col("idx") % FANOUT
        spread = nodes.groupBy("g", "cnt", F.expr(f"idx div {FANOUT}").alias("p")).agg(*(F.max(F.when(slot == j, F.col("h"))).alias(s) for j, s in enumerate(_slots())))
        levels.append(materialize(spread, "level"))
        digest = F.when(F.col("cnt") == 1, F.col("s0")).otherwise(sha(F.concat_ws("", *_slots())))
        nodes = levels[-1].select("g", F.expr(f"(cnt + {FANOUT - 1}) div {FANOUT}").alias("cnt"), F.col("p").alias("idx"), digest.alias("h"))
    return levels, nodes.select("g", "h")


def walk_down(levels: list[DataFrame], tops: DataFrame, keep: list[str]) -> DataFrame:
    """Proof paths of all leaves: tops (g, path, *keep) become (g, idx, path, *keep). A path lists, from
    the leaf up, the digests left and right of the node among its run; a lone node adds no step."""
    at = tops.withColumn("p", F.lit(0).cast("long"))
    for level in reversed(levels):
        met = level.join(at, ["g", "p"])
        names = _slots()
        left = lambda j: F.concat_ws("", F.lit(""), *names[:j])
        right = lambda j: F.concat_ws("", F.lit(""), *names[j + 1 :])
        each = F.array(*(F.when(F.col(s).isNotNull(), F.struct(F.lit(j).cast("long").alias("slot"), left(j).alias("l"), right(j).alias("r"))) for j, s in enumerate(names)))
        child = met.select("g", "p", "cnt", "path", *keep, F.explode(F.array_compact(each)).alias("c"))
        step = F.when(F.col("cnt") == 1, F.col("path")).otherwise(F.concat(F.array(F.struct("c.l", "c.r")), F.col("path")))
        at = child.select("g", (F.col("p") * FANOUT + F.col("c.slot")).alias("p"), step.alias("path"), *keep)
    return at.withColumnRenamed("p", "idx")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each document.

    Documents of a language, in order of (doc_id, leaf), null ids first, make its tree; the trees'
    roots, null language first, make the root. proof_sha256 digests the siblings from leaf to root.
    For the check of the proofs, where 3 divides the CRC-32 of the decimal doc_id the text's A-Z are
    lower-cased; folded_root folds that leaf with the original siblings (a null id is never tampered
    with, a text without A-Z folds to the root). Repeated rows are leaves of their own. Nulls, empty
    and long texts only change the leaf; an empty table gives no rows. Columns other than
    ``FIELDS`` are ignored. Row work is of constant size but for the path, which has one entry
    of at most seven digests for each of the log8(n) levels."""
    spark = docs.sparkSession
    lowered = F.translate("text", _UPPER, _LOWER)
    fields = [F.col(c) for c in FIELDS]
    leaf, changed = leaf_digest(fields), leaf_digest([*fields[:-1], lowered])
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("g"), leaf.alias("h"), F.when(tamper, changed).alias("changed"))
    leaves = materialize(numbered(rows, ["doc_id", "h"]), "leaves")
    levels, subroots = fold_up(leaves)
    trees = materialize(numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("tree"), "h"), ["tree"]), "subroots")
    top_levels, top = fold_up(trees)
    root = (top.first() or {"h": None})["h"]
    steps = spark.range(1).select(F.lit("").alias("g"), F.array().cast("array<struct<l:string,r:string>>").alias("path"))
    tops = walk_down(top_levels, steps, []).join(trees.select("idx", "tree", "h"), "idx")
    paths = walk_down(levels, tops.select(F.col("tree").alias("g"), "path", F.col("h").alias("subroot")), ["subroot"])
    proof = sha(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""))
    folded = F.aggregate("path", F.coalesce("changed", "h"), lambda acc, s: sha(F.concat(s["l"], acc, s["r"])))
    proved = leaves.join(paths, ["g", "idx"]).select("doc_id", F.col("h").alias("leaf"), "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC32_SQL = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda r, b: xor(r >> 8, list_reduce(list_prepend(xor(r, b) & 255, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)))"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    return f"xor({_CRC32_SQL.format(text)}, CAST(4294967295 AS BIGINT))"


def _tree_sql(name: str, levels: int) -> str:
    """CTEs that fold name_0 (g, idx, cnt, h) up; name_{levels} holds the tops."""
    steps = []
    for k in range(1, levels + 1):
        steps.append(
            f"{name}_{k} AS (SELECT g, idx // 8 AS idx, (MIN(cnt) + 7) // 8 AS cnt, CASE WHEN MIN(cnt) = 1 THEN MIN(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM {name}_{k - 1} GROUP BY g, idx // 8)"
        )
        steps.append(
            f"{name}_s{k} AS (SELECT a.g, a.idx, COALESCE(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, COALESCE(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r, MIN(a.cnt) AS cnt FROM {name}_{k - 1} a JOIN {name}_{k - 1} b ON a.g = b.g AND a.idx // 8 = b.idx // 8 GROUP BY a.g, a.idx)"
        )
    return ",\n".join(steps)


def manifest_sql(levels: int = 6, tree_levels: int = 2) -> str:
    """The same in SQL, for up to 8**levels documents a language and 8**tree_levels languages."""
    leaf = lambda text: "sha256(" + " || ".join(f"COALESCE(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in [*FIELDS[:-1], text]) + ")"
    joins, names = [], []
    for k in range(1, levels + 1):
        joins.append(f"JOIN doc_s{k} d{k} ON d{k}.g = x.g AND d{k}.idx = x.idx // {8 ** (k - 1)}")
        names.append(f"d{k}")
    for k in range(1, tree_levels + 1):
        joins.append(f"JOIN lang_s{k} t{k} ON t{k}.idx = y.idx // {8 ** (k - 1)}")
        names.append(f"t{k}")
    acc = "COALESCE(x.changed, x.h)"
    proof = " || ".join(f"CASE WHEN {n}.cnt = 1 THEN '' ELSE {n}.l || {n}.r END" for n in names)
    steps = "[" + ", ".join(f"{{'c': {n}.cnt, 'l': {n}.l, 'r': {n}.r}}" for n in names) + "]"
    folded = f"list_reduce(list_prepend({{'c': 0, 'l': '', 'r': {acc}}}, {steps}), lambda a, s: {{'c': 0, 'l': '', 'r': CASE WHEN s.c = 1 THEN a.r ELSE sha256(s.l || a.r || s.r) END}}).r"
    lowered = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return f"""
WITH raw AS (SELECT doc_id, COALESCE('=' || lang, '') AS g, {leaf('text')} AS h, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(lowered)} END AS changed FROM documents),
doc_0 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, COUNT(*) OVER (PARTITION BY g) AS cnt FROM raw),
{_tree_sql('doc', levels)},
lang_0 AS (SELECT '' AS g, g AS tree, h, ROW_NUMBER() OVER (ORDER BY encode(g)) - 1 AS idx, COUNT(*) OVER () AS cnt FROM doc_{levels}),
{_tree_sql('lang', tree_levels)},
out AS (SELECT x.doc_id, x.h AS leaf, y.h AS subroot, z.h AS root, sha256({proof}) AS proof_sha256, {folded} AS folded_root
        FROM doc_0 x JOIN lang_0 y ON y.tree = x.g CROSS JOIN lang_{tree_levels} z {' '.join(joins)})
SELECT *, folded_root = root AS verified FROM out
"""
