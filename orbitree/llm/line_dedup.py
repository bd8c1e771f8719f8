"""Line dedup (operator 1): repeated runs of lines, by suffix ranks from prefix doubling.

The corpus is one sequence of line ids, ordered by document id and line number; no run leaves
its document. A suffix starts at each line. Prefix doubling ranks the suffixes by their first
1, 2, 4, ... lines: the rank for 2k lines refines the rank for k by the rank of the suffix k
lines on. Equal ranks at depth k are an LCP interval of the suffix array with a common prefix
of at least k lines. A suffix whose rank is its own has no repeat of that length and leaves,
so the rounds run on repeated lines alone.

A repeated run of any length with at least ``min_chars`` characters loses its later copies whole.
Only its least blocks need a look: from each line the shortest block forward, and to each line the
shortest block backward, that holds ``min_chars``. Each line of such a run lies in a least block
inside the run, a copy of a least block is one too, and a least block that repeats is such a run
itself, so the later copies of least blocks cover just the lines that go. Two blocks of m lines,
k <= m < 2k, are equal if they have equal ranks at depth k at their first line and k lines before
their end. The rounds end when no least block is longer.

Ranks keep the order of the suffixes: a group's rank is its parent's rank plus the suffixes of
smaller groups under the same parent. Only one row per repeated group takes part in that sum,
which runs within slices (of the id space, or of the ranks that follow a line) and then over the
slices, so neither the table nor the followers of a blank line meet in one window.

A text is a row with an array of its lines, so a task needs memory in proportion to its longest
text; texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from orbitree.llm.shared import digest_of, has_repeats, materialize, row_keys

MIN_CHARS = 200
_SPACE = " \t\n\x0b\x0c\r"
#: Hex digits of a line id that name its slice for the first ranks.
_SLICE = 3
#: Ranks of the following line that share a slice, for ranks of two lines.
_NEXT_SLICE = 1 << 16


def _ranked(suffixes: DataFrame) -> DataFrame:
    """Ranks at depth 1; lines that occur once leave."""
    groups = materialize(suffixes.groupBy("line_id").agg(F.count("*").alias("n")).where("n > 1"), "lines").withColumn("slice", F.substring("line_id", 1, _SLICE))
    slices = groups.groupBy("slice").agg(F.sum("n").alias("n")).withColumn("base", _before(Window.orderBy("slice")))
    inside = _before(Window.partitionBy("slice").orderBy("line_id"))
    ranks = groups.withColumn("inside", inside).join(slices.select("slice", "base"), "slice").select("line_id", (F.col("base") + F.col("inside")).alias("rank"))
    return suffixes.join(ranks, "line_id").select("doc_id", "line", "chars", "rank")


def _doubled(suffixes: DataFrame, k: int) -> DataFrame:
    """Ranks at depth 2k from ranks at depth k."""
    ahead = suffixes.select("doc_id", (F.col("line") - k).alias("line"), F.col("chars").alias("chars_"), F.col("rank").alias("next"))
    pairs = materialize(suffixes.join(ahead, ["doc_id", "line"]).select("doc_id", "line", (F.col("chars") + F.col("chars_")).alias("chars"), "rank", "next"), "pairs")
    groups = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.withColumn("slice", F.floor(F.col("next") / F.lit(_NEXT_SLICE))), "groups")
    sliced = groups.groupBy("rank", "slice").agg(F.sum("n").alias("n"))
    sliced = sliced.withColumn("base", _before(Window.partitionBy("rank").orderBy("slice"))).select("rank", "slice", "base")
    inside = groups.withColumn("inside", _before(Window.partitionBy("rank", "slice").orderBy("next")))
    ranks = inside.join(sliced, ["rank", "slice"]).select("rank", "next", (F.col("rank") + F.col("base") + F.col("inside")).alias("refined"))
    return pairs.join(ranks, ["rank", "next"]).select("doc_id", "line", "chars", F.col("refined").alias("rank"))


def _before(order: WindowSpec) -> Column:
    """The sum of n over the rows before."""
    return F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _least_blocks(suffixes: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, start, m): least blocks of repeated lines that hold ``min_chars``."""
    if min_chars < 1:
        return suffixes.select("doc_id", F.col("line").alias("start"), F.lit(1).alias("m"))
    by_line = Window.partitionBy("doc_id").orderBy("line")
    island = Window.partitionBy("doc_id", "island")
    held = suffixes.withColumn("island", F.col("line") - F.row_number().over(by_line))
    held = held.select("doc_id", "island", "line", "chars", (F.sum("chars").over(island.orderBy("line")) - F.col("chars")).alias("before"), F.lead("line").over(island.orderBy("line")).isNull().alias("last"))
    here = F.struct("line", "before")
    end = F.struct((F.col("line") + 1).alias("line"), (F.col("before") + F.col("chars")).alias("before"))
    bounds = held.select("doc_id", "island", F.explode(F.when(F.col("last"), F.array(here, end)).otherwise(F.array(here))).alias("b")).select("doc_id", "island", "b.line", "b.before")
    stop = F.min("line").over(island.orderBy(F.col("before").desc()).rangeBetween(Window.unboundedPreceding, -min_chars))
    start = F.max("line").over(island.orderBy("before").rangeBetween(Window.unboundedPreceding, -min_chars))
    sides = bounds.select("doc_id", "line", stop.alias("stop"), start.alias("start"))
    pairs = sides.select("doc_id", F.explode(F.array(F.struct(F.col("line").alias("start"), "stop"), F.struct("start", F.col("line").alias("stop")))).alias("b"))
    return pairs.where("b.start is not null and b.stop is not null").select("doc_id", "b.start", (F.col("b.stop") - F.col("b.start")).alias("m")).distinct()


def _later(suffixes: DataFrame, least: DataFrame, k: int) -> DataFrame:
    """Least blocks [start, end) of k to 2k - 1 lines that are later copies."""
    head = suffixes.select("doc_id", F.col("line").alias("start"), "rank")
    tail = suffixes.select("doc_id", F.col("line").alias("tail"), F.col("rank").alias("rank_"))
    mine = least.where(F.col("m").between(k, 2 * k - 1)).join(head, ["doc_id", "start"])
    if k > 1:
        mine = mine.withColumn("tail", F.col("start") + F.col("m") - k).join(tail, ["doc_id", "tail"])
    else:
        mine = mine.withColumn("rank_", F.col("rank"))
    key, place = ["m", "rank", "rank_"], F.struct("doc_id", "start")
    first = mine.groupBy(key).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return mine.join(first, key).where(place > F.col("first")).select("doc_id", "start", (F.col("start") + F.col("m")).alias("end"))


def _runs(source: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, spans) of rows (doc_id, text) with unique ids."""
    lines = source.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    suffixes = materialize(lines.select("doc_id", "line", F.length(F.translate("body", _SPACE, "")).cast("long").alias("chars"), F.md5("body").alias("line_id")), "suffixes")
    suffixes, k, blocks = materialize(_ranked(suffixes), "ranked"), 1, []
    least = materialize(_least_blocks(suffixes, min_chars), "least")
    longest = least.agg(F.max("m")).first()[0] or 0
    while k <= longest and not suffixes.isEmpty():
        blocks.append(materialize(_later(suffixes, least, k), "later"))
        k *= 2
        if k <= longest:
            suffixes = materialize(_doubled(suffixes, k // 2), "ranked")
    if not blocks:
        return source.select("doc_id", F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))).alias("spans")).limit(0)
    found = blocks[0]
    for more in blocks[1:]:
        found = found.union(more)
    furthest = found.groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy("doc_id").orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("reach") >= F.col("start"), 0).otherwise(1)).over(order)
    runs = furthest.withColumn("reach", reach).withColumn("island", island).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Line spans to delete: (doc_id, digest, spans array<struct<start,end>>), documents with any.

    Lines are what "\\n" separates; characters of white space don't count for ``min_chars``. Null
    ids and null texts take no part. Where ids repeat, rows with the same id and text are one document
    and those with another text are documents of their own, in order of (id, MD5 of the text), which
    ``digest`` names; it is null where ids are unique. Empty tables give no rows. Other columns are ignored."""
    return _spans(docs, id_col, text_col, min_chars)[0]


def _spans(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> tuple[DataFrame, bool]:
    """The spans, and whether ids repeat."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    if not has_repeats(source, "doc_id"):
        return _runs(source, min_chars).select("doc_id", F.lit(None).cast("string").alias("digest"), "spans"), False
    keys = row_keys(source)
    one = source.withColumn("digest", digest_of(F.col("text"))).groupBy("doc_id", "digest").agg(F.first("text").alias("text"))
    found = _runs(materialize(one.join(keys, ["doc_id", "digest"]).select(F.col("row").alias("doc_id"), "text"), "documents"), min_chars)
    return keys.join(found.withColumnRenamed("doc_id", "row"), "row").select("doc_id", "digest", "spans"), True


def _with_spans(rows: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """The rows with their ``_spans``, null where nothing goes; the same plan at every size."""
    spans, repeated = _spans(rows, id_col, text_col, min_chars)
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("spans").alias("_spans"))
    same = F.col(id_col).cast("long") == F.col("_id")
    if repeated:
        same &= digest_of(F.col(text_col)) == F.col("_digest")
    return rows.join(spans.hint("merge"), same, "left")


def _kept_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line, i: ~F.exists("_spans", lambda s: (i >= s["start"]) & (i < s["end"])))


def delete_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", min_chars: int = MIN_CHARS, drop_emptied: bool = True) -> DataFrame:
    """The documents without later copies of repeated runs, all columns.

    Where a text changes, ``chars_col`` (if the table has it) is set to its new length. Documents
    that lose all their lines with a word are left out if ``drop_emptied``; documents that came
    empty or null stay as they are."""
    joined = _with_spans(docs, id_col, text_col, min_chars)
    hit = F.col("_spans").isNotNull()
    out = joined.withColumn(text_col, F.when(hit, F.array_join(_kept_lines(F.col(text_col)), "\n")).otherwise(F.col(text_col)))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(hit, F.length(text_col)).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType))
    if drop_emptied:
        out = out.where(~hit | (F.translate(text_col, _SPACE, "") != ""))
    return out.select(docs.columns)


def line_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_md5), one row per input row; a null text has no lines
    and counts as empty."""
    rows = _with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "text", min_chars)
    gone = F.aggregate("_spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    kept = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(_kept_lines(F.col("text")), "\n"))
    return rows.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"), F.md5(F.coalesce(kept, F.lit(""))).alias("kept_md5"))
