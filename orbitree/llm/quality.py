"""Quality rules (operator 10), DataFrame functions only.

Base rules look at one text. The method is cross-document line frequency: normalised lines
are hashed, the distinct documents of a host (column ``source``) that hold a line are counted,
lines above the limits are removed, and documents depleted by it are rejected. Lines are equal if
they differ in case and white space only.

With ``copies_once`` (the default) copies of one document count once, for a line and for its host:
a document is then known by the hash of its whole text in lower case and with single spaces, which
no single line decides. So a large group of copies does not make its own content look like page
furniture; documents that share most of their text, near copies among them, still count as
different. Without it, every document counts by its id.

A text is one row with arrays of its words, lines and hashes, so a task needs memory in proportion
to its longest text (about ten times its bytes); texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitree.llm.shared import materialize

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: A line is page furniture if it is in more documents of its host than this share and this count.
MAX_SHARE = 0.02
MIN_DOCS = 20
#: A document is depleted if less than this percentage of its word characters is left.
LEAST_LEFT = 20


def words_of(text: Column) -> Column:
    """Runs of characters other than space and U+0009..U+000D."""
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def _word_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.translate(line, _SPACE, "") != "")


def _line_key(line: Column) -> Column:
    """Lines that differ in case or white space only are the same line."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, r"[ \t-\r]+", " "))))


def _described(docs: DataFrame, copies_once: bool) -> DataFrame:
    """The base columns, the normalised lines and a row number of rows of (doc_id, host, text)."""
    words = docs.withColumn("words", words_of(F.col("text")))
    n = F.size("words")
    triples = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    counted = words.select(
        "doc_id",
        "host",
        "text",
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        triples.alias("triples"),
        _word_lines(F.col("text")).alias("lines"),
    )
    some = F.size(F.array_distinct("triples")) < F.size("triples")
    ordered = counted.withColumn("ordered", F.when(some, F.sort_array(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    m = F.size("ordered")
    near = F.arrays_zip(F.slice("ordered", 1, m - 1).alias("p"), F.slice("ordered", 2, m - 1).alias("q"))
    twice = F.when(m >= 2, F.filter(near, lambda x: x["p"]["h"] == x["q"]["h"]))
    placed = ordered.withColumn("twice", twice).withColumn(
        "starts",
        F.array_sort(F.array_distinct(F.concat(F.transform("twice", lambda x: x["p"]["i"]), F.transform("twice", lambda x: x["q"]["i"])))),
    )
    # a window starts at each of these words; up to the next start it covers three words at most
    covered = F.aggregate("starts", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, x: F.struct((s["n"] + F.least(F.lit(3), x - s["last"])).alias("n"), x.alias("last")), lambda s: s["n"])
    known_by = F.xxhash64(F.lower(F.trim(F.regexp_replace("text", r"[ \t-\r]+", " ")))) if copies_once else F.col("doc_id")
    return placed.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        known_by.alias("known_by"),
        F.transform("lines", lambda line: F.struct(_line_key(line).alias("key"), F.length(F.translate(line, _SPACE, "")).alias("chars"))).alias("lines"),
    )


def _source(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _common_lines(described: DataFrame, max_share: float, min_docs: int) -> DataFrame:
    """(host, key) of lines above the limits of their host. Each distinct count is a count of
    groups, so a host or a line with a third of all rows is summed in parts before it meets."""
    named = described.where("known_by is not null")
    hosts = named.groupBy(F.col("host").alias("host_"), "known_by").agg(F.count("*").alias("n_")).groupBy("host_").agg(F.count("*").alias("docs"))
    held = named.select("host", "known_by", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key"))
    lines = held.groupBy("host", "key", "known_by").agg(F.count("*").alias("n_")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    return lines.join(hosts, lines.host == hosts.host_).where(F.col("n") > max_share * F.col("docs")).select("host", "key")


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_share: float, min_docs: int, least_left: int, copies_once: bool) -> tuple[DataFrame, DataFrame]:
    """The verdict of each row, and (doc_id, key) of each line that goes."""
    described = materialize(_described(_source(docs, id_col, text_col, host_col), copies_once), "quality")
    common = materialize(_common_lines(described, max_share, min_docs), "common")
    lines = described.select("row", "doc_id", "host", F.explode("lines").alias("line"))
    hit = lines.select("row", "doc_id", "host", F.col("line.key").alias("key"), F.col("line.chars").alias("chars")).join(common, ["host", "key"])
    removed = hit.groupBy(F.col("row").alias("row_")).agg(F.sum("chars").alias("removed"))
    out = described.drop("lines").join(removed, F.col("row") == F.col("row_"), "left")
    out = out.withColumn("removed_chars", F.coalesce("removed", F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    depleted = 100 * (F.col("word_chars") - F.col("removed_chars")) < least_left * F.col("word_chars")
    verdict = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), "removed_chars")
    return verdict, hit.select("doc_id", "key")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, least_left: int = LEAST_LEFT, copies_once: bool = True) -> DataFrame:
    """Quality columns and verdict, one row per input row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, removed_chars. A null text counts as empty, null hosts as one host; empty texts fail the
    base rule on n_words. Rows that repeat an id, also with another text, and rows with a null id
    are judged each by its own text; without ``copies_once`` repeated ids count once and null ids
    not at all. A line at a limit stays. Empty tables give no rows. Other columns are ignored."""
    return _judged(docs, id_col, text_col, host_col, max_share, min_docs, least_left, copies_once)[0]


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str | None = "n_chars", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, least_left: int = LEAST_LEFT, copies_once: bool = True) -> DataFrame:
    """The documents that pass, with all columns, without the lines above the limits.

    Where a text changes, ``chars_col`` (if the table has it) is set to its new length. Rows
    with a null id can't be told apart and pass unjudged; rows that repeat an id pass if one
    of them does."""
    verdict, hit = _judged(docs, id_col, text_col, host_col, max_share, min_docs, least_left, copies_once)
    good = verdict.where("kept and doc_id is not null").select("doc_id").distinct()
    gone = hit.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    plan = good.join(gone, "doc_id", "left").select(F.col("doc_id").alias("_id"), F.col("keys").alias("_keys"))
    named = docs.where(F.col(id_col).isNotNull()).join(plan, F.col(id_col).cast("long") == F.col("_id"))
    left = F.filter(F.split(text_col, "\n"), lambda line: (F.translate(line, _SPACE, "") == "") | ~F.array_contains("_keys", _line_key(line)))
    text = F.when(F.col("_keys").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    out = named.withColumn(text_col, text)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col("_keys").isNull(), F.col(chars_col)).otherwise(F.length(text_col)).cast(docs.schema[chars_col].dataType))
    return out.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
