"""Benchmark decontamination by templates (operator 9), DataFrame functions only.

Texts become templates, word by word: numbers, units and names (words with one capital letter in
front, but for common words) turn into typed placeholders; other words lose case and punctuation. Numbers part
from their units first (300km).
A word's placeholder doesn't depend on its neighbours, so a passage has the same template wherever
it stands. Items have a second template of their lower-case text, so documents in other case meet
by that one. Windows of ``window`` template tokens are joined by hash; documents and items give all
of theirs, so a shared run of ``window`` tokens always meets. A window in which placeholders
outnumber words says too little: it carries the values themselves and meets equal values only.
Items shorter than 2 * window - 1 tokens take windows of half their length, those of fewer than
``short`` tokens one window, the whole item with its values.

The windows of a document against an item give the covered tokens, and the slots under them must be
consistent, that is each value of the item stands for one value in the occurrence. A document can
hold an item several times with other values: each shift, each run of neighbouring shifts, and at
last the document as a whole are judged by themselves, and one of them that passes makes the pair
a leak.

A text is a row with arrays of its tokens and window hashes, so a task needs memory in proportion
to its longest text (some forty times its words); texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitree.llm.shared import materialize

WINDOW = 6
#: An item leaks if this share of its tokens, or so many of them, are covered.
LEAST_SHARE = 0.5
LEAST_TOKENS = 20
#: Items of fewer tokens are met as a whole, with their values.
SHORT = 5
#: Benchmark windows up to this number are broadcast (40 bytes each); more are shuffled.
BROADCAST_ROWS = 500_000

#: Units (fixed values).
UNITS = ("km", "m", "cm", "mm", "mi", "miles", "mile", "ft", "feet", "foot", "inch", "inches", "kg", "g", "mg", "lb", "lbs", "pounds", "oz", "l", "ml", "liters", "litres", "s", "sec", "seconds", "second", "min", "minutes", "minute", "h", "hr", "hours", "hour", "days", "day", "weeks", "week", "months", "month", "years", "year", "mph", "kmh", "usd", "eur", "dollars", "dollar", "euros", "euro", "cents", "percent", "degrees", "degree")

#: Words that are often written with a capital letter and are no names (fixed values).
STARTERS = ("a", "about", "after", "all", "also", "although", "an", "and", "any", "are", "as", "at", "because", "before", "both", "but", "by", "calculate", "can", "compute", "consider", "could", "did", "do", "does", "during", "each", "every", "explain", "find", "first", "for", "from", "given", "had", "has", "have", "he", "her", "his", "how", "however", "i", "if", "in", "is", "it", "its", "let", "many", "more", "most", "my", "no", "not", "now", "of", "on", "one", "or", "our", "she", "since", "so", "some", "suppose", "that", "the", "their", "then", "there", "these", "they", "this", "those", "to", "two", "under", "until", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whose", "why", "will", "with", "would", "write", "you", "your")

_RUN = r"[ \t-\r]+"
#: Replacements on a text before it is cut into words, read alike by Java and RE2: marks between
#: digits stay as an x, other marks go, and a number parts from its unit.
_CLEAN = ((r"([0-9])[.,:/]([0-9])", r"\1x\2"), (r"[!-/:-@\[-`{-~¡-¿×÷‐-⁞]+", ""), ("([0-9])((?i:" + "|".join(UNITS) + "))\\b", r"\1 \2"))
_NUMBER = "^[0-9][0-9x]*$"
_NUMBER_UNIT = "^[0-9][0-9x]*(?:" + "|".join(UNITS) + ")$"
_SLOTS = ("<num>", "<num><unit>", "<name>", "<unit>")


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for pattern, into in _CLEAN:
        text = F.regexp_replace(text, pattern, into.replace("\\", "$"))
    return F.filter(F.split(text, _RUN), lambda w: w != "")


def token(word: Column) -> Column:
    """A word's template token: a number, a name (a capital letter, then none), a unit, or the word."""
    low, first = F.lower(word), F.substring(word, 1, 1)
    number = F.when(word.rlike(_NUMBER), _SLOTS[0]).when(low.rlike(_NUMBER_UNIT), _SLOTS[1]).otherwise(low)
    name = (first != F.lower(first)) & (F.length(word) > 1) & (F.substring(word, 2, 1) == F.lower(F.substring(word, 2, 1))) & ~low.isin(*STARTERS)
    return F.when((first >= "0") & (first <= "9"), number).when(name, _SLOTS[2]).when(low.isin(*UNITS), _SLOTS[3]).otherwise(low)


def _hashed(words: Column) -> Column:
    """(t, v): hashes of each word's token and of the word itself."""
    return F.transform(words, lambda w: F.struct(F.xxhash64(token(w)).alias("t"), F.xxhash64(F.lower(w)).alias("v")))


def _window(hashed: str, at: str, width: int, exact: bool) -> Column:
    """The hash of ``width`` tokens from a place on. Written for rows of places, so that Spark
    compiles it."""
    part = [F.get(hashed, F.col(at) + j) for j in range(width)]
    values = F.xxhash64(F.lit(-width), *(p["v"] for p in part))
    if exact:
        return values
    slots = sum(F.when(p["t"].isin(*(F.xxhash64(F.lit(s)) for s in _SLOTS)), 1).otherwise(0) for p in part)
    return F.when(2 * slots > width, values).otherwise(F.xxhash64(F.lit(width), *(p["t"] for p in part)))


def _windows(rows: DataFrame, columns: list[str], typed: list[int], whole: list[int]) -> DataFrame:
    """(columns, width, at, hash): all windows of the widths in ``typed``, and those by value of the
    widths in ``whole``, of rows with a column ``hashed``."""
    kinds = [(w, False) for w in typed] + [(w, True) for w in whole]
    if not kinds:
        return rows.select(*columns, F.lit(0).alias("width"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("hash")).limit(0)
    n, least = F.size("hashed"), min(w for w, _ in kinds)
    places = rows.select(*columns, "hashed", F.explode(F.when(n >= least, F.sequence(F.lit(0), n - least))).alias("at"))
    if len(kinds) == 1:
        return places.select(*columns, F.lit(least).alias("width"), "at", _window("hashed", "at", *kinds[0]).alias("hash"))
    fits = [F.when(F.col("at") + w <= n, F.struct(F.lit(w).alias("width"), _window("hashed", "at", w, exact).alias("hash"))) for w, exact in kinds]
    return places.select(*columns, "at", F.explode(F.array(*fits)).alias("w")).where("w is not null").select(*columns, "w.width", "at", "w.hash")


def _item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int, short: int) -> tuple[DataFrame, list[int], list[int]]:
    """(item_id, n_tokens, width, at, hash) of both templates of each item, the widths of its
    windows, and the widths of those that are met by value."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.explode(F.array(F.col(text_col), F.lower(text_col))).alias("text")).where("item_id is not null")
    sized = materialize(items.select("item_id", _hashed(words_of(F.col("text"))).alias("hashed")).withColumn("n_tokens", F.size("hashed")).where("n_tokens > 0"), "tokens")
    lengths = [r.n_tokens for r in sized.select(F.least("n_tokens", F.lit(2 * window + short)).alias("n_tokens")).distinct().collect()]  # a few dozen numbers
    half = lambda n: min(window, (n + 1) // 2)
    typed, whole = sorted({half(n) for n in lengths if n >= short}), sorted({n for n in lengths if n < short})
    columns, n = ["item_id", "n_tokens"], F.col("n_tokens")
    parts = [_windows(sized.where((n >= short) & (F.least(F.lit(window), F.floor((n + 1) / 2)) == w)), columns, [w], []) for w in typed]
    parts += [_windows(sized.where((n < short) & (n == w)), columns, [], [w]) for w in whole]
    made = parts[0] if parts else _windows(sized, columns, [], [])
    for part in parts[1:]:
        made = made.union(part)
    return materialize(made.distinct(), "items"), typed, whole


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, least_share: float = LEAST_SHARE, least_tokens: int = LEAST_TOKENS, short: int = SHORT) -> DataFrame:
    """Leaks of benchmark items, one row per (doc_id, item_id).

    Returns doc_id, item_id, n_covered and n_tokens of the item's template, n_slots (slot values
    compared), n_changed (those whose value differs), n_clashes (item values with more than one
    value there), kind ('verbatim' or 'reparameterised'), all of the occurrence that covers most.
    A pair whose slots mostly clash in every occurrence is no leak. Null ids and texts on either
    side take no part, nor do items without a word; rows that repeat an id are judged each by its
    text, and one of them that leaks makes the pair; empty tables give no rows. Other columns are
    ignored."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    items, typed, whole = _item_windows(benchmark, item_col, item_text_col, window, short)
    known = F.broadcast(items) if items.count() <= BROADCAST_ROWS else items
    hashed = source.select("doc_id", F.xxhash64("text").alias("version"), _hashed(words_of(F.col("text"))).alias("hashed"))
    met = _windows(hashed, ["doc_id", "version"], typed, whole).withColumnRenamed("at", "there")
    hits = met.join(known, ["hash", "width"]).select("doc_id", "version", "item_id", "n_tokens", "width", "at", (F.col("there") - F.col("at")).alias("shift"))
    spots = materialize(hits.select("doc_id", "version", "item_id", "n_tokens", "shift", F.explode(F.sequence("at", F.col("at") + F.col("width") - 1)).alias("at")).distinct(), "spots")

    pair = ["doc_id", "version", "item_id"]
    enough = (F.col("n_covered") >= least_share * F.col("n_tokens")) | (F.col("n_covered") >= least_tokens)
    able = spots.groupBy(*pair, "n_tokens").agg(F.countDistinct("at").alias("n_covered")).where(enough).select(*pair)
    placed = materialize(_occurrences(spots.join(able, pair, "left_semi"), window), "placed")
    here = [*pair, "scope", "occurrence"]
    cover = placed.select("*", F.explode("occurrences").alias("o")).select(*pair, "n_tokens", "o.scope", "o.occurrence", "at").groupBy(*here, "n_tokens").agg(F.countDistinct("at").alias("n_covered")).where(enough)

    asked = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.posexplode(words_of(F.col(item_text_col))).alias("at", "word"))
    asked = asked.select("item_id", "at", token(F.col("word")).alias("token"), F.lower("word").alias("value")).where(F.col("token").isin(*_SLOTS)).distinct()
    texts = source.withColumn("version", F.xxhash64("text")).join(placed.select("doc_id", "version").distinct(), ["doc_id", "version"]).dropDuplicates(["doc_id", "version"])
    held = materialize(texts.select("doc_id", "version", F.transform(words_of(F.col("text")), F.lower).alias("values")), "values")
    compared = placed.join(asked, ["item_id", "at"]).join(held, ["doc_id", "version"]).withColumn("there", F.get("values", F.col("shift") + F.col("at")))
    compared = compared.select(*pair, "token", "value", "there", F.explode("occurrences").alias("o")).select(*pair, "o.scope", "o.occurrence", "token", "value", "there")
    values = compared.groupBy(*here, "token", "value").agg(F.countDistinct("there").alias("ways"), F.max(F.col("there") != F.col("value")).alias("changed"))
    slots = values.groupBy(*here).agg(F.count("*").alias("n_slots"), F.sum(F.col("changed").cast("long")).alias("n_changed"), F.sum((F.col("ways") > 1).cast("long")).alias("n_clashes"))
    zero = F.lit(0).cast("long")
    out = cover.join(slots, here, "left").select(*here, "n_covered", F.col("n_tokens").cast("long").alias("n_tokens"), *(F.coalesce(c, zero).alias(c) for c in ("n_slots", "n_changed", "n_clashes")))
    leaks = out.where((F.col("n_slots") < 2) | (2 * F.col("n_clashes") <= F.col("n_slots")))
    told = F.struct("n_covered", "n_tokens", "n_slots", "n_changed", "n_clashes")
    best = leaks.groupBy("doc_id", "item_id").agg(F.min_by(told, F.struct(F.col("scope") == "document", -F.col("n_covered"), "n_changed", "n_clashes", "n_slots", "n_tokens")).alias("b")).select("doc_id", "item_id", "b.*")
    return best.withColumn("kind", F.when(F.col("n_changed") > 0, "reparameterised").otherwise("verbatim"))


def _occurrences(spots: DataFrame, window: int) -> DataFrame:
    """Adds the occurrences that a spot belongs to: its shift, its run of shifts that differ by
    at most ``window`` (and half the item) from one to the next, and the document."""
    pair = ["doc_id", "version", "item_id"]
    order = Window.partitionBy(*pair).orderBy("shift")
    near = F.least(F.lit(window), F.floor(F.col("n_tokens") / 2))
    shifts = spots.groupBy(*pair, "shift").agg(F.max("n_tokens").alias("n_tokens"))
    shifts = shifts.withColumn("first", F.coalesce((F.col("shift") - F.lag("shift").over(order) > near).cast("long"), F.lit(1).cast("long")))
    runs = shifts.select(*pair, "shift", F.sum("first").over(order).alias("run"))

    def one(scope: str, occurrence: Column) -> Column:
        return F.struct(F.lit(scope).alias("scope"), occurrence.cast("long").alias("occurrence"))

    return spots.join(runs, [*pair, "shift"]).withColumn("occurrences", F.array(one("shift", F.col("shift")), one("run", F.col("run")), one("document", F.lit(0)))).drop("run")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents without a leak, all columns as they came; rows with a null id stay."""
    leaks = contaminated(docs, benchmark, id_col, **how).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, F.col(id_col).cast("long") == F.col("_leak"), "left_anti")
