"""MinHash near-duplicate detection (operator 5).

Method: circulant MinHash. One permutation scatters the shingle hashes over 2**32 points, a
second one is shifted circularly by 0, 1, 2, ... to give every signature coordinate; the
coordinates are banded, and documents that share a band are compared on their full shingle
sets. A link needs an exact Jaccard similarity of at least ``threshold`` per cent.

Groups are never expanded into all pairs:

1. Documents with equal shingle sets form one class; only its smallest id goes on.
2. Each band bucket names a centre, the member that shares the most buckets with others.
   Every member is compared with the centre of each of its buckets.
3. Members left in other components than their centre may still be linked with each other.
   For members x, y of centre c, the intersection of x and y is at most
   min(|x & c|, |y & c|) plus what x has outside c that another member also has outside c.
   Pairs that this bound or the set sizes rule out cannot be links and are not made; all
   others of different components are compared exactly. The bounds are first taken over the
   members of one component and size together, so a family that is linked already isn't
   paired with itself.

A centre's text travels once for each block of its members. A text of any length is one row and is
never cut; a task needs memory in proportion to its longest text (about thirty times its bytes).

So no link between documents that share a bucket is lost. With 28 bands of 4 coordinates, a
pair at similarity 0.8 shares no bucket with a chance of 4e-7, at 0.85 with 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitree.llm.components import connected_components
from orbitree.llm.shared import has_repeats, materialize
from orbitree.llm.textkernel import Words, mix32, mix64, word_slices

SHINGLE = 5
BANDS = 28
ROWS = 4
#: Members of a centre that are compared with it in one go, about.
PIECE = 256

_SIGNATURES = "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"
_OVERLAPS = "a long, b long, shared long, size_a long, size_b long, rest_b array<long>"


def _sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their offsets."""
    grams = words.windows(k)
    parts, sizes = [], np.zeros(len(words), dtype=np.int64)
    for d, (lo, hi) in enumerate(zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist())):
        if hi - lo >= k:
            own = np.sort(grams[lo : hi - k + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif hi > lo:
            short = np.uint64(hi - lo)
            for h in words.hashes[lo:hi]:
                short = mix64(np.array([short ^ h], dtype=np.uint64))[0]
            own = np.array([short], dtype=np.uint64)
        else:
            continue
        parts.append(own)
        sizes[d] = len(own)
    values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return values, np.concatenate(([0], np.cumsum(sizes)))


def _signatures(values: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket ids (texts x bands); every text must have a shingle."""
    scattered = mix32((values ^ (values >> np.uint64(32))).astype(np.uint32))
    starts = offsets[:-1]
    out = np.empty((len(starts), bands), dtype=np.uint64)
    for band in range(bands):
        bucket = np.full(len(starts), band + 1, dtype=np.uint64)
        for shift in range(band * rows, band * rows + rows):
            least = np.minimum.reduceat(mix32(scattered + np.uint32(shift)), starts)
            bucket = mix64(bucket ^ least.astype(np.uint64)) + np.uint64(band)
        out[:, band] = bucket
    return out


def _describe(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for words in word_slices(batch.column(1), lower=True):
                values, offsets = _sets(words, k)
                sizes = np.diff(offsets)
                full = sizes > 0
                at = offsets[:-1][full]
                keys = [np.zeros(len(words), dtype=np.uint64) for _ in range(2)]
                buckets = np.empty((0, bands), dtype=np.uint64)
                if len(at):
                    for key, salt in zip(keys, (0x51ED270B, 0x2545F4914F6CDD1D)):
                        key[full] = np.add.reduceat(mix64(values ^ np.uint64(salt)), at)
                    buckets = _signatures(values, np.concatenate((at, offsets[-1:])), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(full * bands))), pa.int32()), pa.array(buckets.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(words.first, len(words)), pa.array(sizes), *(pa.array(key.view(np.int64)) for key in keys), lists], names=["doc_id", "n_shingles", "key1", "key2", "bands"])

    return run


def _overlap(k: int):
    """Rows (a, piece, kind, id, text), each piece led by its centre a (kind 0), to set sizes,
    intersection size and the shingles that only the member b has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty(0, np.uint64)
        for batch in batches:
            a, kind, ids = (np.asarray(batch.column(i)) for i in (0, 2, 3))
            rows = []
            for words in word_slices(batch.column(4), lower=True):
                values, offsets = _sets(words, k)
                for d in range(len(words)):
                    i = words.first + d
                    own = values[offsets[d] : offsets[d + 1]]
                    if kind[i] == 0:
                        kept = own.copy()
                        continue
                    at = np.searchsorted(kept, own)
                    at[at == len(kept)] = 0
                    common = kept[at] == own if len(kept) else np.zeros(len(own), bool)
                    rows.append((a[i], ids[i], int(common.sum()), len(kept), len(own), own[~common].view(np.int64)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.list_(pa.int64()))], names=["a", "b", "shared", "size_a", "size_b", "rest_b"])

    return run


def _compare(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Exact set overlap of pairs (a, b). The members b of a centre are dealt to pieces of about
    ``PIECE``; each piece gets the centre's text once, in front."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    dealt = materialize(pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("pieces")).cast("int").alias("piece"), "b"), "pieces")
    members = dealt.join(texts, dealt.b == texts.doc_id).select("a", "piece", F.lit(1).alias("kind"), F.col("b").alias("id"), "text")
    centres = dealt.select("a", "piece").distinct().join(texts, F.col("a") == texts.doc_id).select("a", "piece", F.lit(0).alias("kind"), F.col("a").alias("id"), "text")
    return members.union(centres).repartition("a", "piece").sortWithinPartitions("a", "piece", "kind").mapInArrow(_overlap(k), _OVERLAPS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 85, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Near-duplicate classes: (doc_id, n_shingles, component_id, kept), one row per input row.

    A-Z count as lower case; words are runs of characters other than space and U+0009..U+000D.
    A text of fewer words than a shingle is one shingle; a null text, or one without words, has
    no shingle, is linked with nothing and is kept. Rows that repeat an id are compared each by its own
    text; a row is kept if its id is the smallest of its component. A null id
    names nothing: its row is linked with nothing, has a null component and is kept. Other
    columns are ignored, so their names don't matter."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not has_repeats(source, "doc_id"):
        found = _classes(source, threshold, shingle, bands, rows)
    else:
        keyed = materialize(_with_rows(source, "doc_id"), "keyed")
        found = _named(_classes(keyed.select(F.col("_row").alias("doc_id"), "text"), threshold, shingle, bands, rows), keyed)
        found = found.select(F.col("first.doc_id").alias("component_id"), "doc_id", "n_shingles").unionByName(_nameless(keyed, shingle, bands, rows))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _with_rows(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows with a number of their own where they have an id; to be written before use."""
    return rows.withColumn("_row", F.when(F.col(id_col).isNotNull(), F.monotonically_increasing_id()))


def _named(found: DataFrame, keyed: DataFrame) -> DataFrame:
    """Classes of numbered rows with each row's id, and ``first``, the least (doc_id, row) of its component."""
    rows = materialize(found.where("doc_id is not null").withColumnRenamed("doc_id", "_row").join(keyed.where("_row is not null").select("_row", "doc_id"), "_row"), "classes")
    first = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", F.col("_row").alias("row"))).alias("first"))
    return rows.join(first, "component_id")


def _nameless(keyed: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """Rows without an id."""
    alone = keyed.where("doc_id is null").select("doc_id", "text").mapInArrow(_describe(shingle, bands, rows), _SIGNATURES)
    return alone.select(F.col("doc_id").alias("component_id"), "doc_id", "n_shingles")


def _classes(source: DataFrame, threshold: int, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of rows (doc_id, text) whose ids are unique or null."""
    described = materialize(source.mapInArrow(_describe(shingle, bands, rows), _SIGNATURES), "signatures")
    sized = described.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(sized.groupBy("key1", "key2", "n_shingles").agg(F.min(F.struct("doc_id", "bands")).alias("first")).select("key1", "key2", "n_shingles", F.col("first.doc_id").alias("rep"), F.col("first.bands").alias("bands")), "classes")

    buckets = classes.select("rep", F.explode("bands").alias("bucket"))
    crowded = buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = materialize(buckets.join(crowded, "bucket"), "buckets")
    score = shared.groupBy("rep").agg(F.sum("members").alias("score"))
    centre = shared.join(score, "rep").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("rep")).alias("minus"))).alias("best")).select("bucket", (-F.col("best.minus")).alias("a"))
    star = shared.join(centre, "bucket").where("rep != a").select("a", F.col("rep").alias("b")).distinct()

    wanted = shared.select(F.col("rep").alias("doc_id")).distinct().hint("merge")  # the same plan at every size
    texts = materialize(source.join(wanted, "doc_id").select("doc_id", "text"), "texts")
    tested = materialize(_compare(star, texts, shingle), "star")
    linked = f"100 * shared >= {threshold} * (size_a + size_b - shared)"
    links = tested.where(linked).select("a", "b")
    parts = connected_components(links)
    rest = _rest_pairs(tested, parts, threshold)
    more = materialize(_compare(rest, texts, shingle).where(linked).select("a", "b"), "links")
    if not more.isEmpty():
        parts = connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    members = described.join(classes.drop("bands"), ["key1", "key2", "n_shingles"], "left").where("n_shingles > 0 and doc_id is not null")
    found = members.join(parts, members.rep == parts.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = described.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone)


def _rest_pairs(tested: DataFrame, parts: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of one centre's members in different components that the bounds leave open."""
    where = parts.select(F.col("node").alias("n_"), F.col("component").alias("c_"))
    with_b = tested.join(where, tested.b == F.col("n_"), "left").select(tested["*"], F.coalesce("c_", "b").alias("part"))
    rows = with_b.join(where, with_b.a == F.col("n_"), "left").select(with_b["*"], F.coalesce("c_", "a").alias("own"))
    rows = materialize(rows.select("a", "b", "shared", F.col("size_b").alias("size"), "rest_b", "part", (F.col("part") != F.col("own")).alias("outside")), "members")
    groups = rows.groupBy("a").agg(F.count("*").alias("n"), F.max("outside").alias("some"), F.min("size").alias("least"), F.max("size").alias("most")).where("n > 1 and some")
    active = rows.join(groups, "a")
    apart = active.select("a", "b", F.explode("rest_b").alias("shingle"))
    repeated = apart.groupBy("a", "shingle").agg(F.count("*").alias("holders")).where("holders > 1")
    extra = apart.join(repeated, ["a", "shingle"]).groupBy("a", "b").agg(F.count("*").alias("extra"))
    bound = active.drop("rest_b").join(extra, ["a", "b"], "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
    bound = bound.withColumn("cap", F.floor((100 + threshold) * (F.col("shared") + F.col("extra")) / F.lit(threshold)).cast("long") - F.col("size"))
    bound = materialize(bound.where("cap >= least").select("a", "b", "shared", "extra", "size", "cap", "part", "outside", "least", "most"), "bounds")
    kin = bound.groupBy("a", "part", "size").agg(*(F.max(c).alias(c) for c in ("shared", "extra", "cap", "outside", "least", "most")))
    kin = materialize(kin, "kin")
    low = F.greatest("least", F.ceil(threshold * F.col("size") / F.lit(100)).cast("long"))
    high = F.least("most", "cap", F.floor(100 * F.col("size") / F.lit(threshold)).cast("long"))
    seek = kin.where("outside").withColumn("low", low).withColumn("high", high).where("low <= high")
    seek = seek.select("a", F.col("shared").alias("sx"), F.col("extra").alias("ex"), F.col("size").alias("nx"), F.col("part").alias("px"), F.explode(F.sequence("low", "high")).alias("size"))
    most = F.least("sx", "shared") + F.least("ex", "extra")
    may = (F.col("px") != F.col("part")) & (F.col("cap") >= F.col("nx")) & ((100 + threshold) * most >= threshold * (F.col("nx") + F.col("size")))
    open_ = materialize(seek.join(kin.drop("least", "most"), ["a", "size"]).where(may).select("a", "px", "nx", "part", "size").distinct(), "open")
    members = bound.select("a", "b", "shared", "extra", "size", "cap", "part", "outside")
    left = members.where("outside").select("a", F.col("b").alias("x"), F.col("shared").alias("sx"), F.col("extra").alias("ex"), F.col("size").alias("nx"), F.col("cap").alias("cx"), F.col("part").alias("px"))
    met = left.join(open_, ["a", "px", "nx"]).join(members, ["a", "part", "size"])
    met = met.where(may & (F.col("cx") >= F.col("size")) & (~F.col("outside") | (F.col("x") < F.col("b"))))
    return met.select(F.least("x", "b").alias("a"), F.greatest("x", "b").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest id, all columns as they came.

    Rows that repeat an id are compared each by its own text, so an id stays with every text that is
    no near copy of another one. Rows with a null id or without words all stay."""
    ids = F.col(id_col).cast("long")
    how = (threshold, shingle, bands, rows)
    nameless = docs.where(F.col(id_col).isNull())
    named = docs.where(F.col(id_col).isNotNull())
    if not has_repeats(named, id_col):
        found = _classes(named.select(ids.alias("doc_id"), F.col(text_col).cast("string").alias("text")), *how)
        kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
        return named.join(kept, ids == F.col("_kept"), "left_semi").unionByName(nameless)
    keyed = materialize(_with_rows(named, id_col), "keyed")
    own = keyed.select("_row", ids.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _named(_classes(own.select(F.col("_row").alias("doc_id"), "text"), *how), own)
    kept = found.where("_row = first.row").select(F.col("_row").alias("_kept"))
    return keyed.join(kept, F.col("_row") == F.col("_kept"), "left_semi").drop("_row").unionByName(nameless)
