"""Repeated-phrase removal (operator 6).

A word is removed if it lies in a window of ``window`` consecutive words whose word sequence
also starts in a document with a smaller id. Steps:

1. Each window picks the least hash among its ``phrase``-word sequences. Equal windows pick
   the same phrase, so a window that occurs in two documents has a phrase that recurs; only
   such phrases, confirmed by counting distinct documents, go on. Documents with the same
   word sequence count as one, the smallest id; later copies are removed whole.
2. The word sequence of a confirmed phrase is read from its first document.
3. Documents are dealt to shards of about ``SHARD_WORDS`` words, and the phrases to every shard in
   which one of them was picked. Each shard compiles an Aho-Corasick automaton of its phrases and
   streams all its documents through it, which locates every occurrence. A shard holds no
   more phrases than its documents have picked, whatever the corpus has.
4. The windows around occurrences are fingerprinted (96 bits). A window's first document is
   the least id with its fingerprint; windows of later documents mark words.

Texts travel compressed. A text of any length is one row and is never cut; a shard is at least one
document, so a task needs memory in proportion to its longest text (about fifteen times its bytes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitree.llm.shared import materialize
from orbitree.llm.textkernel import WINDOW_BASES, Words, _rolled, mix64, word_slices

#: Words of the documents of a shard, about.
SHARD_WORDS = 1 << 17

_DESCRIBED = "doc_id long, n_words long, key1 long, key2 long, sha256 string, phrases array<long>"
_PACKED = "doc_id long, packed binary"
_SEQUENCES = "phrase long, words binary"
_RUNS = "doc_id long, version long, start int, h1 array<long>, h2 array<int>"
_CUT = "doc_id long, version long, n_removed long, spans array<struct<start:int,end:int>>, sha256 string"


def _picked(grams: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least gram (the first of equals) of each run of ``width`` from a start."""
    if not len(starts):
        return starts
    view = sliding_window_view(grams, width)
    found = [np.unique(starts[i : i + 65536] + view[starts[i : i + 65536]].argmin(1)) for i in range(0, len(starts), 65536)]
    return np.unique(np.concatenate(found))


def _versions(words: Words, base: int = WINDOW_BASES[0]) -> np.ndarray:
    """A hash of each text's word sequence."""
    lo, hi = words.offsets[:-1], words.offsets[1:]
    return mix64(_rolled(words.hashes, lo, hi, base) ^ (hi - lo).astype(np.uint64)).view(np.int64) if len(words.hashes) else np.zeros(len(words), np.int64)


def _describe(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for words in word_slices(batch.column(1)):
                lo, hi = words.offsets[:-1], words.offsets[1:]
                sizes = hi - lo
                keys = [_versions(words, base) for base in WINDOW_BASES]
                grams = words.windows(phrase)
                owner = np.repeat(np.arange(len(words)), sizes)
                places = np.arange(len(words.hashes))
                starts = places[places + window <= hi[owner]] if len(places) else places
                at = _picked(grams, starts, window - phrase + 1)
                counts = np.bincount(owner[at], minlength=len(words)) if len(at) else np.zeros(len(words), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(grams[at].view(np.int64)))
                raw = words.data.tobytes()
                shas = [hashlib.sha256(b" ".join(raw[s:e].split())).hexdigest() for s, e in zip(words.text_offsets[:-1].tolist(), words.text_offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([ids.slice(words.first, len(words)), pa.array(sizes), pa.array(keys[0]), pa.array(keys[1]), pa.array(shas, pa.string()), lists], names=["doc_id", "n_words", "key1", "key2", "sha256", "phrases"])
            pa.default_memory_pool().release_unused()

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze.compress((t.as_buffer() or b"") if t.is_valid else b"") for t in batch.column(1)], pa.binary())], names=["doc_id", "packed"])


def _unpacked(shard: pa.Table) -> tuple[np.ndarray, Iterator[Words]]:
    """Ids and words of a shard's documents."""
    expand = zstandard.ZstdDecompressor()
    texts = pa.array([expand.decompress(p.as_buffer()) for p in shard.column("packed")], pa.large_binary())
    return np.asarray(shard.column("doc_id")), word_slices(texts)


def _letters(words: Words) -> np.ndarray:
    """Words as letters of the automata: half of their hash."""
    return (words.hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _sequences(k: int):
    """The word sequences of phrases, from the documents that were told to give them."""

    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        wanted: dict[tuple[int, int], set[int]] = {}
        for doc_id, version, phrase in zip(*(asked.column(c).to_pylist() for c in ("doc_id", "version", "phrase"))):
            wanted.setdefault((doc_id, version), set()).add(phrase)
        phrases, sequences = [], []
        if wanted:
            ids, texts = _unpacked(shard)
            for words in texts:
                grams, letters = words.windows(k).view(np.int64), _letters(words)
                for d, version in enumerate(_versions(words).tolist()):
                    own = wanted.pop((int(ids[words.first + d]), version), None)
                    if own:
                        lo, hi = int(words.offsets[d]), int(words.offsets[d + 1])
                        places = {g: lo + i for i, g in enumerate(grams[lo : hi - k + 1].tolist()) if g in own}
                        phrases += places
                        sequences += [letters[p : p + k].tobytes() for p in places.values()]
        return pa.table({"phrase": pa.array(phrases, pa.int64()), "words": pa.array(sequences, pa.binary())})

    return run


def _compiled(phrases: pa.Table) -> ahocorasick.Automaton | None:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for words in phrases.column("words"):
        automaton.add_word(tuple(np.frombuffer(words.as_buffer(), np.uint32).tolist()))
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def _located(window: int, phrase: int):
    """Windows around the occurrences of the shard's phrases, as runs of neighbours."""

    def run(shard: pa.Table, phrases: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        automaton = _compiled(phrases)
        if automaton is not None:
            ids, texts = _unpacked(shard)
            for words in texts:
                letters, versions = _letters(words).tolist(), _versions(words).tolist()
                h1 = words.windows(window).view(np.int64)
                h2 = (words.windows(window, WINDOW_BASES[1]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                for d in range(len(words)):
                    lo, hi = int(words.offsets[d]), int(words.offsets[d + 1])
                    if hi - lo < window:
                        continue
                    ends = [end for end, _ in automaton.iter(tuple(letters[lo:hi]))]
                    if not ends:
                        continue
                    starts = np.array(ends) - phrase + 1
                    last = hi - lo - window
                    edge = np.zeros(last + 2, dtype=np.int32)
                    np.add.at(edge, np.clip(starts - (window - phrase), 0, last + 1), 1)
                    np.add.at(edge, np.clip(starts + 1, 0, last + 1), -1)
                    inside = np.cumsum(edge[:-1]) > 0
                    for s, e in np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))).reshape(-1, 2).tolist():
                        rows.append((int(ids[words.first + d]), versions[d], s, h1[lo + s : lo + e], h2[lo + s : lo + e]))
        pa.default_memory_pool().release_unused()
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int32()))]
        return pa.table({name: pa.array(list(c), kind) for c, (name, kind) in zip(columns, kinds)})

    return run


def _cut(window: int):
    def run(shard: pa.Table, marks: pa.Table) -> pa.Table:
        rows = []
        marked = {(doc_id, version): at.values for doc_id, version, at in zip(marks.column("doc_id").to_pylist(), marks.column("version").to_pylist(), marks.column("at"))}
        if marked:
            ids, texts = _unpacked(shard)
            for words in texts:
                raw = words.data.tobytes()
                for d, version in enumerate(_versions(words).tolist()):
                    at = marked.pop((int(ids[words.first + d]), version), None)
                    if at is None:
                        continue
                    own = raw[int(words.text_offsets[d]) : int(words.text_offsets[d + 1])].split()
                    edge = np.zeros(len(own) + 1, dtype=np.int64)
                    np.add.at(edge, np.asarray(at), 1)
                    np.add.at(edge, np.asarray(at) + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    turns = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                    spans = [{"start": s, "end": e} for s, e in turns.reshape(-1, 2).tolist()]
                    rows.append((int(ids[words.first + d]), version, int(gone.sum()), spans, hashlib.sha256(b" ".join(compress(own, ~gone))).hexdigest()))
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [("doc_id", pa.int64()), ("version", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("sha256", pa.string())]
        return pa.table({name: pa.array(list(c), kind) for c, (name, kind) in zip(columns, kinds)})

    return run


def repeated_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, phrase: int = 25, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Repeated words per document: (doc_id, n_words, n_removed, spans, kept_sha256).

    spans are the removed word ranges [start, end); kept_sha256 is the digest of the kept
    words joined by one space. One row per input row. Null and empty texts have no words.
    A row with a null id is never a source and loses nothing. Rows that repeat an id are judged
    each by its text against smaller ids. Empty tables give no rows. Other columns are ignored."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = materialize(source.mapInArrow(_describe(window, phrase), _DESCRIBED), "described")
    long = described.where(f"n_words >= {window} and doc_id is not null").withColumnRenamed("key1", "version")
    n_shards = max(1, (long.agg(F.sum("n_words")).first()[0] or 0) // shard_words)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).alias("shard")

    firsts = long.groupBy("version", "key2", "n_words").agg(F.min("doc_id").alias("first"))
    held = long.join(firsts, ["version", "key2", "n_words"])
    copies = held.where("doc_id > first").select("doc_id", "version").distinct()
    rows = held.where("doc_id = first").select("doc_id", "version", F.explode("phrases").alias("phrase"))
    recurring = rows.groupBy("phrase").agg(F.min(F.struct("doc_id", "version")).alias("least"), F.max("doc_id").alias("most")).where("least.doc_id < most")
    recurring = materialize(recurring.select("phrase", "least.doc_id", "least.version"), "recurring")
    dealt = rows.select("phrase", shard).distinct().join(recurring.select("phrase"), "phrase")

    texts = source.where("doc_id is not null").mapInArrow(_pack, _PACKED).select(shard, "doc_id", "packed")
    told = texts.groupBy("shard").cogroup(recurring.select(shard, "doc_id", "version", "phrase").groupBy("shard")).applyInArrow(_sequences(phrase), _SEQUENCES)
    phrases = dealt.join(told, "phrase").select("shard", "words")
    runs = materialize(texts.groupBy("shard").cogroup(phrases.groupBy("shard")).applyInArrow(_located(window, phrase), _RUNS), "runs")
    found = runs.select("doc_id", "version", "start", F.posexplode(F.arrays_zip("h1", "h2")).alias("i", "h")).select("h.h1", "h.h2", "doc_id", "version", (F.col("start") + F.col("i")).alias("at"))
    first = materialize(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("most")).where("first < most").drop("most"), "first")
    later = found.join(first, ["h1", "h2"]).where("doc_id > first").groupBy("doc_id", "version").agg(F.collect_list("at").alias("at"))
    marks = later.select(shard, "doc_id", "version", "at")
    cut = materialize(texts.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(_cut(window), _CUT), "cut")
    cut = cut.select(F.col("doc_id").alias("id_"), F.col("version").alias("version_"), "n_removed", "spans", F.col("sha256").alias("sha_"))

    whole = copies.select(F.col("doc_id").alias("copy_"), F.col("version").alias("of_"))
    out = described.drop("phrases", "key2").join(cut, (F.col("doc_id") == F.col("id_")) & (F.col("key1") == F.col("version_")), "left")
    out = out.join(whole, (F.col("doc_id") == F.col("copy_")) & (F.col("key1") == F.col("of_")), "left")
    gone = F.col("copy_").isNotNull()
    span = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    return out.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, span).otherwise(F.coalesce("spans", nothing)).alias("spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha_", "sha256")).alias("kept_sha256"),
    )
