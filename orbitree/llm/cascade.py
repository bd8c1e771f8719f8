"""Bloom filter cascade: exact membership in a list, over a universe of keys that is known whole.

Level 1 encodes the listed keys, level 2 the unlisted keys that level 1 takes for listed, level 3
the listed keys that level 2 takes for false positives, and so on until no key is taken wrongly.
A key of the universe is judged by the parity of the first level that refuses it, without a
join. Each level is a blocked filter: a key sets a few bits in one 64-bit word, so a probe reads one
word. Words are built with aggregates over the keys and read back as scalar subqueries.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitree.llm.shared import materialize

#: Bits set for a key, and keys for which a word is provided.
BITS, KEYS_A_WORD = 4, 8
#: A cascade that needs more levels than this has met keys that no hash tells apart.
MAX_LEVELS = 64


@dataclass(frozen=True)
class Level:
    """One filter: its number from 1 on, its words in all, and the table (word, bits) of those in use."""

    number: int
    words: int
    table: DataFrame

    def word_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(2 * self.number), key), F.lit(self.words))

    def mask_of(self, key: Column) -> Column:
        mixed = F.xxhash64(F.lit(2 * self.number + 1), key)
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(mixed, 6 * i).bitwiseAND(63).cast("int")) for i in range(BITS)]
        return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])

    def block(self, lo: int, hi: int) -> Column:
        """Words lo..hi-1 as one array, by a subquery that runs once."""
        spark = self.table.sparkSession
        every = spark.range(lo, hi).withColumnRenamed("id", "word").join(self.table, "word", "left")
        return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda w: w["bits"])).scalar()


def _level(number: int, keys: DataFrame, n: int) -> Level:
    level = Level(number, max(1, -(-n // KEYS_A_WORD)), keys)
    bits = keys.select(level.word_of(F.col("key")).alias("word"), level.mask_of(F.col("key")).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    return Level(number, level.words, materialize(bits, "filter"))


class Cascade:
    """The filters over a universe; they judge any rows whose non-null keys are in it."""

    def __init__(self, levels: list[Level], block_words: int):
        self.levels = levels
        self.block_words = block_words

    @property
    def words(self) -> int:
        return sum(level.words for level in self.levels)

    def listed(self, rows: DataFrame, name: str) -> DataFrame:
        """Keeps of the array column ``name`` the keys that are listed, in their order; nulls go.

        If all filters together exceed the block size (words that a task may hold), the rows pass
        over the filters block by block and remember the first level that refused a key, so memory
        stays bounded and the answer exact."""
        columns = rows.columns
        last = len(self.levels) + 1
        if self.words > self.block_words:
            rows = rows.withColumn(name, F.transform(name, lambda k: F.struct(k.alias("key"), F.lit(None).cast("int").alias("first"))))
            for level in self.levels:
                for lo in range(0, level.words, self.block_words):
                    hi = min(level.words, lo + self.block_words)
                    held = rows.withColumn("_block", level.block(lo, hi))
                    step = lambda k: F.coalesce(k["first"], F.when(refused(level, F.col("_block"), lo, k["key"]), level.number))  # noqa: B023, E731
                    rows = materialize(held.withColumn(name, F.transform(name, lambda k: F.struct(k["key"].alias("key"), step(k).alias("first")))).drop("_block"), "probed")  # noqa: B023
            found = F.transform(F.filter(name, lambda k: k["key"].isNotNull() & (F.coalesce(k["first"], F.lit(last)) % 2 == 0)), lambda k: k["key"])
            return rows.withColumn(name, found).select(columns)
        held = rows.select("*", *(level.block(0, level.words).alias(f"_block{level.number}") for level in self.levels))

        def judge(key: Column) -> Column:
            verdict = F.lit(last % 2 == 0)
            for level in reversed(self.levels):
                verdict = F.when(refused(level, F.col(f"_block{level.number}"), 0, key), F.lit(level.number % 2 == 0)).otherwise(verdict)
            return key.isNotNull() & verdict

        return held.withColumn(name, F.filter(name, judge)).select(columns)


def refused(level: Level, block: Column, lo: int, key: Column) -> Column:
    """Whether a level does not take a key; null if its word lies outside the block that starts at lo."""
    mask = level.mask_of(key)
    return F.get(block, (level.word_of(key) - lo).cast("int")).bitwiseAND(mask) != mask


def build_cascade(universe: DataFrame, block_words: int = 1 << 20) -> Cascade:
    """Cascade over a universe (key string, listed boolean) of distinct non-null keys.

    Each level reads only what the two levels before left open, so the passes shrink
    geometrically. ``block_words`` bounds the words (of 8 bytes) that a task holds. No listed key
    makes an empty cascade, which lists nothing."""
    own = universe.where("listed").select("key")
    other = universe.where("not listed").select("key")
    levels: list[Level] = []
    while n := own.count():
        if len(levels) >= MAX_LEVELS:
            raise ValueError(f"{n} keys of the cascade can't be told apart")
        level = _level(len(levels) + 1, own, n)
        levels.append(level)
        own, other = materialize(_passing(level, other, block_words), "taken"), own
    return Cascade(levels, block_words)


def _passing(level: Level, keys: DataFrame, block_words: int) -> DataFrame:
    """Keys that a level takes."""
    parts = [keys.where(~refused(level, level.block(lo, min(level.words, lo + block_words)), lo, F.col("key"))) for lo in range(0, level.words, block_words)]
    return reduce(DataFrame.union, parts)
