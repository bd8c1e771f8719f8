"""Overlap joins of boxes, and thinning to objects that don't overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitree.storage import materialize

Box = Callable[[str], list[tuple[Column, Column]]]
#: Levels of size that are told apart; smaller boxes share the finest.
MAX_LEVELS = 24
#: Overlaps that one task of a thinning round settles, about.
BLOCK_EDGES = 200_000
#: Objects that are thinned first, and how many times as many the first ids hold in each further step.
FIRST_OBJECTS, GROWTH = 50_000, 4


@dataclass(frozen=True)
class Centred:
    """Boxes by a column for the centre and one for the width of each axis. Two of them overlap where the centres' distance is at
    most half the sum of the widths; ends would round boxes that touch to either side."""

    axes: tuple[tuple[str, str], ...]

    def __call__(self, prefix: str) -> list[tuple[Column, Column]]:
        return [(F.col(prefix + c) - F.col(prefix + s) / 2, F.col(prefix + c) + F.col(prefix + s) / 2) for c, s in self.axes]


#: Axis-aligned boxes of squares around their centres, and of cuboids; the prefix names the side of the join.
square_boxes = Centred((("x0", "size"), ("y0", "size")))
cuboid_boxes = Centred((("x0", "w"), ("y0", "h"), ("z0", "d")))


def _carried(objects: DataFrame, box: Box) -> DataFrame:
    """object_id and two columns an axis, p and q: centre and width, or the ends. Objects with a null side are left out."""
    sides = [(F.col(c), F.col(s)) for c, s in box.axes] if isinstance(box, Centred) else box("")
    names = [(f"p{i}", f"q{i}") for i in range(len(sides))]
    rows = objects.select("object_id", *(v.alias(n) for name, side in zip(names, sides) for n, v in zip(name, side)))
    return rows.where(" and ".join(f"{n} is not null" for name in names for n in name))


def _ends_of(box: Box, i: int, prefix: str = "") -> tuple[Column, Column]:
    """The ends of axis i; those of centred boxes are moved out by far more than they are rounded, so boxes that touch share a cell."""
    p, q = F.col(f"{prefix}p{i}"), F.col(f"{prefix}q{i}")
    if not isinstance(box, Centred):
        return p, q
    more = (F.abs(p) + F.abs(q)) * 1e-12
    return p - q / 2 - more, p + q / 2 + more


def _levelled(rows: DataFrame, box: Box, dim: int) -> tuple[DataFrame, list[int]]:
    """Rows with the level of their own size, and the levels in use."""
    wide = F.greatest(*(F.col(f"q{i}") - (F.lit(0.0) if isinstance(box, Centred) else F.col(f"p{i}")) for i in range(dim)), F.lit(0.0))
    rows = rows.withColumn("level", F.when(wide > 0, F.ceil(F.log2(F.when(wide > 0, wide)))).cast("int"))
    span = rows.agg(F.min("level"), F.max("level")).first()
    top = 0 if span[1] is None else span[1]
    least = top if span[0] is None else max(span[0], top - MAX_LEVELS)
    rows = rows.withColumn("level", F.greatest(F.coalesce("level", F.lit(least)), F.lit(least)))
    return rows, sorted(r.level for r in rows.select("level").distinct().collect()) or [0]  # at most MAX_LEVELS + 1 numbers


def _dealt(rows: DataFrame, box: Box, dim: int, used: list[int] | None) -> DataFrame:
    """Rows once for each of their cells, (at, c0, c1, ...), of their own level, or of all levels in use from their own on."""
    at = F.col("level") if used is None else F.explode(F.filter(F.array(*(F.lit(v) for v in used)), lambda v: v >= F.col("level")))
    rows = rows.withColumn("at", at)
    scale = F.pow(F.lit(2.0), -F.col("at"))
    for i in range(dim):
        lo, hi = _ends_of(box, i)
        rows = rows.withColumn(f"c{i}", F.explode(F.sequence(F.floor(lo * scale), F.floor(hi * scale))))
    return rows


def _met(held: DataFrame, asking: DataFrame, box: Box, dim: int, used: list[int], order: bool) -> DataFrame:
    """(a, b): overlaps of held objects a with asking ones b of at most their level; of one level only a < b with ``order``, else all."""
    cells = ["at", *(f"c{i}" for i in range(dim))]
    names = [f"{n}{i}" for i in range(dim) for n in "pq"]
    side = lambda rows, name: rows.select(F.col("object_id").alias(name), "level" if name == "b" else F.lit(True).alias("held"), *cells, *(F.col(n).alias(f"{name}_{n}") for n in names))
    met = side(_dealt(held, box, dim, None), "a").join(side(_dealt(asking, box, dim, used), "b"), cells)
    met = met.where("level < at or a < b") if order else met
    for i in range(dim):
        (a_lo, a_hi), (b_lo, b_hi) = _ends_of(box, i, "a_"), _ends_of(box, i, "b_")
        scale = F.pow(F.lit(2.0), -F.col("at"))
        met = met.where(F.col(f"c{i}") == F.greatest(F.floor(a_lo * scale), F.floor(b_lo * scale)))
        if isinstance(box, Centred):
            met = met.where(F.abs(F.col(f"a_p{i}") - F.col(f"b_p{i}")) <= (F.col(f"a_q{i}") + F.col(f"b_q{i}")) / 2)
        else:
            met = met.where((a_lo <= b_hi) & (b_lo <= a_hi))
    return met.select("a", "b")


def overlap_join(objects: DataFrame, box: Box) -> DataFrame:
    """(a, b), a < b: ids of objects whose closed boxes overlap. Objects with a null side are left out.

    A box is dealt to the cells of the level of its own size, whose width is the power of two at or
    above its largest side, so it lies in few cells. It also asks in its cells of every
    coarser level that is in use, where larger boxes live; so one large box is compared
    with the boxes of its few cells and changes nothing for the others. A pair that meets in
    several cells counts in the first one it shares."""
    dim = len(box(""))
    rows, used = _levelled(_carried(objects, box), box, dim)
    return _met(rows, rows, box, dim, used, True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def overlapping(objects: DataFrame, others: DataFrame, box: Box) -> DataFrame:
    """(object_id): objects that overlap one of other objects. Only ids move on, so of the overlaps nothing is written."""
    dim = len(box(""))
    mark = lambda df, v: _carried(df, box).withColumn("other", F.lit(v))
    rows, used = _levelled(mark(objects, False).unionByName(mark(others, True)), box, dim)
    own, rest = rows.where("!other"), rows.where("other")
    found = _met(rest, own, box, dim, used, False).select("b").union(_met(own, rest, box, dim, used, False).select("a"))
    return found.distinct().withColumnRenamed("b", "object_id")


def intersects_any(objects: DataFrame, box: Box) -> DataFrame:
    """Objects that overlap another one."""
    pairs = overlap_join(objects, box)
    ids = pairs.select(F.col("a").alias("object_id")).union(pairs.select("b")).distinct()
    return objects.join(ids, "object_id", "left_semi")


def thin_non_overlapping(objects: DataFrame, box: Box, block_edges: int = BLOCK_EDGES, first: int = FIRST_OBJECTS) -> DataFrame:
    """(object_id): objects kept when candidates come in id order and one that overlaps a kept one is refused.

    That is the first maximal independent set of the overlap graph. The ``first`` objects by id are settled, then ``GROWTH`` times as
    many, and so on: what overlaps a kept object is refused before overlaps are listed, so where objects are dense
    few overlaps are left to write; their number follows the objects, not its square."""
    n = objects.count()
    shares = []
    while first < n:
        shares.append(first / n)
        first *= GROWTH
    cuts = objects.select(F.percentile_approx("object_id", shares, 10_000)).first()[0] if shares else []
    kept, after = None, None
    for upto in [*sorted(set(cuts)), None]:
        part = objects if after is None else objects.where(F.col("object_id") > after)
        part = part if upto is None else part.where(F.col("object_id") <= upto)
        if kept is not None:
            part = materialize(part.join(overlapping(part, kept, box), "object_id", "left_anti").select(objects.columns), "open")
        won = _thin(part, box, block_edges)
        if upto is None:
            return won if kept is None else kept.select("object_id").union(won)
        won = materialize(part.join(won, "object_id", "left_semi").select(objects.columns), "won")
        kept = won if kept is None else kept.union(won)
        after = upto
    return kept


def _thin(objects: DataFrame, box: Box, block_edges: int) -> DataFrame:
    """The objects that are kept, of one step. In rounds, the undecided objects are cut
    into blocks of neighbours along one axis after the other, at quantiles, with about ``block_edges`` overlaps
    each. A task settles its block in id order as far as that doesn't hang on an undecided object of
    another block; then the blocks exchange what they decided. So a component within one block takes one round,
    and a chain as many as blocks lie along it. An object that overlaps more than ``block_edges`` earlier ones
    enters no block: it is refused when one of them is kept, and kept when all are refused."""
    sides = box("")
    names = [f"p{i}" for i in range(len(sides))]
    place = objects.select(F.col("object_id").alias("b"), *(lo.cast("double").alias(n) for n, (lo, _) in zip(names, sides)))
    edges = materialize(overlap_join(objects, box).join(place, "b").select("a", "b", *names), "overlaps")
    crowded = materialize(edges.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > block_edges).select("b"), "crowded")
    kept = materialize(objects.select("object_id").join(_ends(edges, "b"), "object_id", "left_anti"), "kept")
    kind = objects.schema["object_id"].dataType.simpleString()
    for turn in count():
        n = edges.count()
        if not n:
            return kept
        waiting = _ends(edges, "b")
        known = edges.join(waiting.select(F.col("object_id").alias("a"), F.lit(True).alias("open")), "a", "left").withColumn("first", F.col("open").isNull())
        order = [*names[turn % len(names) :], *names[: turn % len(names)], "b"]
        blocks = known.join(crowded, "b", "left_anti").repartitionByRange(-(-n // block_edges), *order)
        decided = materialize(blocks.select("a", "b", "first").mapInPandas(_settle, f"object_id {kind}, kept boolean"), "decided")
        won = decided.where("kept").select("object_id")
        beside = known.join(won.withColumnRenamed("object_id", "a"), "a", "left_semi").union(known.where("first"))
        lost = materialize(decided.where("!kept").select("object_id").union(_ends(beside, "b")).distinct(), "lost")
        settled = won.union(lost).withColumnRenamed("object_id", "b")
        edges = materialize(edges.join(settled, "b", "left_anti").join(lost.withColumnRenamed("object_id", "a"), "a", "left_anti").select("a", "b", *names), "overlaps")
        free = waiting.join(settled.union(_ends(edges, "b")), F.col("object_id") == F.col("b"), "left_anti")
        kept = kept.union(materialize(won.union(free), "kept"))


def _ends(edges: DataFrame, side: str) -> DataFrame:
    return edges.select(F.col(side).alias("object_id")).distinct()


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(object_id, kept) of what a block decides by itself, from all overlaps (a, b) of its objects b with
    undecided earlier ones; ``first`` marks an a without earlier ones, which is kept."""
    parts = [pdf for pdf in batches if len(pdf)]
    if not parts:
        return
    rows = pd.concat(parts).sort_values(["b", "a"])
    a, b, first = rows["a"].tolist(), rows["b"].tolist(), rows["first"].tolist()
    starts = np.flatnonzero(np.append(True, rows["b"].to_numpy()[1:] != rows["b"].to_numpy()[:-1])).tolist()
    state: dict = {}
    for start, end in zip(starts, [*starts[1:], len(b)]):
        seen = [True if first[i] else state.get(a[i]) for i in range(start, end)]
        if True in seen:
            state[b[start]] = False
        elif None not in seen:
            state[b[start]] = True
    yield pd.DataFrame({"object_id": list(state), "kept": list(state.values())})


def ranked(kept: DataFrame, id_col: str = "object_id", slices: int = 256) -> DataFrame:
    """A global rank by id without one window over all rows: counts of id ranges, then ranks within.
    The ranges are cut at quantiles, so sparse or clustered ids fill them alike."""
    cuts = kept.select(F.percentile_approx(id_col, [i / slices for i in range(1, slices)], 100 * slices)).first()[0] or []
    bounds = sorted(set(cuts))
    slice_ = F.lit(len(bounds))
    if bounds:
        after = F.array_position(F.transform(F.array(*(F.lit(v) for v in bounds)), lambda v: F.col(id_col) <= v), F.lit(True))
        slice_ = F.when(after == 0, len(bounds)).otherwise(after - 1)
    parts = kept.withColumn("slice", slice_.cast("int"))
    base = parts.groupBy("slice").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.withColumn("inside", F.row_number().over(Window.partitionBy("slice").orderBy(id_col))).join(base.select("slice", "base"), "slice").withColumn("rank", (F.col("base") + F.col("inside")).cast("long")).drop("slice", "inside", "base")


def stop_after_rejects(objects: DataFrame, kept: DataFrame, share: float = 0.05) -> DataFrame:
    """Kept objects up to the first run of ``share`` * n refused candidates in a row.

    A refused candidate's run is named by the number of kept ones before it, which ``ranked``
    gives as the difference of two ranks."""
    all_ = ranked(objects.select("object_id"))
    own = ranked(kept.select("object_id")).withColumnRenamed("rank", "kept_rank")
    runs = all_.join(own, "object_id").select("object_id", "rank", "kept_rank").withColumn("lead_", F.col("rank") - F.col("kept_rank"))
    step = runs.select((F.col("kept_rank") + 1).alias("kept_rank"), F.col("lead_").alias("before"))
    limit = F.greatest(F.lit(1), F.floor(F.lit(share) * objects.count()))
    gaps = runs.join(step, "kept_rank", "left").where(F.col("lead_") - F.coalesce("before", F.lit(0)) >= limit)
    stop = gaps.agg(F.min("object_id").alias("stop"))
    return kept.join(F.broadcast(stop)).where("stop is null or object_id < stop").select("object_id")
