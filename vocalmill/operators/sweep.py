"""Best overlaps and stabbing without pairs (J1, J2, J14): what each item needs from its spans in logarithmic steps.

A join gives every pair of an item and a span that meet, so a stretch in which all overlap all is quadratic.  Here an item is
filed under the cell in which it starts, of a size that it can't pass by more than one cell, and a span under every cell
that it meets and the one before.  Longer items have wider cells, in steps so small that no cell is much wider than its
items, the longest one for a recording.  Spans of cells without items are dropped as they come.  A task sorts its cells and answers all their items at once from merge-sort trees over the spans: the places of a
prefix (by start or end) fall into blocks of doubling size, and in a block sorted by the other end one search finds the best.
A span is, for an item, one of four things: it covers the item, lies inside it, or reaches over its start or its end; each
has one such question.  The number of speakers is that of their merged spans that meet the item, less the gaps between two
such spans of one speaker that lie inside it.

Time is n log**2 n in the rows of a task, memory in proportion to a cell.  Times are whole milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

CELL_MS = 600_000
#: How many times wider the cells of longer items are, and how many widths there are before a cell is the recording.
WIDER, WIDTHS = 8, 4
#: Rows that are answered at once, where cells are small.
CHUNK = 200_000


class Tree:
    """Points in an order (``x``), by blocks of doubling size, each sorted by the rank of the points' ``y``.

    Sizes are gone through one after the other, each order merged from the one before, so memory is in proportion to the points.
    """

    def __init__(self, ranks: np.ndarray):
        self.n = len(ranks)
        self.top = max(1, self.n).bit_length()
        self.size = 1 << self.top
        self.ranks = np.concatenate((ranks, np.arange(self.n, self.size)))  # what fills up comes after all others

    def blocks(self, prefix: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The blocks that make up each prefix: (order of the points, level, questions, begin, place, end); from ``begin`` to ``place`` ranks are below ``rank``."""
        order = np.arange(self.size)
        for k in range(self.top):
            keys = (order >> k) * self.size + self.ranks[order]
            merged = np.argsort(keys, kind="stable")
            order, keys = order[merged], keys[merged]
            asked = np.flatnonzero(prefix >> k & 1)
            if len(asked):
                block = (prefix[asked] >> k) - 1
                begin = block << k
                place = np.searchsorted(keys, block * self.size + rank[asked])
                yield order, k, asked, begin, np.maximum(place, begin), begin + (1 << k)

    def along(self, order: np.ndarray, k: int, values: np.ndarray, fill: int) -> np.ndarray:
        """Values of the points in the order of level ``k``, a row a block."""
        padded = np.concatenate((values, np.full(self.size - self.n, fill, np.int64)))
        return padded[order].reshape(-1, 1 << k)

    def least(self, prefix: np.ndarray, rank: np.ndarray, *asks: tuple[str, np.ndarray, int]) -> list[np.ndarray]:
        """For each of ``asks`` (side, values, none) the least value among the points of a prefix, with at least this rank (side ``from``) or a lower one (``below``)."""
        outs = [np.full(len(prefix), none, np.int64) for _, _, none in asks]
        for order, k, asked, begin, place, end in self.blocks(prefix, rank):
            for out, (side, values, none) in zip(outs, asks, strict=True):
                rows = self.along(order, k, values, none)
                if side == "from":
                    rows = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
                    found = np.where(place < end, rows[np.minimum(place, self.size - 1)], none)
                else:
                    rows = np.minimum.accumulate(rows, axis=1).ravel()
                    found = np.where(place > begin, rows[np.maximum(place - 1, 0)], none)
                out[asked] = np.minimum(out[asked], found)
        return outs

    def count_below(self, prefix: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many points of a prefix have a lower rank."""
        out = np.zeros(len(prefix), np.int64)
        for _, _, asked, begin, place, _ in self.blocks(prefix, rank):
            out[asked] += place - begin
        return out


def ranked(*columns: np.ndarray) -> np.ndarray:
    """The rank of each row, by the first column, then the next."""
    order = np.lexsort(columns[::-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def best(start: np.ndarray, end: np.ndarray, idx: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item [a, b) the span with the longest overlap, the least ``idx`` on ties (-1: none), and the overlap."""
    n = len(start)
    if not n:
        return np.full(len(a), -1), np.zeros(len(a), np.int64)
    own = ranked(idx, start, end)
    by_own = np.argsort(own)
    by_start, by_end = np.argsort(start, kind="stable"), np.argsort(end, kind="stable")
    starts, ends = start[by_start], end[by_end]
    # of equal ends the least idx comes last, so the greatest rank is the best; of equal starts it comes first
    rank_end, rank_start = ranked(end, -own), ranked(start, own)
    at_end, at_start = np.argsort(rank_end), np.argsort(rank_start)
    length = ranked(start - end, own)
    at_length = np.argsort(length)
    begun = np.searchsorted(starts, a, side="right")
    upto = np.searchsorted(ends, b)  # ends before b
    tree = Tree(rank_end[by_start])
    cover, left = tree.least(begun, upto, ("from", own[by_start], n), ("below", -rank_end[by_start], 1))
    left = -left
    (inside,) = Tree(rank_end[by_start[::-1]]).least(n - np.searchsorted(starts, a), np.searchsorted(ends, b, side="right"), ("below", length[by_start[::-1]], n))
    after = np.searchsorted(starts, a, side="right")
    (right,) = Tree(rank_start[by_end[::-1]]).least(n - np.searchsorted(ends, b, side="right"), after, ("from", rank_start[by_end[::-1]], n))
    found, most = np.full(len(a), -1), np.zeros(len(a), np.int64)
    none = -1
    for span in (
        np.where(cover < n, by_own[np.minimum(cover, n - 1)], none), np.where(left >= 0, at_end[np.maximum(left, 0)], none),
        np.where(inside < n, at_length[np.minimum(inside, n - 1)], none), np.where(right < n, at_start[np.minimum(right, n - 1)], none),
    ):
        overlap = np.where(span >= 0, np.minimum(b, end[span]) - np.maximum(a, start[span]), 0)
        better = (overlap > most) | ((overlap == most) & (overlap > 0) & (own[span] < own[found]))
        found, most = np.where(better, span, found), np.where(better, overlap, most)
    return found, most


def speakers(start: np.ndarray, end: np.ndarray, who: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each item [a, b) how many of the spans' numbered speakers it meets; ``who`` below 0 doesn't count."""
    keep = who >= 0
    start, end, who = start[keep], end[keep], who[keep]
    if not len(start):
        return np.zeros(len(a), np.int64)
    order = np.lexsort((start, who))
    start, end, who = start[order], end[order], who[order]
    width = int(end.max()) - int(start.min()) + 1
    reach = np.maximum.accumulate((end - start.min()) + who * width) - who * width + start.min()  # of one speaker so far
    fresh = np.concatenate(([True], (who[1:] != who[:-1]) | (start[1:] > reach[:-1])))
    first = np.flatnonzero(fresh)
    s, e, w = start[first], reach[np.concatenate((first[1:], [len(start)])) - 1], who[first]
    meet = np.searchsorted(np.sort(s), b) - np.searchsorted(np.sort(e), a, side="right")
    inner = np.flatnonzero(w[1:] == w[:-1])
    gap_from, gap_to = e[inner], s[inner + 1]
    by_to = np.argsort(gap_to, kind="stable")
    before = np.searchsorted(gap_to[by_to], b)
    gaps = before - Tree(ranked(gap_from)[by_to]).count_below(before, np.searchsorted(np.sort(gap_from), a, side="right")) if len(inner) else 0
    return np.where(b > a, np.maximum(meet - gaps, 0), 0)


def _level(length: Column, cell_ms: int) -> Column:
    """The first level whose cells an item of this length can't pass by more than one."""
    out = F.lit(WIDTHS)
    for k in reversed(range(WIDTHS)):
        out = F.when(length <= cell_ms * WIDER**k, k).otherwise(out)
    return out


def _filed(items: DataFrame, spans: DataFrame, columns: list[str], key: str, cell_ms: int, longest_ms: int | None, look: bool) -> DataFrame:
    """Items and spans in one table, by cells (``__what`` 1 and 0)."""
    width = lambda level: F.pow(F.lit(float(WIDER)), level) * cell_ms
    place = lambda t, level: F.when(level < WIDTHS, F.floor(t / width(level))).otherwise(0).cast("bigint")
    a, b = F.col("start_ms").cast("bigint"), F.col("end_ms").cast("bigint")
    level = _level(b - a, cell_ms)
    own = items.select(F.col(key).alias("__key"), level.alias("__level"), place(a, level).alias("__cell"), F.lit(1).alias("__what"), a.alias("__a"), b.alias("__b"), F.lit(None).cast("bigint").alias("__idx"), F.lit(None).cast("string").alias("__who"), F.struct(*columns).alias("__item"))
    if look:
        used = F.broadcast(items.select(level.alias("__level")).distinct())  # a few numbers
    else:
        widest = next((k for k in range(WIDTHS) if longest_ms is not None and longest_ms <= cell_ms * WIDER**k), WIDTHS)
        used = items.sparkSession.range(widest + 1).select(F.col("id").cast("int").alias("__level"))
    first = lambda level: F.when(level < WIDTHS, place(a, level) - 1).otherwise(0).cast("bigint")
    cells = F.sequence(first(F.col("__level")), place(b - 1, F.col("__level")))
    real = spans.where("end_ms > start_ms").where(F.col(key).isNotNull()).select(key, "start_ms", "end_ms", "idx", "speaker").crossJoin(F.broadcast(used)).withColumn("__cell", F.explode(cells))
    there = real.select(F.col(key).alias("__key"), "__level", "__cell", F.lit(0).alias("__what"), a.alias("__a"), b.alias("__b"), F.col("idx").cast("bigint").alias("__idx"), F.col("speaker").alias("__who"), F.lit(None).cast(own.schema["__item"].dataType).alias("__item"))
    return there.unionByName(own)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole cells, as many at a time as make up a chunk."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= CHUNK:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(_fresh_cells(table)[-1])
            if cut:
                yield table.slice(0, cut).combine_chunks()
                table = table.slice(cut).combine_chunks()
            if table.column("__what")[0].as_py() == 0:  # items come first: a cell without any, of which one row stays as its mark
                table, cut = table.slice(0, 1).combine_chunks(), 1
            held, rows = table.to_batches(), 0 if cut else -rows  # a cell larger than a chunk: look again after as many rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _fresh_cells(table: pa.Table) -> np.ndarray:
    """Where cells begin."""
    n = table.num_rows
    new = np.ones(n, bool)
    if n > 1:
        same = np.ones(n - 1, bool)
        for name in ("__key", "__level", "__cell"):
            c = table.column(name).combine_chunks()
            a, b = c.slice(1), c.slice(0, n - 1)
            same &= pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
        new[1:] = ~same
    return np.flatnonzero(new)


def best_overlap(items: DataFrame, spans: DataFrame, item_cols: list[str], key: str = "interview_id", cell_ms: int = CELL_MS, outer: bool = False, longest_ms: int | None = None, look: bool = False) -> DataFrame:
    """For each item that overlaps a span (with ``outer``, for each item): ``best_speaker``, that of the longest
    overlap, ties to the first span, null if it has none; ``overlap_ms``; ``n_speakers``, distinct non-empty ones.

    One row an item, with key and ``item_cols``.  A null key meets nothing.  Spans are filed for each width of cells; where no
    item is longer than ``longest_ms``, only for those that such items have, and with ``look`` for those that the items
    do have, at the price of a pass over their times.
    """
    spark = items.sparkSession
    ship(spark)
    columns = list(dict.fromkeys((key, *item_cols)))
    filed = _filed(items, spans, columns, key, cell_ms, longest_ms, look)
    item_type = filed.schema["__item"].dataType
    schema = f"item {item_type.simpleString()}, best_speaker string, overlap_ms bigint, n_speakers bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            a, b, what = (table.column(c).to_numpy() for c in ("__a", "__b", "__what"))
            cells = _fresh_cells(table)
            sizes = np.diff(np.concatenate((cells, [table.num_rows])))
            low, high = np.minimum.reduceat(np.minimum(a, b), cells), np.maximum.reduceat(np.maximum(a, b), cells)
            room = high - low + 2
            shift = np.repeat(np.concatenate(([0], np.cumsum(room)[:-1])) - low, sizes)  # cells side by side, apart
            a, b = a + shift, b + shift
            span, item = np.flatnonzero(what == 0), np.flatnonzero(what == 1)
            if not len(item):
                continue
            who = table.column("__who").combine_chunks().take(pa.array(span))
            names = who.dictionary_encode()
            shown = np.array([bool(x and x.strip(" ")) for x in names.dictionary.to_pylist()] + [False])
            trimmed = {x: k for k, x in enumerate(dict.fromkeys((x or "").strip(" ") for x in names.dictionary.to_pylist()))}
            code = np.array([trimmed[(x or "").strip(" ")] for x in names.dictionary.to_pylist()] + [0], np.int64)
            at = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False)
            found, most = best(a[span], b[span], table.column("__idx").to_numpy()[span], a[item], b[item])
            number = speakers(a[span], b[span], np.where(shown[at], code[at], -1), a[item], b[item])
            chosen = who.take(pa.array(found, mask=found < 0)) if len(span) else pa.nulls(len(item), pa.string())
            out = pa.table({"item": table.column("__item").take(pa.array(item)), "best_speaker": chosen, "overlap_ms": pa.array(most, mask=found < 0), "n_speakers": pa.array(number)})
            yield from (out if outer else out.filter(pa.array(found >= 0))).combine_chunks().to_batches()

    cells = ["__key", "__level", "__cell"]
    dealt = filed.repartition(*cells).sortWithinPartitions(*cells, F.col("__what").desc())
    return dealt.mapInArrow(run, schema).select(*(F.col(f"item.{c}").alias(c) for c in columns), F.nullif("best_speaker", F.lit("")).alias("best_speaker"), "overlap_ms", "n_speakers")


def stab(points: DataFrame, turns: DataFrame, key: str = "interview_id", at: str = "at_ms", cell_ms: int = CELL_MS) -> DataFrame:
    """For each point in time the first turn (least number) with start <= t < end; null without one."""
    ship(points.sparkSession)
    columns = points.columns
    items = points.withColumns({"start_ms": F.col(at), "end_ms": F.col(at) + 1})
    spans = turns.select(key, F.col("turn").alias("idx"), "start_ms", "end_ms", F.col("turn").cast("string").alias("speaker"))
    # a point is a stretch of one millisecond, which a turn covers or doesn't meet
    found = best_overlap(items, spans, columns, key, cell_ms, outer=True, longest_ms=1)
    return found.select(*columns, F.col("best_speaker").cast(turns.schema["turn"].dataType).alias("turn"))
