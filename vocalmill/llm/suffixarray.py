"""A suffix array of a distributed sequence of line ids, and what repeats in it.

Positions of the sequence are whole numbers; a gap of one number ends a document, so no suffix runs into the next.
Ranks come by prefix doubling: suffixes are ordered by their first line, then by the pair of the ranks at p and at
p + 2**k, until every group of equal ranks has one suffix.  A suffix keeps the places of its group: its new rank is the
old one and the number of the group's suffixes that come before.  Each round is a look-up by position and a sort by
ranges of (rank, second rank, position), so a line that a third of all documents have is dealt over many tasks.  Lines
that occur once can't begin a repeat and are left out from the start; what follows the end of a document, or such a
line, differs from everything.

Neighbours in the suffix array have a longest common prefix.  It is found for the first pair of each chain (p, q),
(p + 1, q + 1) ... of equal lines by adding powers of two from the largest down, the others of the chain have one line
less each.  The longest earlier copy of the suffix at p is then the greatest common prefix with a suffix at a lesser
position: the nearest of those in the array on either side, by a scan with a stack.  Scans run over slices of the array,
and what a slice hands to the next is a stack of few numbers: at most as many as there are distinct prefix lengths at
its edge.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C


#: Rows for which a round takes another task; what is left of the sequence shrinks from round to round.
TASK_ROWS = 100_000


@dataclass
class Ranks:
    """Each level k of doubling as a table (pos, rank): the positions whose block of 2**k lines is repeated; and the
    final rank of every position with a repeated line, with ``level``, the last k at which it was repeated."""

    levels: list[DataFrame]
    final: DataFrame
    size: int
    parts: int


def _by_number(values: list, number: str, kind: str = "bigint"):
    """The value of a short list at the place that a column of small numbers names; a constant of the plan."""
    return F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.col(number))


def _group_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, pos) in order: their place in the partition, and the places at which their groups of equal a, and of
    equal (a, b), begin; ``several`` if the row before or after is of the same group."""
    pid, count, start_a, start_b = TaskContext.get().partitionId(), 0, 0, 0
    before = held = None

    def out(columns: list[np.ndarray], several: np.ndarray) -> pa.RecordBatch:
        pos, a, b, at, ga, gb = columns
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), pid, np.int32)), *map(pa.array, (pos, a, b, at, ga, gb)), pa.array(several)], names=["pid", "pos", "a", "b", "at", "ga", "gb", "several"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a, b, pos = (batch.column(k).to_numpy() for k in range(3))
        new_a, new_b = np.ones(n, bool), np.ones(n, bool)
        new_a[1:] = a[1:] != a[:-1]
        new_b[1:] = new_a[1:] | (b[1:] != b[:-1])
        if before is not None:
            new_a[0] = before[0] != a[0]
            new_b[0] = new_a[0] or before[1] != b[0]
        at = count + np.arange(n)
        ga = np.maximum(np.maximum.accumulate(np.where(new_a, at, 0)), start_a)
        gb = np.maximum(np.maximum.accumulate(np.where(new_b, at, 0)), start_b)
        if held is not None:
            yield out(held, np.array([held_several or not new_b[0]]))
        several = ~new_b
        several[:-1] |= ~new_b[1:]
        columns = [pos, a, b, at, ga, gb]
        if n > 1:
            yield out([c[:-1] for c in columns], several[:-1])
        held, held_several = [c[-1:] for c in columns], bool(several[-1])
        before, count, start_a, start_b = (a[-1], b[-1]), count + n, int(ga[-1]), int(gb[-1])
    if held is not None:
        yield out(held, np.array([held_several]))


_SCANNED = "pid int, pos bigint, a bigint, b bigint, at bigint, ga bigint, gb bigint, several boolean"


def _ordered(rows: DataFrame, parts: int, first: bool) -> tuple[DataFrame, int, int]:
    """(pos, rank, several) of rows (a, b, pos); rows of equal (a, b) have equal ranks.  And the number of rows, and of
    those with ``several``.  The driver sees a row for each partition."""
    sorted_ = rows.select("a", "b", "pos").repartitionByRange(parts, "a", "b", "pos").sortWithinPartitions("a", "b", "pos")
    table = C.materialize(sorted_.mapInArrow(_group_scan, _SCANNED), "ordered")
    edge = F.struct("at", "a", "b", "ga", "gb", "several")
    stats = table.groupBy("pid").agg(F.count("*").alias("n"), F.min(edge).alias("head"), F.max(edge).alias("tail"), F.count_if("several").alias("m")).collect()
    many = max((r.pid for r in stats), default=0) + 1
    bases, from_as, from_bs, last_at, head_joined, tail_joined = ([0] * many for _ in range(6))
    base, repeated, last = 0, 0, None
    for r in sorted(stats, key=lambda r: r.pid):
        same_a = last is not None and last[0] == r.head.a
        same_b = same_a and last[1] == r.head.b
        bases[r.pid], last_at[r.pid] = base, r.n - 1
        from_as[r.pid], from_bs[r.pid] = (last[2] if same_a else base), (last[3] if same_b else base)
        if same_b:  # a group goes on here: its rows on either side of the edge are not alone
            pid, tail, joined = last[4:]
            repeated += not (tail.several or joined)
            tail_joined[pid] = 1
            repeated += not r.head.several
            head_joined[r.pid] = 1
        tail_a = from_as[r.pid] if r.tail.ga == 0 else base + r.tail.ga
        tail_b = from_bs[r.pid] if r.tail.gb == 0 else base + r.tail.gb
        last = (r.tail.a, r.tail.b, tail_a, tail_b, r.pid, r.tail, same_b and r.n == 1)
        base += r.n
        repeated += r.m
    global_a = F.when(F.col("ga") == 0, _by_number(from_as, "pid")).otherwise(_by_number(bases, "pid") + F.col("ga"))
    global_b = F.when(F.col("gb") == 0, _by_number(from_bs, "pid")).otherwise(_by_number(bases, "pid") + F.col("gb"))
    joined = ((F.col("at") == 0) & (_by_number(head_joined, "pid") == 1)) | ((F.col("at") == _by_number(last_at, "pid")) & (_by_number(tail_joined, "pid") == 1))
    rank = global_b if first else F.col("a") + global_b - global_a
    return table.select("pos", rank.alias("rank"), (F.col("several") | joined).alias("several")), base, repeated


def suffix_ranks(lines: DataFrame, parts: int) -> Ranks:
    """Ranks of the suffixes of a sequence of lines (pos, h1, h2), whose two hashes are the line's id."""
    found, size, repeated = _ordered(lines.select(F.col("h1").alias("a"), F.col("h2").alias("b"), "pos"), parts, True)
    levels, settled, k = [found.where("several").select("pos", "rank")], [], 0
    most = tasks = max(1, min(parts, repeated // TASK_ROWS + 1))
    while repeated:
        width = 1 << k
        known = levels[-1]
        for s in settled:
            known = known.unionByName(s.select("pos", "rank"))
        after = known.select((F.col("pos") - width).alias("pos"), F.col("rank").alias("next"))
        pairs = levels[-1].join(after, "pos", "left").select(F.col("rank").alias("a"), F.coalesce("next", -1 - (F.col("pos") + width)).alias("b"), "pos")
        found, _, repeated = _ordered(pairs, tasks, False)
        tasks = max(1, min(parts, repeated // TASK_ROWS + 1))
        settled.append(found.where("NOT several").select("pos", "rank", F.lit(k).alias("level")))
        if repeated:
            levels.append(found.where("several").select("pos", "rank"))
        k += 1
    final = lines.select("pos").limit(0).select("pos", F.lit(0).cast("bigint").alias("rank"), F.lit(0).alias("level"))
    for s in settled:
        final = final.unionByName(s)
    return Ranks(levels, final, max(1, size), most)


def _sliced(rows: DataFrame, ranks: Ranks) -> DataFrame:
    """Rows with a ``rank`` in slices of the suffix array, each in order; the same slices every time."""
    width = -(-ranks.size // ranks.parts)
    return rows.withColumn("slice", F.floor(F.col("rank") / width).cast("int")).repartitionById(ranks.parts, F.col("slice")).sortWithinPartitions("slice", "rank")


def _neighbour_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slice, rank, pos, least, line) with the position and line of the row before in the slice (-1: none)."""
    last = (-1, -1, -1)
    for batch in batches:
        if batch.num_rows:
            pieces, pos, line = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(4).to_numpy()
            before = [np.concatenate(([x], c[:-1])) for x, c in zip(last, (pieces, pos, line), strict=True)]
            fresh = before[0] != pieces
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(fresh, -1, before[1])), pa.array(np.where(fresh, -1, before[2]))], names=["slice", "rank", "pos", "least", "line", "q", "q_line"])
            last = (pieces[-1], pos[-1], line[-1])


def _neighbours(candidates: DataFrame, ranks: Ranks) -> DataFrame:
    """Candidates with their neighbour before in the suffix array: ``q`` (-1 for the first) and whether the lines are equal."""
    schema = "slice int, rank bigint, pos bigint, least int, line bigint, q bigint, q_line bigint"
    table = C.materialize(_sliced(candidates, ranks).select("slice", "rank", "pos", "least", "line").mapInArrow(_neighbour_scan, schema), "neighbours")
    ends = table.groupBy("slice").agg(F.max_by(F.struct("pos", "line"), "rank").alias("e")).collect()  # a row a slice
    places, lines, last = [-1] * ranks.parts, [-1] * ranks.parts, None
    for r in sorted(ends, key=lambda r: r["slice"]):
        if last is not None:
            places[r["slice"]], lines[r["slice"]] = last.pos, last.line
        last = r.e
    q = F.when(F.col("q") >= 0, F.col("q")).otherwise(_by_number(places, "slice"))
    same = F.col("line") == F.when(F.col("q") >= 0, F.col("q_line")).otherwise(_by_number(lines, "slice"))
    return table.select("slice", "rank", "pos", "least", q.alias("q"), same.alias("same"))


def _chain_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pos, q, same, rank, least) by position: ``head`` is where their chain began, -1 where the lines differ."""
    last_pos, last_q, last_head = -5, -5, -1
    for batch in batches:
        n = batch.num_rows
        if n:
            pos, q, same = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            follows = np.empty(n, bool)
            follows[1:] = (pos[1:] == pos[:-1] + 1) & (q[1:] == q[:-1] + 1) & same[:-1]
            follows[0] = pos[0] == last_pos + 1 and q[0] == last_q + 1 and last_head >= 0
            starts = np.maximum.accumulate(np.where(~follows, np.arange(n), -1))
            head = np.where(starts < 0, last_head, pos[np.maximum(starts, 0)])
            # a chain's last pair has different lines: its prefix is 0, which the chain gives as well
            head = np.where(same | follows, head, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(head)], names=["pos", "q", "rank", "least", "head"])
            last_pos, last_q, last_head = pos[-1], q[-1], head[-1] if same[-1] else -1


def common_prefixes(candidates: DataFrame, ranks: Ranks) -> DataFrame:
    """(rank, pos, least, lcp): each candidate's common prefix, in lines, with the candidate before it in the suffix array."""
    pairs = _neighbours(candidates, ranks)
    by_place = pairs.select("pos", "q", "same", "rank", "least").repartitionByRange(ranks.parts, "pos").sortWithinPartitions("pos")
    chained = C.materialize(by_place.mapInArrow(_chain_scan, "pos bigint, q bigint, rank bigint, least int, head bigint"), "chains")
    heads = chained.where("head = pos").select(F.col("pos").alias("p"), "q", F.lit(0).cast("bigint").alias("l"))
    for k in range(len(ranks.levels) - 1, -1, -1):
        asked = heads.select("p", "q", "l", F.explode(F.array(F.col("p") + F.col("l"), F.col("q") + F.col("l"))).alias("pos"))
        met = asked.join(ranks.levels[k], "pos", "left").groupBy("p", "q", "l").agg((F.count("rank") == 2).alias("both"), (F.min("rank") == F.max("rank")).alias("equal"))
        heads = met.select("p", "q", (F.col("l") + F.when(F.col("both") & F.col("equal"), 1 << k).otherwise(0)).alias("l"))
    heads = C.materialize(heads.select(F.col("p").alias("head"), "l"), "heads")
    lcp = F.greatest(F.coalesce(F.col("l") - (F.col("pos") - F.col("head")), F.lit(0)), F.lit(0))
    return chained.join(heads, "head", "left").select("rank", "pos", "least", lcp.alias("lcp"))


class Stack:
    """Suffixes passed in one direction: positions, ascending, with the least common prefix since each, ascending."""

    def __init__(self, entries: list[tuple[int, int]] = ()):
        self.entries = list(entries)

    def edge(self, lcp: int) -> None:
        """An edge of the array with this common prefix is crossed; 0 parts everything."""
        if not lcp:
            self.entries.clear()
            return
        least = None
        while self.entries and self.entries[-1][1] >= lcp:
            least = self.entries.pop()[0]
        if least is not None:
            self.entries.append((least, lcp))

    def meet(self, pos: int, endless: int = 1 << 62) -> int:
        """The greatest common prefix of the suffix at ``pos`` with one before it that is at a lesser position; it is passed then."""
        while self.entries and self.entries[-1][0] > pos:
            self.entries.pop()
        found = self.entries[-1][1] if self.entries else 0
        self.entries.append((pos, endless))
        return found


def _walk(pos: list[int], edges: list[int], stack: Stack) -> tuple[list[int], int]:
    """Greatest prefixes with lesser positions on one side, and the least edge; ``edges[i]`` is crossed before ``pos[i]``."""
    out, least = [], 1 << 62
    for p, e in zip(pos, edges, strict=True):
        stack.edge(e)
        least = min(least, e)
        out.append(stack.meet(p))
    return out, least


def handed_on(given: list[tuple[int, int]], least: int, own: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stack after a slice: what came in, cut to the slice's least edge, under the slice's own stack."""
    below: list[tuple[int, int]] = []
    if least:
        for pos, lcp in given:
            lcp = min(lcp, least)
            if own and pos >= own[0][0]:
                break
            if not below or below[-1][1] < lcp:
                below.append((pos, lcp))
    return below + [e for e in own if not below or e[1] > below[-1][1] or e[0] < below[-1][0]]


def earlier_copies(prefixes: DataFrame, ranks: Ranks) -> DataFrame:
    """(pos, length): the longest run of lines from a position that also begins at a lesser position, where it has at
    least ``least`` lines.  Edges with fewer lines than that part the array."""
    table = C.materialize(prefixes.select("rank", "pos", F.when(F.col("lcp") >= F.col("least"), F.col("lcp")).otherwise(0).cast("bigint").alias("lcp")), "prefixes")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[int]]]:
        name, pos, lcp = None, [], []
        for batch in batches:
            pieces, p, e = (batch.column(k).to_numpy() for k in range(3))
            cuts = [0, *(np.flatnonzero(pieces[1:] != pieces[:-1]) + 1).tolist(), len(pieces)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if name is not None and int(pieces[a]) != name:
                    yield name, pos, lcp
                    pos, lcp = [], []
                name = int(pieces[a])
                pos += p[a:b].tolist()
                lcp += e[a:b].tolist()
        if name is not None:
            yield name, pos, lcp

    def flat(stack: Stack) -> list[int]:
        return [x for entry in stack.entries for x in entry]

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, pos, lcp in slices(batches):
            ahead, back = Stack(), Stack()
            _, least = _walk(pos, lcp, ahead)
            _walk(pos[::-1], [1 << 62, *lcp[:0:-1]], back)
            back.edge(lcp[0])  # towards the slice before
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([least]), pa.array([flat(ahead)], pa.list_(pa.int64())), pa.array([flat(back)], pa.list_(pa.int64()))], names=["slice", "least", "ahead", "back"])

    ordered = _sliced(table, ranks).select("slice", "pos", "lcp")
    rows = sorted(ordered.mapInArrow(summary, "slice int, least bigint, ahead array<bigint>, back array<bigint>").collect(), key=lambda r: r["slice"])
    entries = lambda x: list(zip(x[::2], x[1::2], strict=True))
    incoming: dict[int, list[list]] = {r["slice"]: [[], []] for r in rows}
    carried: list = []
    for r in rows:
        incoming[r["slice"]][0] = carried
        carried = handed_on(carried, r.least, entries(r.ahead))
    carried = []
    for r in reversed(rows):
        incoming[r["slice"]][1] = carried
        carried = handed_on(carried, r.least, entries(r.back))
    shared = prefixes.sparkSession.sparkContext.broadcast({k: v for k, v in incoming.items() if v[0] or v[1]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, pos, lcp in slices(batches):
            left, right = shared.value.get(name, ((), ()))
            ahead, _ = _walk(pos, lcp, Stack(left))
            back, _ = _walk(pos[::-1], [1 << 62, *lcp[:0:-1]], Stack(right))
            best = np.maximum(np.array(ahead, np.int64), np.array(back[::-1], np.int64))
            hit = np.flatnonzero(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(pos, np.int64)[hit]), pa.array(best[hit])], names=["pos", "length"])

    return ordered.mapInArrow(run, "pos bigint, length bigint")
