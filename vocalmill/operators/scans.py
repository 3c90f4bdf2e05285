"""Running values over the rows of a key in order, where one key may hold any share of all rows.

A window puts a key's rows into one task.  Here rows are dealt by ranges of (key, order), so a key takes as many tasks as
its rows need.  Each task runs over its rows in order and writes what it finds, as if nothing came before; then one row a
task, its first and last key and the values at its end, tells what the rows of its first key must add: the *carry*.  Carries
are put together in the order of the ranges on the driver, a row a task, and joined by broadcast.

Defined cases: nulls among keys are one key, before all others; a null value counts for nothing (a sum stays, a greatest value
is null until there is a value), but is a value of its own for ``last`` and ``runs``; rows that are equal in key and order have
no defined order between them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..session import ship

_LOWEST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Running:
    """What runs: ``max`` or ``sum`` of a whole number, ``count`` of rows, ``last`` value of any type, ``runs`` of equal values.

    ``before`` leaves the row itself out; ``last`` is always that of the row before.
    """

    kind: str
    column: str | None = None
    before: bool = False


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether values are equal, nulls among themselves too."""
    equal = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
    return equal | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))


def _fresh(columns: list[pa.Array], before: list | None) -> np.ndarray:
    """Whether each row differs from the one before it in any of the columns."""
    n = len(columns[0])
    out = np.ones(n, bool)
    if n > 1:
        out[1:] = ~np.logical_and.reduce([_same(c.slice(1), c.slice(0, n - 1)) for c in columns])
    if before is not None:
        out[0] = [c[0].as_py() for c in columns] != before
    return out


def group_max(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The running maximum within groups that lie side by side: by ranks, so that one accumulation serves all."""
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    top = np.maximum.accumulate(group * len(values) + rank) - group * len(values)
    return values[order[top]]


class _Local:
    """Runs over a task's batches; ``state`` has the values at the end, for the key in hand."""

    def __init__(self, keys: int, wanted: dict[str, Running], columns: dict[str, int]):
        self.keys, self.wanted, self.columns = keys, wanted, columns
        self.key: list | None = None
        self.state: dict[str, object] = {}
        self.at, self.head = 0, True

    def batch(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
        """Whether each row is of the task's first key, and the running values."""
        n = batch.num_rows
        keys = [batch.column(k) for k in range(self.keys)]
        new_key = _fresh(keys, self.key)
        goes_on = self.key is not None and not new_key[0]
        new_key[0] = True
        group = np.cumsum(new_key) - 1
        starts = np.flatnonzero(new_key)
        head = (group == 0) & (self.head and (goes_on or self.at == 0))
        out = []
        for name, w in self.wanted.items():
            old = self.state.get(name) if goes_on else None
            column = batch.column(self.columns[w.column]) if w.column else None
            if w.kind in ("count", "sum"):
                each = np.ones(n, np.int64) if column is None else pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                run = np.cumsum(each)
                run = run - (run[starts] - each[starts])[group] + np.where(group == 0, old or 0, 0)
                self.state[name] = int(run[-1])
                out.append(pa.array(run - each if w.before else run))
            elif w.kind == "max":
                each = pc.fill_null(column.cast(pa.int64()), _LOWEST).to_numpy(zero_copy_only=False)
                first = _LOWEST if old is None else old
                run = np.maximum(group_max(each, group), np.where(group == 0, first, _LOWEST))
                self.state[name] = int(run[-1]) if run[-1] > _LOWEST else None
                if w.before:
                    shown = np.concatenate(([first], run[:-1]))
                    shown[starts[1:]] = _LOWEST
                    run = shown
                out.append(pa.array(run, mask=run == _LOWEST))
            elif w.kind == "last":
                before = pa.array([old], column.type)
                shown = pa.concat_arrays([before, column.slice(0, n - 1)])
                out.append(pc.if_else(pa.array(np.isin(np.arange(n), starts[1:])), pa.scalar(None, column.type), shown))
                self.state[name] = column[n - 1].as_py()
            else:  # runs
                changed = _fresh([column], None)
                runs_before, value = old if old is not None else (0, None)
                if goes_on:
                    changed[0] = column[0].as_py() != value
                changed[starts[1:]] = True
                run = np.cumsum(changed)
                run = run - (run[starts] - changed[starts])[group] + np.where(group == 0, runs_before, 0)
                self.state[name] = (int(run[-1]), column[n - 1].as_py())
                out.append(pa.array(run - changed if w.before else run))
        if self.head and len(starts) > 1 or not goes_on and self.at > 0:
            self.head = False
        self.key = [c[n - 1].as_py() for c in keys]
        self.at += n
        return head, out


def running(df: DataFrame, keys: list[str], order: list[str | Column], wanted: dict[str, Running], parts: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``wanted``, over the rows of equal keys in the order given."""
    spark = df.sparkSession
    ship(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    lead = [*keys, *(c for c in names if c not in keys)]
    source = df.repartitionByRange(parts, *keys, *by).sortWithinPartitions(*keys, *by).select(*lead)
    places = {c: k for k, c in enumerate(lead)}
    types = {k: "bigint" if w.kind != "last" else df.schema[w.column].dataType.simpleString() for k, w in wanted.items()}
    shape = source.withColumns({"__pid": F.lit(0), "__at": F.lit(0).cast("bigint"), "__head": F.lit(True), **{f"__r_{k}": F.lit(None).cast(t) for k, t in types.items()}}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = _Local(len(keys), wanted, places)
        pid = TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                at = local.at + np.arange(batch.num_rows)
                head, found = local.batch(batch)
                columns = [*batch.columns[: len(lead)], pa.array(np.full(batch.num_rows, pid, np.int32)), pa.array(at), pa.array(head), *found]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in shape])

    table = shared.written(source.mapInArrow(run, shape), "scan")
    carries = _carries(table, keys, wanted)
    if not carries:
        return table.select(*names, *(F.col(f"__r_{k}").alias(k) for k in wanted))
    inner = ", ".join(f"__c_{k} {types[k]}" for k in wanted)
    small = spark.createDataFrame(carries, f"__pid int, __carried boolean, {inner}")
    met = table.join(F.broadcast(small), "__pid", "left")  # a row a task
    takes = F.col("__head") & F.coalesce("__carried", F.lit(False))
    out = []
    for k, w in wanted.items():
        own, carry = F.col(f"__r_{k}"), F.col(f"__c_{k}")
        if w.kind == "last":
            out.append(F.when(takes & (F.col("__at") == 0), carry).otherwise(own).alias(k))
        else:
            out.append(F.when(takes, F.greatest(own, carry) if w.kind == "max" else own + carry).otherwise(own).alias(k))
    return met.select(*names, *out)


def _carries(table: DataFrame, keys: list[str], wanted: dict[str, Running]) -> list[tuple]:
    """What the rows of a task's first key take over from the tasks before; only tasks that take something."""
    tail = F.struct("__at", *keys, "__head", *(F.col(f"__r_{k}").alias(f"r_{k}") for k in wanted), *(F.col(w.column).alias(f"v_{k}") for k, w in wanted.items() if w.column))
    ends = table.groupBy("__pid").agg(F.min(tail).alias("head"), F.max(tail).alias("tail")).collect()
    out, last = [], None
    for r in sorted(ends, key=lambda r: r["__pid"]):
        key, end = [r.head[k] for k in keys], [r.tail[k] for k in keys]
        goes_on = last is not None and last[0] == key
        values = {}
        state = {}
        for k, w in wanted.items():
            was = last[1][k] if goes_on else None
            own, value = r.tail[f"r_{k}"], r.tail[f"v_{k}"] if w.column else None
            if w.kind in ("count", "sum"):
                carry = was or 0
                each = 1 if w.column is None else value or 0
                state[k] = own + (each if w.before else 0) + (carry if r.tail["__head"] else 0)
            elif w.kind == "max":
                carry = was
                state[k] = max((x for x in (own, value if w.before else None, carry if r.tail["__head"] else None) if x is not None), default=None)
            elif w.kind == "last":
                carry, state[k] = was, value
            else:
                runs, before = was if was is not None else (0, None)
                first = r.head[f"v_{k}"]
                carry = runs - 1 if goes_on and before == first else runs
                state[k] = (own + (carry if r.tail["__head"] else 0), value)
            values[k] = carry
        if goes_on:
            out.append((r["__pid"], True, *(values[k] for k in wanted)))
        last = (end, state)
    return out


def islands(df: DataFrame, keys: list[str], order: list[str | Column], value: str, name: str = "island", parts: int | None = None) -> DataFrame:
    """The number, from 1, of the run of equal values that each row is in."""
    return running(df, keys, order, {name: Running("runs", value)}, parts)


def monotone(events: DataFrame, keys: list[str], order: str, progress: str = "progress", cap: int = 100, parts: int | None = None) -> DataFrame:
    """Progress that never falls, capped."""
    found = running(events, keys, [order], {"shown": Running("max", progress)}, parts)
    return found.withColumn("shown", F.least(F.coalesce("shown", F.lit(0)), F.lit(cap)))


def merge_spans(spans: DataFrame, keys: list[str], collar_ms: int = 500, min_ms: int = 0, parts: int | None = None) -> DataFrame:
    """As :func:`intervals.merge_spans`; two scans, the second over the spans that begin a merged one only.

    A merged span ends with the greatest end before the next one begins, so no row needs the number of its group.
    """
    kept = spans.where(F.col("end_ms") - F.col("start_ms") >= min_ms).select(*keys, "start_ms", "end_ms")
    seen = running(kept, keys, ["start_ms", "end_ms"], {"reach": Running("max", "end_ms", before=True), "nth": Running("count", before=True)}, parts)
    begins = seen.where(F.coalesce(F.col("start_ms") - F.col("reach") >= collar_ms, F.lit(True)))
    after = running(begins.select(*keys, "start_ms", "nth", "reach"), keys, [F.col("start_ms").desc(), F.col("nth").desc()], {"upto": Running("last", "reach"), "until": Running("last", "nth")}, parts)
    whole = kept.groupBy(*keys).agg(F.max("end_ms").alias("__end"), F.count("*").alias("__n"))
    joined = after.join(whole.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__end", "__n"), [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return joined.select(*keys, "start_ms", F.coalesce("upto", "__end").alias("end_ms"), (F.coalesce("until", "__n") - F.col("nth")).alias("spans"))


def step_ranges(steps: DataFrame, keys: list[str], order: str, weight: str = "weight", parts: int | None = None) -> DataFrame:
    """As :func:`progress.ranges`."""
    upto = running(steps, keys, [order], {"__upto": Running("sum", weight)}, parts)
    total = steps.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.sum(weight).alias("__total"))
    joined = upto.join(total, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    percent = lambda x: F.coalesce(F.floor(F.try_divide(x * 100, F.col("__total"))), F.lit(0)).cast("int")
    return joined.select(*steps.columns, percent(F.col("__upto") - F.coalesce(weight, F.lit(0))).alias("start_percent"), percent(F.col("__upto")).alias("end_percent"))
