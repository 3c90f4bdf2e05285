"""A prefix trie of conversations, built by splitters and a skeleton: which beginnings are shared, and what sharing saves.

Every conversation is first rebuilt: the first h turns of the first conversation in its group of five ids, then its own
turns after its first h.  A node of the trie is a distinct sequence of first turns; each has its members, children,
leaves, and the bytes of last turns that its subtree would save if shared turns were stored once.

A turn is the MD5 of its role and text, a conversation a path: the digests of its turns end to end, whose order as bytes
puts every subtree in one row of neighbours.  Paths are dealt into shards by splitters, quantiles of a bounded sample of
(path, id), so copies of one conversation are split by id.  The *skeleton* is the trie of the splitters' paths, and is
broadcast: a node outside it has all its members in one shard, as a shard's edge inside a subtree has that subtree's node as
a prefix.  Each shard is sorted and read once with a stack of open nodes; nodes outside the skeleton are finished there,
those of the skeleton give a partial sum a shard.  The partial sums are added, and then added up the skeleton, whose size is
bounded (``SKELETON_TURNS``; splitters beyond it are cut, which keeps results whole and shards somewhat less even).
Digests of members' ids go on over shards in order, from chunks of at most ``CHUNK_IDS`` ids.

A conversation's turns may be any share of all: they are ordered by key ranges and packed into chunks of a bounded number
before they meet; a path takes 24 bytes a turn.  Texts are never shuffled.

Defined cases: a null turn number comes first; turns of equal number are ordered by the MD5 of role and text; repeated
rows are turns of their own; null role and text are empty; rows without conv_id belong to no conversation; a group's first
conversation may be absent (then nothing is taken from it); a rebuilt conversation may have no turns and is then a member
of the root only; a very long text counts whole; an empty table has no conversations and no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Conversations that share heads; the greatest number of turns taken over is one less than HEAD.
GROUP, HEAD = 5, 9
#: Bytes of a turn's digest.
WIDTH = 16
#: Turns packed into a row, and ids of members that go to the digest of a skeleton node as one row.
CHUNK_TURNS, CHUNK_IDS = 1 << 16, 1 << 16
#: Conversations sampled for each shard, at most so many in all, and turns of their paths that the driver may hold.
SAMPLE, SAMPLED, SKELETON_TURNS = 24, 50_000, 1 << 19
_BEFORE_ALL = -(1 << 63) - 1
_EMPTY = hashlib.sha256(b"").hexdigest()


def turns_taken(conv_id: int) -> int:
    """How many turns a conversation takes from the first of its group."""
    return zlib.crc32(str(conv_id).encode()) % HEAD


def _chunks(turns: DataFrame, parts: int) -> DataFrame:
    """(c, seq, keys, sizes): each conversation's turns in order, packed; ``seq`` orders the rows of one."""
    schema = "c bigint, seq bigint, keys binary, sizes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy()
            keys = batch.column(1).to_pylist()
            sizes = batch.column(2).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))) if len(ids) else []
            spans = [(k, min(k + CHUNK_TURNS, b)) for a, b in zip(edges[:-1], edges[1:], strict=True) for k in range(a, b, CHUNK_TURNS)]
            out = ([int(ids[a]) for a, _ in spans], list(range(seq, seq + len(spans))), [b"".join(keys[a:b]) for a, b in spans], [sizes[a:b].tobytes() for a, b in spans])
            seq += len(spans)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["c", "seq", "keys", "sizes"])

    return turns.repartitionByRange(parts, "c", "turn", "key").sortWithinPartitions("c", "turn", "key").select("c", "key", "bytes").mapInArrow(run, schema)


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, path, sizes): each conversation after the heads are taken over; sizes are 64-bit numbers of bytes of its texts."""
    C.prepare(conversations.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(text(role_col)).cast("string"), F.lit(":"), text(role_col), text(text_col)).cast("binary")))
    turns = conversations.select(F.col(conv_col).cast("bigint").alias("c"), F.col(turn_col).alias("turn"), key.alias("key"), F.octet_length(text(text_col)).cast("bigint").alias("bytes")).where("c IS NOT NULL")
    parts = C.shuffle_parts(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[int, tuple[list[bytes], list[bytes]]] = {}
        here = None
        for batch in batches:
            for base, c, keys, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if base != here and group:
                    yield _rebuild(here, group)
                    group = {}
                here = base
                own = group.setdefault(c, ([], []))
                own[0].append(keys)
                own[1].append(sizes)
        if group:
            yield _rebuild(here, group)

    chunks = _chunks(turns, parts).withColumn("base", F.col("c") - F.col("c") % GROUP).select("base", "c", "seq", "keys", "sizes")
    return chunks.repartition(parts, "base").sortWithinPartitions("base", "c", "seq").mapInArrow(run, "c bigint, path binary, sizes binary")


def _rebuild(base: int, group: dict[int, tuple[list[bytes], list[bytes]]]) -> pa.RecordBatch:
    whole = {c: (b"".join(keys), b"".join(sizes)) for c, (keys, sizes) in group.items()}
    head = whole.get(base, (b"", b""))
    ids, paths, lengths = [], [], []
    for c, (keys, sizes) in whole.items():
        h = turns_taken(c)
        ids.append(c)
        paths.append(head[0][: h * WIDTH] + keys[h * WIDTH :])
        lengths.append(head[1][: h * 8] + sizes[h * 8 :])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.binary()), pa.array(lengths, pa.binary())], names=["c", "path", "sizes"])


@dataclass
class Skeleton:
    """The trie of the splitters' paths; nodes are numbered from the root (0), every subtree in one run of numbers."""

    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    child: dict[tuple[int, bytes], int] = field(default_factory=dict)

    def add(self, path: bytes) -> None:
        """The nodes of a path; paths come in order."""
        node = 0
        for k in range(0, len(path), WIDTH):
            step = (node, path[k : k + WIDTH])
            if step not in self.child:
                self.child[step] = len(self.parents)
                self.parents.append(node)
                self.depths.append(k // WIDTH + 1)
            node = self.child[step]


def splitters(paths: DataFrame, parts: int, sample: int = SAMPLE, turns: int = SKELETON_TURNS) -> list[tuple[bytes, int]]:
    """At most ``parts - 1`` keys (path, id) that part the conversations evenly by turns, from those with the least id hashes."""
    if parts < 2:
        return []
    rows = min(parts * sample, SAMPLED)
    longest = max(1, turns // rows)
    taken = paths.select(F.substring("path", 1, longest * WIDTH).alias("p"), "c", (F.octet_length("path") / WIDTH).cast("bigint").alias("n")).orderBy(F.xxhash64("c"), "c").limit(rows).collect()
    keys = sorted((bytes(r.p), r.c if r.n <= longest else _BEFORE_ALL, r.n + 1) for r in taken)
    ends = np.cumsum([n for _, _, n in keys])
    at = np.searchsorted(ends, [ends[-1] * k / parts for k in range(1, parts)]) if keys else []
    return sorted({keys[k][:2] for k in at})


_FIELDS = "kind int, skel int, seq bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]
_TYPES = [pa.int32(), pa.int32(), *[pa.int64()] * 8, pa.string()]
NODE, PARTIAL, IDS = range(3)


def _common(a: bytes, b: bytes) -> int:
    """Turns at the beginning that two paths share."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    if a[: high * WIDTH] == b[: high * WIDTH]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * WIDTH] == b[: middle * WIDTH] else (low, middle - 1)
    return low


class _Open:
    """A node on the path in hand."""

    __slots__ = ("skel", "bytes", "n", "least", "children", "leaves", "saved", "digest", "ids", "waiting")

    def __init__(self, skel: int, size: int):
        self.skel, self.bytes = skel, size
        self.n = self.children = self.leaves = self.saved = 0
        self.least = self.digest = None
        self.ids: list[int] = []
        self.waiting: list[tuple] = []

    def take(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


class Scan:
    """Reads a shard's conversations in order of (path, id) and gives rows of ``_FIELDS``."""

    def __init__(self, trie: Skeleton, shard: int):
        self.trie, self.seq = trie, shard << 32
        self.rows: list[tuple] = []
        self.open: list[_Open] = []
        self.path = b""

    def add(self, c: int, path: bytes, sizes: bytes) -> None:
        if self.open:
            self.close(_common(self.path, path) + 1)
        else:
            self.open.append(_Open(0, 0))
        numbers = np.frombuffer(sizes, np.int64)
        for d in range(len(self.open) - 1, len(path) // WIDTH):
            skel = self.open[-1].skel
            self.open.append(_Open(self.trie.child.get((skel, path[d * WIDTH : (d + 1) * WIDTH]), -1) if skel >= 0 else -1, int(numbers[d])))
        self.path = path
        node = self.open[-1]
        node.take(1, c)
        if node.skel >= 0:
            node.ids.append(c)
            if len(node.ids) == CHUNK_IDS:
                self.ids(node)
        elif node.digest is None:
            node.digest = hashlib.sha256(str(c).encode())
        else:
            node.digest.update(f",{c}".encode())

    def ids(self, node: _Open) -> None:
        if node.ids:
            self.rows.append((IDS, node.skel, self.seq, *[None] * 7, ",".join(map(str, node.ids))))
            self.seq += 1
            node.ids = []

    def close(self, left: int) -> None:
        """Close all but the first ``left`` open nodes."""
        while len(self.open) > left:
            node = self.open.pop()
            if node.skel >= 0:
                self.ids(node)
                self.rows.append((PARTIAL, node.skel, node.bytes, node.least, None, None, node.n, node.children, node.leaves, node.saved, None))
                continue
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.bytes
            for depth, *rest in node.waiting:
                self.rows.append((NODE, None, None, rest[0], depth, node.least, *rest[1:]))
            parent = self.open[-1]
            parent.take(node.n, node.least)
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved
            record = (len(self.open), node.least, node.n, node.children, leaves, saved, node.digest.hexdigest() if node.digest else _EMPTY)
            if parent.skel < 0:
                parent.waiting.append(record)
            else:
                self.rows.append((NODE, parent.skel, None, record[1], record[0], None, *record[2:]))

    def flush(self, least: int = 4096) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), _TYPES, strict=True)], names=_NAMES)
            self.rows = []


def _digests(chunks: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the skeleton's nodes at which conversations end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, digest = None, None
        for batch in batches:
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node != here:
                    if digest is not None:
                        yield pa.RecordBatch.from_pydict({"node": pa.array([here], pa.int32()), "ends_sha256": [digest.hexdigest()]})
                    here, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
        if digest is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([here], pa.int32()), "ends_sha256": [digest.hexdigest()]})

    ordered = chunks.repartition("skel").sortWithinPartitions("skel", "seq").select("skel", "ends")
    return ordered.mapInArrow(run, "node int, ends_sha256 string")


def _finished(partials: DataFrame, trie: Skeleton) -> DataFrame:
    """The skeleton's nodes with their whole subtrees: one task over at most a row a node of the skeleton."""
    shared = partials.sparkSession.sparkContext.broadcast(trie)
    names = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parents, depths = shared.value.parents, shared.value.depths
        rows = {r[0]: list(r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        if not rows:
            return
        for node in range(len(parents) - 1, -1, -1):  # children have greater numbers than their parents
            _, least, size, n, children, leaves, saved = rows[node]
            rows[node][5] = leaves = leaves or 1 if not children else leaves
            rows[node][6] = saved = saved + (n - 1) * size
            if node:
                up = rows[parents[node]]
                up[1], up[3], up[4], up[5], up[6] = min((x for x in (up[1], least) if x is not None), default=None), up[3] + n, up[4] + 1, up[5] + leaves, up[6] + saved
        out = [(x, rows[x][1], depths[x], rows[parents[x]][1] if x else None, *rows[x][3:7]) for x in range(len(parents))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.int64()] * 7], strict=True)], names=names)

    sums = partials.groupBy("skel").agg(F.min("conv_id").alias("conv_id"), F.max("seq").alias("bytes"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    return sums.coalesce(1).mapInArrow(run, "node int, " + ", ".join(f"{n} bigint" for n in names[1:]))


def trie(conversations: DataFrame, *, parts: int | None = None, sample: int = SAMPLE, skeleton_turns: int = SKELETON_TURNS, **columns: str) -> DataFrame:
    """A row for each node, with the contract's columns."""
    spark = conversations.sparkSession
    paths = C.materialize(rebuilt(conversations, **columns), "rebuilt")
    parts = parts or C.shuffle_parts(paths)
    keys = splitters(paths, parts, sample, skeleton_turns)
    skeleton = Skeleton()
    for path, _ in keys:
        skeleton.add(path)
    shared_keys, shared = spark.sparkContext.broadcast(keys), spark.sparkContext.broadcast(skeleton)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared_keys.value
        for batch in batches:
            shards = [bisect_right(keys, key) for key in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), *batch.columns], names=["shard", "c", "path", "sizes"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Scan(shared.value, TaskContext.get().partitionId())
        for batch in batches:
            for c, path, sizes in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                found.add(c, path, sizes)
                yield from found.flush()
        found.close(0)
        yield from found.flush(1)

    dealt = paths.mapInArrow(deal, "shard int, c bigint, path binary, sizes binary").repartitionById(len(keys) + 1, F.col("shard"))
    found = C.materialize(dealt.sortWithinPartitions("path", "c").select("c", "path", "sizes").mapInArrow(scan, _FIELDS), "nodes")
    tops = C.materialize(_finished(found.where(F.col("kind") == PARTIAL), skeleton).join(_digests(found.where(F.col("kind") == IDS)), "node", "left"), "skeleton")
    numbers = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    over = F.broadcast(tops.select(F.col("node").alias("skel"), F.col("conv_id").alias("above")))  # a row a node of the skeleton
    rest = found.where(F.col("kind") == NODE).join(over, "skel", "left").select("conv_id", "depth", F.coalesce("above", "parent_conv_id").alias("parent_conv_id"), *numbers, F.col("ends").alias("ends_sha256"))
    return tops.select("conv_id", "depth", "parent_conv_id", *numbers, F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")).unionByName(rest)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(C.table(spark, sf_dir, "conversations"))


_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
ORACLE = {
    "op11_conversation_trie": f"""
WITH t AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) AS k, key, bytes
  FROM (SELECT conv_id AS c, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS key, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT c, c - c % {GROUP} AS base, {_CRC} % {HEAD} AS h FROM (SELECT DISTINCT c FROM t)),
turns AS (
  SELECT ids.c, 0 AS part, t.k, key, bytes FROM ids JOIN t ON t.c = ids.base WHERE t.k <= ids.h
  UNION ALL SELECT ids.c, 1, t.k, key, bytes FROM ids JOIN t USING (c) WHERE t.k > ids.h),
prefixes AS (
  SELECT c, row_number() OVER w AS depth, string_agg(key, '') OVER w AS node, bytes FROM turns WINDOW w AS (PARTITION BY c ORDER BY part, k)
  UNION ALL SELECT c, 0, '', 0 FROM ids),
sizes AS (SELECT c, max(depth) AS size FROM prefixes GROUP BY c),
nodes AS (
  SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, string_agg(CASE WHEN depth = size THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends
  FROM prefixes JOIN sizes USING (c) GROUP BY node, depth),
linked AS (SELECT *, CASE WHEN depth > 0 THEN left(node, CAST(32 * (depth - 1) AS BIGINT)) END AS up FROM nodes),
born AS (SELECT up AS node, count(*) AS n_children FROM linked WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT left(x.node, CAST(32 * j AS BIGINT)) AS node, sum((n_convs - 1) * bytes) AS saved_tokens, count(*) FILTER (WHERE b.node IS NULL) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM linked) x LEFT JOIN born b ON b.node = x.node GROUP BY ALL)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM linked x LEFT JOIN linked p ON p.node = x.up LEFT JOIN born b ON b.node = x.node JOIN below ON below.node = x.node
"""
}
QUERIES = {"op11_conversation_trie": op11_conversation_trie}
