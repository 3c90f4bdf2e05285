"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file gives the vocabulary: a token's bytes and its rank, which is its id.  The model of the tokenizers
library wants merges, so every split of a token into two lower tokens becomes one, in the order of the token's
rank.  Texts are cut by a pattern and each match is encoded separately; a match that is itself a token is that
token.  Bytes travel through the library as the printable characters of the usual byte table; decoding reverses
this table and joins bytes, so a character that two tokens share comes out whole.  The library also gives the
offsets of the tokens in their match, which the match's own place makes offsets in the text.

Where the pattern's classes are cut by another version of Unicode than the rank library's (characters without a
category in Python's tables), the cut is made on a copy of the text in which such a character is replaced by one
of the class that the rank library gives it; the matches are then taken from the text itself.

Defined cases: a null or empty text has no tokens and decodes to no bytes; a very long text is encoded whole; ids
don't depend on which outputs are asked for; repeated rows give repeated results; an empty table gives an empty
result; only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _common as C

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Matches whose ids a worker keeps, and the length in characters up to which it keeps one.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=1)
def byte_table() -> tuple[str, ...]:
    """The character that stands for each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return tuple(chr(b) if b in shown else chr(next(spare)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(maxsize=4)
def codec(path: str, pattern: str):
    """The encoder of texts by their matches, and the bytes of each id; once a process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    chars = byte_table()
    spell = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        splits = ((token[:i], token[i:]) for i in range(1, len(token)))
        lower = [(ranks[a], ranks[b], a, b) for a, b in splits if ranks.get(a, rank) < rank and ranks.get(b, rank) < rank]
        merges += [(spell[a], spell[b]) for _, _, a, b in sorted(lower)]
    single = Tokenizer(models.BPE(vocab={spell[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=100_000))
    single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    back = {c: b for b, c in enumerate(chars)}
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = bytes(back[c] for c in spell[token])
    return Matches(single, pattern), table


@lru_cache(maxsize=1)
def unassigned() -> tuple[re.Pattern, str]:
    """A compiled class of the characters that have no category in Python's Unicode tables, and all of them."""
    none = [unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)]
    edges = [c for c in range(1, 0x110000) if none[c] != none[c - 1]] + [0x110000]
    spans = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if none[a]]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in spans) + "]"), "".join(chr(c) for a, b in spans for c in range(a, b))


#: A class of characters that patterns name, and a character that is in it by every version of Unicode.
STAND_INS = {r"\p{L}": "\u3042", r"\p{N}": "\u00b2"}
NEITHER = "\u2042"


@lru_cache(maxsize=1)
def alignment() -> dict[int, str]:
    """For characters that the regex module classes unlike the rank library: a character of the class they have there.

    The rank library encodes nothing but what its pattern matches, so a pattern of one class shows what is in it.
    """
    import regex
    import tiktoken

    _, every = unassigned()
    own, theirs = {}, {}
    for name, stand_in in STAND_INS.items():
        own |= dict.fromkeys(regex.findall(name, every), stand_in)
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs |= dict.fromkeys(bytes(probe.encode_ordinary(every)).decode("utf-8"), stand_in)
    return {ord(c): theirs.get(c, NEITHER) for c in own.keys() | theirs.keys() if own.get(c) != theirs.get(c)}


class Matches:
    """Ids and offsets of texts from the matches of a pattern; each distinct match is given to the library once, and kept."""

    def __init__(self, tokenizer, pattern: str):
        import regex

        self.tokenizer, self.pattern = tokenizer, regex.compile(pattern)
        self.odd = unassigned()[0].search
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, bytes] = {}
        self.places: dict[str, bytes] = {}
        self.shared: dict[str, int] = {}

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end of each match in code points."""
        aligned = text.translate(alignment()) if not text.isascii() and self.odd(text) else text
        return [m.span() for m in self.pattern.finditer(aligned)]

    def _learn(self, pieces: list[str]) -> None:
        for piece, found in zip(pieces, self.tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True):
            self.known[piece] = np.array(found.ids, "<u4").tobytes()
            self.places[piece] = np.array(found.offsets, np.int32).tobytes()
            if not piece.isascii() and (n := split_tokens(found.offsets)):
                self.shared[piece] = n

    def encode(self, texts: list[str], offsets: bool = False) -> tuple[list[bytes], list[int], list[np.ndarray] | None]:
        """Ids of each text as little-endian unsigned 32-bit integers, the number of its tokens that share a character
        with another, and the offsets of its tokens if asked for."""
        if len(self.known) > REMEMBERED:
            self._clear()
        find, known = self.pattern.findall, self.known
        pieces = [find(t) for t in texts]
        new = {p for row in pieces for p in row if p not in known}
        odd = {p for p in new if not p.isascii() and self.odd(p)}
        starts: dict[int, list[int]] = {}
        for i, text in enumerate(texts):
            if offsets or (odd and not odd.isdisjoint(pieces[i])):
                spans = self.spans(text)
                pieces[i] = [text[a:b] for a, b in spans]
                starts[i] = [a for a, _ in spans]
        if odd:
            new = {p for row in pieces for p in row if p not in known}
        self._learn(list(new))
        ids = [b"".join(map(known.__getitem__, row)) for row in pieces]
        shared = [0 if t.isascii() else sum(self.shared.get(p, 0) for p in row) for t, row in zip(texts, pieces, strict=True)] if self.shared else [0] * len(texts)
        out = None
        if offsets:
            out = []
            for i, row in enumerate(pieces):
                rest = np.frombuffer(b"".join(map(self.places.__getitem__, row)), np.int32).reshape(-1, 2)
                out.append(rest + np.repeat(np.array(starts[i], np.int32), [len(known[p]) // 4 for p in row])[:, None])
        for p in new:  # long ones would take room, and odd ones have to be seen again to be cut again
            if len(p) > REMEMBERED_CHARS or (odd and not p.isascii() and self.odd(p)):
                del known[p], self.places[p]
                self.shared.pop(p, None)
        return ids, shared, out


def split_tokens(offsets: list[tuple[int, int]]) -> int:
    """How many tokens hold only a part of a character: their range overlaps that of a neighbour."""
    cut = [False] * len(offsets)
    for k in range(1, len(offsets)):
        if offsets[k][0] < offsets[k - 1][1]:
            cut[k - 1] = cut[k] = True
    return sum(cut)


def decode_ids(ids: Iterable[int], table: list[bytes]) -> bytes:
    """The bytes of a list of ids."""
    return b"".join(map(table.__getitem__, ids))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks_path: str | None = None, pattern: str | None = None, outputs: tuple[str, ...] = ("ids", "offsets")) -> DataFrame:
    """Encode whole texts.  Columns: the id, ``n_tokens``, and those of ``outputs`` that are asked for:

    ``ids`` array<int>; ``offsets`` array<int>, start and end in code points of each token in turn (tokens that
    split a character both have that character's range); ``ids_sha256``, of the ids as little-endian unsigned
    32-bit integers; ``decoded_sha256``, of the bytes that the ids decode to.
    """
    path, pat = ranks_path or default_ranks(), pattern or default_pattern()
    types = {"ids": "array<int>", "offsets": "array<int>", "ids_sha256": "string", "decoded_sha256": "string", "n_split": "bigint"}
    unknown = [x for x in outputs if x not in types]
    if unknown:
        raise ValueError(f"unknown outputs: {unknown}")
    source = C.id_and_text(docs, id_col, text_col)
    id_type = source.schema[0].dataType.simpleString()
    schema = ", ".join([f"__id {id_type}", "n_tokens bigint", *(f"{x} {types[x]}" for x in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches, table = codec(path, pat)
        for part in C.text_slices(batches):
            ids, shared, offsets = matches.encode(C.text_array(part.column(1)).to_pylist(), "offsets" in outputs)
            columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())]
            for name in outputs:
                if name == "ids":
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                elif name == "offsets":
                    columns.append(pa.array([x.ravel() for x in offsets], pa.list_(pa.int32())))
                elif name == "n_split":
                    columns.append(pa.array(shared, pa.int64()))
                elif name == "ids_sha256":
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()))
                else:
                    columns.append(pa.array([hashlib.sha256(decode_ids(np.frombuffer(x, "<u4").tolist(), table)).hexdigest() for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["__id", "n_tokens", *outputs])

    return source.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Decode id lists: the id, ``decoded`` binary, and ``text``, where bytes that are no UTF-8 become U+FFFD.

    A null list decodes to no bytes.  An id outside the vocabulary is an error, as silence would lose text.
    """
    from pyspark.sql import functions as F

    path, pat = ranks_path or default_ranks(), pattern or default_pattern()
    source = encoded.select(F.col(id_col).alias("__id"), F.col(ids_col).alias("__ids"))
    schema = f"__id {source.schema[0].dataType.simpleString()}, decoded binary, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = codec(path, pat)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                raw = [decode_ids(x or (), table) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw])], names=["__id", "decoded", "text"])

    return source.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns for a table of documents, in one pass over the texts."""
    return encode(docs, outputs=("ids_sha256", "decoded_sha256", "n_split"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLE: dict[str, str] = {}
