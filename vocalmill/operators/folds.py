"""Ordered folds over arrays (W3, W10, W12): state that runs through the rows of one recording in order.

The rows of a recording are collected once, sorted by their index inside the row, and folded by a higher-order
function, so a fold costs one shuffle on the recording's id and stays in the JVM.  The running state is a few numbers
and the places where groups begin; the groups are cut out afterwards, so time is in proportion to the rows.  Turn ids
need a set of the ids in use, which only Python has.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Sizes of readable paragraphs in characters.
SOFT_CHARS, HARD_CHARS, MIN_CHARS = 850, 1200, 220
#: Places that are gathered before they are put away; a list of lists grows without copying every place each time.
_CHUNK = 256
_TURN = "struct<start_ms:bigint,end_ms:bigint,speaker:string,human_label:string,text:string,flags:array<string>,notes:string,segments:int>"


def ordered(columns: list[str], by: str = "idx") -> Column:
    """An array of the group's rows as structs, in order of ``by``."""
    return F.array_sort(F.collect_list(F.struct(by, *(c for c in columns if c != by))))


def group_starts(rows: str, state: dict[str, tuple[str, str, str]], begins: str) -> Column:
    """The places (from 1) in an array at which a new group begins, by a fold.

    ``state`` has for each running value its type, its start and its value after a row, ``begins`` whether a row begins
    a group (null: it does).  In both, ``a`` is the state before the row ``x``; values may ask ``fresh``, the outcome of ``begins``.
    """
    types = f"struct<far:array<array<int>>,near:array<int>,n:int,{','.join(f'{k}:{t}' for k, (t, _, _) in state.items())}>"
    start = f"cast(named_struct('far', array(), 'near', array(), 'n', 1, {', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, (_, v, _) in state.items())}) as {types})"
    fresh = f"coalesce({begins}, true)"
    full = f"{fresh} and size(a.near) >= {_CHUNK}"
    after = ", ".join(f"'{k}', {v.replace('fresh', fresh)}" for k, (_, _, v) in state.items())
    step = f"named_struct('far', if({full}, concat(a.far, array(a.near)), a.far), 'near', if({fresh}, if({full}, array(a.n), concat(a.near, array(a.n))), a.near), 'n', a.n + 1, {after})"
    return F.expr(f"aggregate({rows}, {start}, (a, x) -> cast({step} as {types}), a -> flatten(concat(a.far, array(a.near))))")


def cut(rows: Column, starts: Column) -> Column:
    """An array cut into arrays at the places (from 1) where groups begin."""
    return F.transform(starts, lambda s, k: F.slice(rows, s, F.coalesce(F.get(starts, k + 1), F.size(rows) + 1) - s))


def exploded(df: DataFrame, keep: list[str], column: str, place: str, value: str) -> DataFrame:
    """A row for each element of an array column that a fold made, with its place.

    A plain explode of a column has the optimizer ask beforehand whether the array is empty, and so compute the fold
    again in that question, inside its own lambda functions.
    """
    return df.select(*keep, F.posexplode_outer(column).alias(place, value)).where(F.col(place).isNotNull()).withColumn(place, F.col(place).cast("bigint"))


def turn_fold(segments: DataFrame, key: str = "interview_id", gap_ms: int = 1800, max_turn_ms: int = 90000, keep_flags: bool = False) -> DataFrame:
    """Fold segments into turns.

    A segment joins the turn before it if the speaker is the same, the gap is at most ``gap_ms`` and the turn stays
    within ``max_turn_ms``.  Blank segments are left out.  ``segments`` has key, idx, start_ms, end_ms, speaker, text,
    and may have human_label, needs_review and note.  A review mark survives only on a turn's first segment, unless
    ``keep_flags``.  Result: key, turn (from 0), start_ms, end_ms, speaker, human_label, text, flags, notes, segments.
    """
    have = set(segments.columns)
    body = X.collapse(F.coalesce("text", F.lit("")))
    review = F.col("needs_review") if "needs_review" in have else F.lit(False)
    note = F.col("note") if "note" in have else F.lit(None).cast("string")
    speaker = F.coalesce("speaker", F.lit("SPEAKER_UNKNOWN"))
    label = F.coalesce(F.col("human_label") if "human_label" in have else F.lit(None).cast("string"), speaker)
    start = F.coalesce("start_ms", F.lit(0))
    turn = F.struct(
        start.cast("bigint").alias("start_ms"),
        F.coalesce(F.nullif("end_ms", F.lit(0)), start).cast("bigint").alias("end_ms"),
        speaker.alias("speaker"),
        label.alias("human_label"),
        body.alias("text"),
        F.when(review, F.array(F.lit("duvida"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.when(review, F.coalesce(X.blank_to_null(note), F.lit("Revisar falante."))).otherwise(F.lit("")).alias("notes"),
        F.lit(1).alias("segments"),
    ).cast(_TURN)
    rows = segments.select(F.col(key), "idx", turn.alias("t")).where("t.text != ''").groupBy(key).agg(ordered(["t"]).alias("rows"))
    joins = f"a.speaker = x.t.speaker and x.t.start_ms - a.last <= {int(gap_ms)} and x.t.end_ms - a.first <= {int(max_turn_ms)}"
    state = {"speaker": ("string", "null", "x.t.speaker"), "first": ("bigint", "null", "if(fresh, x.t.start_ms, a.first)"), "last": ("bigint", "null", "x.t.end_ms")}
    cutting = rows.withColumn("starts", group_starts("rows", state, f"not ({joins})"))
    each = cutting.select(key, F.posexplode(cut(F.col("rows.t"), F.col("starts"))).alias("turn", "g"))
    first = F.get("g", F.lit(0))
    flags = F.array_sort(F.array_distinct(F.flatten("g.flags"))) if keep_flags else first["flags"]
    notes = F.coalesce(F.get(F.filter("g.notes", lambda x: x != ""), F.lit(0)), F.lit("")) if keep_flags else first["notes"]
    return each.select(
        key,
        F.col("turn").cast("bigint").alias("turn"),
        first["start_ms"].alias("start_ms"),
        F.element_at("g", -1)["end_ms"].alias("end_ms"),
        first["speaker"].alias("speaker"),
        first["human_label"].alias("human_label"),
        F.array_join("g.text", " ").alias("text"),
        flags.alias("flags"),
        notes.alias("notes"),
        F.size("g").alias("segments"),
    )


def paragraphs(chunks: DataFrame, texts: str = "texts") -> DataFrame:
    """Readable paragraphs of a speaker's texts (the array column ``texts``), as the array column ``paragraphs`` in its place.

    A new text starts a paragraph once the current one has ``MIN_CHARS``; a sentence that would pass ``HARD_CHARS``
    starts one too; a finished sentence at ``SOFT_CHARS`` or more ends one.  A short last paragraph joins the one before.
    """
    clean = F.transform(F.col(texts), X.collapse)
    # texts are trimmed, so their sentences join by a space and end in their last character
    sentence = F.flatten(
        F.transform(
            F.filter(F.transform(clean, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"] != ""),
            lambda x: F.transform(X.sentences(x["c"]), lambda s, j: F.struct(s.alias("s"), F.length(s).alias("n"), F.right(s, F.lit(1)).isin(".", "!", "?").alias("stop"), ((x["i"] > 0) & (j == 0)).alias("opens"))),
        )
    )
    rest = [c for c in chunks.columns if c != texts]
    marked = chunks.select(*rest, sentence.alias("__sentences"))
    before = f"if(x.opens and a.len >= {MIN_CHARS}, 0, a.len)"
    longer = f"if({before} = 0, x.n, {before} + 1 + x.n)"
    over = f"{before} > 0 and {longer} > {HARD_CHARS}"
    state = {"len": ("int", "0", f"if({over}, x.n, if({longer} >= {SOFT_CHARS} and x.stop, 0, {longer}))")}
    cutting = marked.withColumn("__starts", group_starts("__sentences", state, f"{before} = 0 or ({over})"))
    joined = cutting.select(*rest, F.transform(cut(F.col("__sentences.s"), F.col("__starts")), lambda g: F.array_join(g, " ")).alias("__p"))
    every, last = F.col("__p"), F.try_element_at("__p", F.lit(-1))
    short = (F.size(every) >= 2) & (F.length(last) < MIN_CHARS)
    merged = F.concat(F.slice(every, 1, F.greatest(F.size(every) - 2, F.lit(0))), F.array(X.join_text(F.try_element_at(every, F.lit(-2)), last)))
    return joined.select(*rest, F.when(short, merged).otherwise(every).alias("paragraphs"))


def assign_turn_ids(ids: Column) -> Column:
    """Ids of an ordered array of turns: the first use of an id stays, others get the least unused number.

    Only ids already passed are avoided, as on reading a file in order.  Time is in proportion to the turns.
    """

    @F.pandas_udf("array<string>")
    def named(column: pd.Series) -> pd.Series:
        def one(given) -> list[str]:
            seen: set[str] = set()
            out, n = [], 1
            for raw in given:
                own = (raw or "").strip(" ")
                if not own or own in seen:
                    while (own := f"turn_{n:06d}") in seen:
                        n += 1
                seen.add(own)
                out.append(own)
            return out

        return column.map(lambda given: None if given is None else one(given))

    return named(ids)
