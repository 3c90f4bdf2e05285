"""Who speaks: attribution of words and segments (W4, J3), names of speakers (W6, J4), readable blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .folds import cut, paragraphs
from .sweep import best_overlap

#: Fixed value: the note on a segment with several speakers that could not be split.
MIXED_NOTE = "segmento ASR contem mais de um falante e nao tinha palavras suficientes para dividir"


def attribute(segments: DataFrame, words: DataFrame, spans: DataFrame, key: str = "interview_id") -> DataFrame:
    """Segments (unique by key and idx) with speakers from the spans, split where the words change speaker.

    ``words`` has key, idx (of the segment), widx, start_ms, end_ms, word.  Result: key, idx, sub (from 0), start_ms,
    end_ms, speaker, text, words, split, needs_review, note; a segment's own review mark and note stay, where it has them.
    """
    review = F.coalesce("needs_review", F.lit(False)) if "needs_review" in segments.columns else F.lit(False)
    own_note = F.coalesce("note", F.lit("")) if "note" in segments.columns else F.lit("")
    usable = words.where("end_ms > start_ms").where(F.trim("word") != "").select(key, "idx", F.col("widx").cast("bigint").alias("widx"), "start_ms", "end_ms", "word")
    items = usable.unionByName(segments.select(key, "idx", F.lit(None).cast("bigint").alias("widx"), "start_ms", "end_ms", F.lit(None).cast("string").alias("word")))
    heard = best_overlap(items, spans, ["idx", "widx", "word", "start_ms", "end_ms"], key, outer=True)
    # a row a segment, with its words in order and what its own time meets
    word = F.when(F.col("widx").isNotNull(), F.struct("widx", "start_ms", "end_ms", "word", "best_speaker"))
    grouped = heard.groupBy(key, "idx").agg(F.array_sort(F.collect_list(word)).alias("__heard"), F.max(F.when(F.col("widx").isNull(), F.struct("n_speakers", "best_speaker"))).alias("__whole"))
    joined = segments.join(grouped, [key, "idx"], "left").withColumns({"best_speaker": F.col("__whole.best_speaker"), "n_speakers": F.col("__whole.n_speakers")})
    own = F.coalesce("speaker", F.lit("SPEAKER_UNKNOWN"))
    joined = joined.withColumn("__said", F.transform("__heard", lambda x: F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["word"].alias("word"), F.coalesce(x["best_speaker"], own).alias("who"))))
    turns_to = F.filter(F.sequence(F.lit(1), F.size("__said")), lambda i: (i == 1) | (F.get("__said", i - 1)["who"] != F.get("__said", i - 2)["who"]))
    joined = joined.withColumn("__starts", F.when(F.size("__said") > 0, turns_to))
    # words that one speaker says in a row, as one piece
    joined = joined.withColumn("__pieces", F.transform(cut(F.col("__said"), F.col("__starts")), lambda g: F.struct(F.get(g, F.lit(0))["start_ms"].alias("start_ms"), F.element_at(g, -1)["end_ms"].alias("end_ms"), F.get(g, F.lit(0))["who"].alias("speaker"), g.alias("w"))))
    mixed = F.coalesce(F.col("n_speakers") > 1, F.lit(False))
    shape = "struct<sub:bigint,start_ms:bigint,end_ms:bigint,speaker:string,text:string,words:int,split:boolean,needs_review:boolean,note:string>"
    split = F.transform("__pieces", lambda p, i: F.struct(i.alias("sub"), p["start_ms"], p["end_ms"], p["speaker"], X.join_words(p["w"]["word"]).alias("text"), F.size(p["w"]).alias("words"), F.lit(True).alias("split"), review.alias("needs_review"), own_note.alias("note")).cast(shape))
    whole = F.struct(F.lit(0).alias("sub"), "start_ms", "end_ms", F.coalesce("best_speaker", "speaker").alias("speaker"), "text", F.lit(0).alias("words"), F.lit(False).alias("split"), (mixed | review).alias("needs_review"), F.when(mixed, F.lit(MIXED_NOTE)).otherwise(own_note).alias("note")).cast(shape)
    each = joined.select(key, "idx", F.explode(F.when(F.size("__pieces") > 1, split).otherwise(F.array(whole))).alias("r")).select(key, "idx", "r.*")
    return each.where("NOT split OR text != ''")


def speaker_ranks(segments: DataFrame, key: str = "interview_id") -> DataFrame:
    """(key, speaker, rank from 1) of the distinct speakers, numbered ones first."""
    distinct = segments.select(key, F.trim("speaker").alias("speaker")).where("speaker != ''").distinct()
    return distinct.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*X.speaker_order(F.col("speaker")))))


def speaker_labels(segments: DataFrame, labels: list[str], manual: DataFrame | None = None, key: str = "interview_id") -> DataFrame:
    """(key, speaker, human_label): a manual label (the last row of a speaker by ``idx``), else the label at the
    speaker's rank, else the speaker itself."""
    clean = [x.strip() for x in labels if x.strip()]
    given = F.array(*map(F.lit, clean)) if clean else F.array().cast("array<string>")
    ranked = speaker_ranks(segments, key).withColumn("__by_rank", F.get(given, F.col("rank") - 1))
    if manual is None:
        return ranked.select(key, "speaker", F.coalesce("__by_rank", "speaker").alias("human_label"))
    last = manual.groupBy(key, F.col("speaker_label").alias("speaker")).agg(F.max_by("human_label", "idx").alias("__manual"))
    joined = ranked.join(last, [key, "speaker"], "left")
    return joined.select(key, "speaker", F.coalesce(X.blank_to_null(F.col("__manual")), "__by_rank", "speaker").alias("human_label"))


def named(segments: DataFrame, labels: list[str], manual: DataFrame | None = None, key: str = "interview_id") -> DataFrame:
    """W6 and J4 in one pass: the segments with trimmed speakers and their ``human_label``, as :func:`speaker_labels` has it; null for blank ones.

    Ranks come from a window over the recording, whose partitioning a fold goes on with.
    """
    rows = segments.withColumn("speaker", F.trim("speaker"))
    blank = F.coalesce("speaker", F.lit("")) == ""
    clean = [x.strip() for x in labels if x.strip()]
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(blank.cast("int"), *X.speaker_order(F.col("speaker"))))
    given = F.get(F.array(*map(F.lit, clean)), rank - 1) if clean else F.lit(None).cast("string")
    rows = rows.withColumn("human_label", given)
    if manual is None:
        return rows.withColumn("human_label", F.when(~blank, F.coalesce("human_label", "speaker")))
    last = manual.groupBy(key, F.col("speaker_label").alias("__label")).agg(F.max_by("human_label", "idx").alias("__name"))
    maps = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("__label", "__name"))).alias("__manual"))
    joined = rows.join(maps.withColumnRenamed(key, "__key"), F.col(key) == F.col("__key"), "left").drop("__key")
    return joined.withColumn("human_label", F.when(~blank, F.coalesce(X.blank_to_null(F.try_element_at("__manual", F.col("speaker"))), "human_label", "speaker"))).drop("__manual")


def blocks(turns: DataFrame, key: str = "interview_id") -> DataFrame:
    """Consecutive turns of one speaker as blocks: key, block (from 0), start_ms, end_ms, speaker, label, paragraphs.

    The end is that of the last turn that has one, not the greatest.
    """
    body = X.join_text(X.collapse(F.coalesce("text", F.lit(""))), X.flag_text(F.col("flags")))
    shown = turns.where(X.shows(F.col("text"), F.col("flags")))
    rows = shown.select(key, "turn", "start_ms", "end_ms", X.editorial_key(F.col("human_label"), F.col("speaker")).alias("__who"), X.display_label(F.coalesce(X.blank_to_null(F.col("human_label")), X.editorial_key(F.col("human_label"), F.col("speaker")))).alias("__label"), body.alias("__body"))
    order = Window.partitionBy(key).orderBy("turn")
    rows = rows.withColumn("__new", F.when(F.lag("__who").over(order) == F.col("__who"), 0).otherwise(1))
    rows = rows.withColumn("block", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    ended = F.when(F.coalesce("end_ms", F.lit(0)) != 0, F.col("turn"))
    grouped = rows.groupBy(key, "block").agg(
        F.coalesce(F.min_by("start_ms", "turn"), F.lit(0)).alias("start_ms"),
        F.coalesce(F.max_by("end_ms", ended), F.min_by("start_ms", "turn"), F.lit(0)).alias("end_ms"),
        F.min("__who").alias("speaker"),
        F.min_by("__label", "turn").alias("label"),
        F.array_sort(F.collect_list(F.struct("turn", "__body"))).alias("b"),
    )
    return paragraphs(grouped.select(key, "block", "start_ms", "end_ms", "speaker", "label", F.col("b.__body").alias("__bodies")), "__bodies")
