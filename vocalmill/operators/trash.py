"""Removal and restoring of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .library import first_by

#: The key of each table.  Speaker maps are keyed by recording and label, so that all its labels come back.
KEYS = {"manifest": ("interview_id",), "metadata": ("file_id",), "speakers_map": ("interview_id", "speaker_label"), "jobs": ("file_id",)}


def snapshot(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The rows of the recordings in ``ids`` (column ``id``), table by table."""
    return {name: df.join(ids, df[KEYS[name][0]] == ids["id"], "left_semi") for name, df in tables.items()}


def remove(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The other rows."""
    return {name: df.join(ids, df[KEYS[name][0]] == ids["id"], "left_anti") for name, df in tables.items()}


def restore(current: dict[str, DataFrame], saved: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Saved rows whose key is absent come back; jobs come back as pending.  Doing it twice changes nothing."""
    out = {}
    for name, df in current.items():
        keys = list(KEYS[name])
        back = saved[name].join(df.select(*keys), keys, "left_anti").select(*df.columns)
        if name == "jobs":
            back = back.withColumn("status", F.lit("Pendente")).withColumn("progress", F.lit(0).cast(df.schema["progress"].dataType))
        out[name] = df.unionByName(back)
    return out


def collisions(moved: DataFrame, listing: DataFrame) -> DataFrame:
    """Original paths of moved files that exist again, with both sizes."""
    now = listing.select("path", F.col("size").alias("size_now"), F.col("mtime").alias("mtime_now"))
    return moved.join(now, moved["original_path"] == now["path"]).drop("path")


def stale(saved: DataFrame, listing: DataFrame, slack_seconds: float = 1.0) -> DataFrame:
    """Tables changed on disk since their snapshot, by more than the slack; times in seconds."""
    return saved.join(listing.select("path", F.col("mtime").alias("mtime_now")), "path").where(F.col("mtime_now") > F.col("mtime") + slack_seconds)


def outputs_of(listing: DataFrame, ids: DataFrame) -> DataFrame:
    """T5: files made for the given recordings: the name is the id, or the id and a dot with more."""
    name = F.substring_index("path", "/", -1)
    token = F.substring_index(name, ".", 1)
    return listing.join(ids, token == ids["id"], "left_semi")


def unique_files(files: DataFrame) -> DataFrame:
    """J7 for the files to move: each path once, the first by ``idx``."""
    return first_by(files, ["path"], "idx")


#: States of an entry and the state after each action.
TRANSITIONS = {("moving", "finalize"): "trashed", ("trashed", "restore"): "restored", ("restored", "redo"): "trashed", ("trashed", "purge"): "purged"}


def advance(entries: DataFrame, actions: DataFrame, key: str = "trash_id") -> DataFrame:
    """Entries with one action each applied; an action that the state doesn't allow changes nothing."""
    joined = entries.join(actions.select(key, "action"), key, "left")
    after = F.col("status")
    for (state, action), then in TRANSITIONS.items():
        after = F.when((F.col("status") == state) & (F.col("action") == action), F.lit(then)).otherwise(after)
    return joined.withColumn("status", after).drop("action")


def move(tables: dict[str, DataFrame], ids: DataFrame, files: DataFrame, trash_id: str, folder: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """J8, J9, T5 together: the tables without the recordings in ``ids``, their saved rows, and the files to move.

    Recordings with work under way stay (T4).  The files (path, size) get their place in the trash folder.
    """
    from .jobs import busy

    free = ids.join(busy(tables["jobs"]), ids["id"] == F.col("file_id"), "left_anti")
    moved = unique_files(outputs_of(files, free).withColumn("idx", F.lit(0)))
    moved = moved.select(F.lit(trash_id).alias("trash_id"), F.col("path").alias("original_path"), F.concat(F.lit(f"{folder.rstrip('/')}/{trash_id}/files"), "path").alias("trashed_path"), "size")
    return remove(tables, free), snapshot(tables, free), moved


def bring_back(current: dict[str, DataFrame], saved: dict[str, DataFrame], moved: DataFrame, listing: DataFrame, overwrite: bool = False) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """J10, J15 together: the tables with the saved rows again, the files to copy back, and those whose place is taken.

    With ``overwrite`` files whose place is taken are copied back too.
    """
    taken = collisions(moved, listing)
    back = moved if overwrite else moved.join(taken.select("original_path"), "original_path", "left_anti")
    return restore(current, saved), back, taken


def purge(entries: DataFrame, moved: DataFrame, trash_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries after purging those in ``trash_ids`` that are in the trash, and the trashed files to delete."""
    after = advance(entries, trash_ids.select("trash_id", F.lit("purge").alias("action")))
    gone = after.where("status = 'purged'").join(entries.where("status = 'trashed'").select("trash_id"), "trash_id", "left_semi")
    return after, moved.join(gone.select("trash_id"), "trash_id", "left_semi")
