"""Job state and file metadata (J11, J12, T1, T2, T4, A11, ST2 in batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..schemas import METADATA_COLUMNS

# States as written in job files.
QUEUED, CANCELLING, FAILED, RUNNING = "Na fila", "Cancelando", "Falha", "Rodando"
STALE_ERROR = "Tarefa interrompida (provável crash ou fechamento forçado)."
STEPS = (
    ("ready", "Pronto para revisar", "transcrição montada", 100),
    ("diarized", "Falantes identificados", "montar transcrição", 82),
    ("transcribed", "Transcrito", "identificar falantes", 65),
    ("prepared", "Áudio preparado", "transcrever", 20),
)
NOTHING = ("Pendente", "preparar áudio", 0)
CARRIED = ("last_error", "updated_at", "queued_at", "started_at", "finished_at")


def from_artifacts(ready: Column, diarized: Column, transcribed: Column, prepared: Column) -> Column:
    """Status, stage and progress from what exists, the most advanced first."""
    conditions = {"ready": ready, "diarized": diarized, "transcribed": transcribed, "prepared": prepared}

    def state(status: str, stage: str, progress: int) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(stage).alias("stage"), F.lit(progress).alias("progress"))

    out = None
    for name, *values in STEPS:
        out = (F if out is None else out).when(conditions[name], state(*values))
    return out.otherwise(state(*NOTHING))


def sync(derived: DataFrame, previous: DataFrame, key: str = "file_id") -> DataFrame:
    """Each selected file's job: queued, cancelling and failed ones stay; running ones were interrupted and are
    derived anew with an error; the others are derived anew and keep their error and times.

    ``derived`` has key, status, stage, progress, now; ``previous`` has key, status, stage, progress and times.
    """
    old = previous.select(F.col(key), *(F.col(c).alias(f"p_{c}") for c in ("status", "stage", "progress", *CARRIED)))
    joined = derived.join(old, key, "left")
    stays = F.coalesce(F.col("p_status").isin(QUEUED, CANCELLING, FAILED), F.lit(False))
    stale = F.coalesce(F.col("p_status") == RUNNING, F.lit(False))

    def pick(name: str) -> Column:
        return F.when(stays, F.col(f"p_{name}")).otherwise(F.col(name)).alias(name)

    return joined.select(
        key,
        *map(pick, ("status", "stage", "progress")),
        F.when(stays, F.col("p_updated_at")).when(stale, F.col("now")).otherwise(F.coalesce("p_updated_at", "now")).alias("updated_at"),
        F.when(stale, F.lit(STALE_ERROR)).otherwise(F.coalesce("p_last_error", F.lit(""))).alias("last_error"),
        F.col("p_queued_at").alias("queued_at"),
        F.col("p_started_at").alias("started_at"),
        F.when(~stale, F.col("p_finished_at")).alias("finished_at"),
    )


def busy(jobs: DataFrame, key: str = "file_id") -> DataFrame:
    """T4: files with work queued, running or being cancelled."""
    return jobs.where(F.col("status").isin(QUEUED, RUNNING, CANCELLING)).select(key)


def latest(events: DataFrame, key: str = "file_id", at: str = "updated_at", order: str = "seq") -> DataFrame:
    """ST2 in batch: the last event of each file by time, then by sequence."""
    values = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(at, order)).alias("e"))
    return last.select(key, "e.*")


def stage_counts(log: DataFrame) -> DataFrame:
    """How often each stage ended in each status."""
    return log.groupBy("stage", "status").agg(F.count("*").alias("n"))


def upsert(base: DataFrame, updates: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows of ``base`` with the listed columns overwritten by non-null updates; unknown keys are added."""
    new = updates.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = base.join(new, key, "full_outer")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def sync_metadata(manifest: DataFrame, previous: DataFrame, defaults: dict[str, str], source_columns: tuple[str, ...], key: str = "file_id") -> DataFrame:
    """A metadata row for each manifest row: source columns from the manifest, others the previous value if not
    empty, else the default (``{key}`` stands for the file's id).  Rows that left the manifest are gone."""
    own = tuple(c for c in (previous.columns if not defaults else defaults) if c not in source_columns and c != key)
    old = previous.select(F.col(key), *((F.col(c) if c in previous.columns else F.lit(None).cast("string")).alias(f"__{c}") for c in own))
    joined = manifest.join(old, key, "left")

    def value(name: str) -> Column:
        default = F.col(key) if defaults.get(name) == "{key}" else F.lit(defaults.get(name, ""))
        return F.coalesce(blank_to_null(F.col(f"__{name}")), default.cast("string")).alias(name)

    return joined.select(key, *source_columns, *map(value, own))


def default_metadata(language: str = "auto", labels: tuple[str, ...] = ("Falante 1", "Falante 2")) -> dict[str, str]:
    """The settings of a new file."""
    settings = dict.fromkeys(METADATA_COLUMNS[METADATA_COLUMNS.index("language") :], "")
    return {"title": "{key}", **settings, "language": language, "speaker_mode": "auto", "speaker_labels": "|".join(labels), "context_mode": "empty", "use_context_as_prompt": "false"}
