"""Names of media files, probe values and settings."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, collapse

# What counts as media, and the form of names.
VIDEO_EXTENSIONS = (".mov", ".mp4")
MEDIA_ID = r"(?i)^([A-Z]\d{2}[RP]_\d{4})(?:_(A|V))?"
CONSENT_ID = r"(?i)^([A-Z]\d{2}[RP])_(\d{4})"
DEFAULT_LABELS = ("Entrevistador", "Entrevistado")
LANGUAGES = {"auto": "Automático", "pt": "Português", "en": "Inglês", "es": "Espanhol", "fr": "Francês", "de": "Alemão", "it": "Italiano"}


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The extension with its dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def media_id(path: Column) -> Column:
    """The interview's id at the start of a file name, upper case, else the stem."""
    return F.coalesce(blank_to_null(F.upper(F.regexp_extract(stem(path), MEDIA_ID, 1))), stem(path))


def media_kind(path: Column) -> Column:
    """The kind that the name states, else that of the extension."""
    stated = blank_to_null(F.upper(F.regexp_extract(stem(path), MEDIA_ID, 2)))
    return F.coalesce(stated, F.when(extension(path).isin(*VIDEO_EXTENSIONS), F.lit("V")).otherwise(F.lit("AUDIO")))


def code_part(interview_id: Column) -> Column:
    """What stands before the first underscore, upper case."""
    return F.upper(F.substring_index(interview_id, "_", 1))


def number_text(value: Column, digits: int = 3) -> Column:
    """P5: a number with fixed decimals, empty where it is none; decimals are taken by decimal rounding."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit("")).otherwise(F.format_string(f"%.{digits}f", number))


def frame_rate_text(value: Column) -> Column:
    """A fraction a/b with three decimals, empty if bad or over zero."""
    top, bottom = F.split_part(value, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(value, F.lit("/"), F.lit(2)).try_cast("double")
    rate = F.when(F.contains(value, F.lit("/")), F.try_divide(top, bottom)).otherwise(value.try_cast("double"))
    return number_text(F.nullif(rate, F.lit(0.0)))


def media_label(ext: Column, wav_exists: Column) -> Column:
    """Kind and extension, and whether the prepared audio exists."""
    bare = F.lower(F.ltrim(ext, F.lit(".")))
    kind = F.when(F.concat(F.lit("."), bare).isin(*VIDEO_EXTENSIONS), F.lit("Vídeo ")).otherwise(F.lit("Áudio "))
    ready = F.when(wav_exists & (bare != "wav"), F.lit(" (WAV pronto)")).otherwise(F.lit(""))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit("")).otherwise(F.concat(kind, F.upper(bare), ready))


def label_list(labels: Column) -> Column:
    """The labels of a cell that separates them by bars; the default ones if there are none."""
    found = F.filter(F.transform(F.split(F.coalesce(labels, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, DEFAULT_LABELS)))


def _value(column: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(column), F.lit(default))


def metadata_display(language: Column, speaker_mode: Column, speaker_count: Column, min_speakers: Column, max_speakers: Column, labels: Column, context_mode: Column, context_text: Column) -> Column:
    """Settings of a file as shown in lists."""
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    code = _value(language, "auto")
    speakers = F.when(speaker_mode == "exact", _value(speaker_count, "exato")).when(speaker_mode == "range", F.concat(_value(min_speakers, "?"), F.lit("-"), _value(max_speakers, "?"))).otherwise(F.lit("Automático"))
    context = F.when((context_mode == "custom") & (F.coalesce(context_text, F.lit("")) != ""), F.lit("Personalizado")).when(context_mode == "project", F.lit("Projeto")).otherwise(F.lit("Vazio"))
    return F.struct(F.coalesce(names[code], code).alias("language"), speakers.alias("speakers"), F.array_join(label_list(labels), ", ").alias("speaker_labels"), context.alias("context"))


def effective_config(base: dict, language: Column, speaker_mode: Column, speaker_count: Column, min_speakers: Column, max_speakers: Column, use_prompt: Column, context_text: Column, labels: Column) -> Column:
    """The settings that apply to one file: its own over the project's."""

    def given(name: str, kind: str = "int") -> Column:
        return F.lit(base.get(name)).cast(kind)

    code, mode = F.trim(F.coalesce(language, F.lit(""))), F.trim(F.coalesce(speaker_mode, F.lit("")))
    asr = F.when((code == "") | (code == "project"), given("asr_language", "string")).when(code != "auto", code)
    count = F.coalesce(speaker_count.try_cast("int"), given("diarization_num_speakers"), F.lit(2))
    low = F.coalesce(min_speakers.try_cast("int"), given("min_speakers"), F.lit(1))
    high = F.coalesce(max_speakers.try_cast("int"), given("max_speakers"), low)

    def by_mode(exact: Column, ranged: Column, other: Column) -> Column:
        return F.when(mode == "auto", F.lit(None).cast("int")).when(mode == "exact", exact).when(mode == "range", ranged).otherwise(other)

    prompt = F.when((use_prompt == "true") & (F.coalesce(context_text, F.lit("")) != ""), collapse(context_text)).otherwise(given("asr_initial_prompt", "string"))
    return F.struct(
        asr.alias("asr_language"),
        by_mode(count, F.lit(None).cast("int"), given("diarization_num_speakers")).alias("num_speakers"),
        by_mode(count, low, given("min_speakers")).alias("min_speakers"),
        by_mode(count, high, given("max_speakers")).alias("max_speakers"),
        prompt.alias("asr_initial_prompt"),
        label_list(labels).alias("speaker_labels"),
    )


def speaker_arguments(num_speakers: Column, min_speakers: Column, max_speakers: Column) -> Column:
    """An exact number of speakers overrides bounds."""
    none = F.lit(None).cast("int")
    return F.struct(num_speakers.alias("num_speakers"), F.when(num_speakers.isNull(), min_speakers).otherwise(none).alias("min_speakers"), F.when(num_speakers.isNull(), max_speakers).otherwise(none).alias("max_speakers"))


def override(base: Column, own: Column) -> Column:
    """A later value that isn't null wins."""
    return F.coalesce(own, base)


def merged_config(*layers: dict | None) -> dict:
    """P40 for settings on the driver."""
    out: dict = {}
    for layer in layers:
        out |= {k: v for k, v in (layer or {}).items() if v is not None}
    return out


def config_hash(config: dict) -> str:
    """The first 16 hex digits of the SHA-256 of the settings as key-sorted JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def file_hash(content: Column) -> Column:
    """The SHA-256 of a file's bytes."""
    return F.sha2(content, 256)


def iso_utc(at: Column) -> Column:
    """A timestamp as UTC text with seconds, in a UTC session."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def relative_path(path: Column, root: str) -> Column:
    """The path below a root; others stay."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)
