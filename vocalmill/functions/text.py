"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels shown to readers.
DISPLAY_LABELS = {"ENTREVISTADOR": "Entrevistador", "ENTREVISTADO": "Entrevistado"}
FLAG_LABELS = {"inaudivel": "Inaudível", "duvida": "Dúvida", "sobreposicao": "Sobreposição"}
SECRET = "hf_[A-Za-z0-9]{8,}"

_SPACE = r"(?U)[\s\x1c-\x1f]+"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def collapse(text: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def sentences(text: Column) -> Column:
    """The sentences of a text; a text without a boundary is one."""
    parts = F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def ends_sentence(text: Column) -> Column:
    return text.rlike(r"[.!?]\s*$")


def join_text(left: Column, right: Column) -> Column:
    """Two texts with a space between, without one where a side is empty."""
    return F.trim(F.concat_ws(" ", blank_to_null(left), blank_to_null(F.trim(right))))


def clean_flags(flags: Column) -> Column:
    return F.coalesce(F.filter(F.transform(flags, lambda x: F.trim(x)), lambda f: f != ""), F.array().cast("array<string>"))


def flag_text(flags: Column) -> Column:
    """Flags in brackets by their shown labels."""
    return F.array_join(F.transform(clean_flags(flags), lambda f: F.concat(F.lit("["), F.coalesce(_map(FLAG_LABELS)[f], f), F.lit("]"))), " ")


def shows(text: Column, flags: Column) -> Column:
    """Whether a text or its flags show anything, that is, whether they joined as text are not empty.

    For filters: these are pushed below the projection that makes the text, and would make it again, several times over.
    """
    return F.coalesce(text, F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]") | (F.size(clean_flags(flags)) > 0)


def display_label(label: Column) -> Column:
    """The shown form of a speaker label, looked up without regard to case."""
    clean = collapse(label)
    return F.coalesce(_map(DISPLAY_LABELS)[F.upper(clean)], clean)


def editorial_key(human_label: Column, speaker: Column) -> Column:
    """Turns with the same key are the same speaker to a reader."""
    return F.coalesce(blank_to_null(F.upper(collapse(F.coalesce(human_label, F.lit(""))))), speaker, F.lit("SPEAKER_UNKNOWN"))


def speaker_order(label: Column) -> list[Column]:
    """Sort columns; numbered speakers first, by number."""
    number = F.try_to_number(blank_to_null(F.regexp_extract(label, r"^SPEAKER_(\d+)$", 1)), F.lit("9" * 18))
    return [number.isNull().cast("int"), number, label]


def subtitle_text(human_label: Column, speaker: Column, text: Column, flags: Column) -> Column:
    """P12: "Label: body [flags]", empty only without text and flags."""
    body = join_text(collapse(F.coalesce(text, F.lit(""))), flag_text(flags))
    label = display_label(F.coalesce(blank_to_null(human_label), blank_to_null(speaker), F.lit("Falante")))
    return F.when(body == "", F.lit("")).otherwise(F.trim(F.concat(label, F.lit(": "), body)))


def cue_safe(text: Column) -> Column:
    """A text that can't end a cue: no arrow, no line break."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("-->"), F.lit("->")), r"[\r\n]+", " "))


def cell_safe(text: Column) -> Column:
    """A text for one cell of a tab-separated row."""
    return F.trim(F.regexp_replace(text, r"[\t\r\n]", " "))


def join_words(words: Column) -> Column:
    """Words with spaces between, but none before closing punctuation."""
    return collapse(F.regexp_replace(F.array_join(F.filter(F.transform(words, lambda x: F.trim(x)), lambda w: w != ""), " "), r" (?=[,.;:!?%)])", ""))


def preview(text: Column, limit: int = 120) -> Column:
    """P20: the text, shortened with dots beyond the limit."""
    clean = collapse(text)
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.rtrim(F.left(clean, F.lit(limit - 3))), F.lit("...")))


def title(text: Column, limit: int = 200) -> Column:
    """Printable characters, trimmed, cut at the limit; as (title, truncated).

    Control, format, surrogate, unassigned and separator characters but the space count as not printable.
    """
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{C}\p{Zl}\p{Zp}[\p{Zs}&&[^ ]]]", ""))
    return F.struct(F.rtrim(F.left(clean, F.lit(limit))).alias("title"), (F.length(clean) > limit).alias("truncated"))


def safe_name(text: Column, default: str = "item") -> Column:
    """P25: a file name of letters, digits, dot, dash and underscore, without dots or underscores at its ends."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(blank_to_null(clean), F.lit(default))


def safe_folder(text: Column, default: str = "Projeto de Transcricoes") -> Column:
    """P25: a folder name; letters and digits of any script, space, dash and underscore stay."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N} _-]", "_"), r"^[ ._]+|[ ._]+$", "")
    return F.concat(F.coalesce(blank_to_null(clean), F.lit(default)), F.lit(".transcricao"))


def is_safe_id(text: Column) -> Column:
    """P25: whether an id can be part of a path."""
    return text.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$") & ~text.contains("..")


def redact(text: Column) -> Column:
    """Access tokens replaced."""
    return F.regexp_replace(text, SECRET, "hf_***")


def progress_percent(text: Column) -> Column:
    """The last percentage in a message, 0 to 100; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{1,3})\s*%"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1)).cast("int")
    return F.when(last.isNotNull(), F.least(last, F.lit(100)))


def size_text(size: Column) -> Column:
    """Bytes in the largest fitting unit; ties are rounded to even."""
    size = size.cast("double")
    out = F.when(size < 1024, F.concat(size.cast("bigint").cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB")):
        out = out.when(size < 1024 ** (power + 1), F.concat(F.format_string("%.1f", F.bround(size / 1024**power, 1)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.2f", F.bround(size / 1024**3, 2)), F.lit(" GB")))


def duration_text(seconds: Column) -> Column:
    """Minutes and seconds, with hours where there are any."""
    total = F.rint(seconds).cast("bigint")
    hours, minutes, rest = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    return F.when(hours > 0, F.format_string("%dh %02dmin", hours, minutes)).otherwise(F.format_string("%dmin %02ds", minutes, rest))


def tail(text: Column, limit: int) -> Column:
    """The last characters."""
    return F.right(text, F.lit(limit))


def folded(column: Column) -> Column:
    """A trimmed text without regard to case, by Unicode's full mappings (ß meets SS, the final sigma any other), not letter by letter.

    Case-insensitive collations keep ß and SS apart.  Upper case joins all but two letters that have no lower case of their own.
    """
    upper = F.upper(F.trim(column))
    return F.replace(F.replace(upper, F.lit("\u0130"), F.lit("I\u0307")), F.lit("\u1e9e"), F.lit("SS"))
