"""Explicit schemas of the tables (D1-D22).  CSV tables are all strings; typed views are projections of them."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed column lists: the file formats.
PROBE_COLUMNS = [
    "duration_sec", "source_audio_streams", "source_audio_codec", "source_sample_rate", "source_audio_channels", "source_channel_layout", "source_bit_rate",
    "source_video_streams", "source_video_codec", "source_video_width", "source_video_height", "source_video_frame_rate", "source_format_name", "source_format_long_name", "probe_status",
]
MANIFEST_COLUMNS = [
    "interview_id", "person_folder", "source_path", "source_ext", "source_kind", "selected", "duplicate_of", "source_size_bytes", "source_mtime_utc", "source_sha256",
    *PROBE_COLUMNS, "wav_path", "has_tcle", "tcle_path", "status", "notes",
]
METADATA_COLUMNS = [
    "file_id", "title", "source_path", "person_folder", "source_ext", "source_kind", "source_size_bytes", "source_mtime_utc", *PROBE_COLUMNS,
    "language", "speaker_mode", "speaker_count", "min_speakers", "max_speakers", "speaker_labels", "context_mode", "context_text", "use_context_as_prompt", "notes", "updated_at",
]
SPEAKER_MAP_COLUMNS = ["interview_id", "speaker_label", "human_label", "confidence", "notes"]
TURN_COLUMNS = ["interview_id", "turn_id", "start", "end", "start_timestamp", "end_timestamp", "speaker", "human_label", "flags", "notes", "text"]
QC_COLUMNS = [
    "interview_id", "canonical_exists", "raw_json_exists", "wav_exists", "source_duration_sec", "turn_count", "speaker_count", "speaker_time_ratio_max", "last_timestamp_sec",
    "duration_delta_sec", "coverage_ratio", "max_gap_sec", "long_turns", "empty_turns", "timestamp_regressions", "unknown_speakers", "missing_human_labels", "raw_segment_count",
    "raw_segments_without_speaker", "raw_word_count", "raw_word_score_mean", "raw_avg_logprob_mean", "diarization_regular_exists", "diarization_exclusive_exists", "notes",
]


def strings(columns: list[str]) -> T.StructType:
    """A schema of string columns."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


MANIFEST, METADATA, SPEAKER_MAP, QC = map(strings, (MANIFEST_COLUMNS, METADATA_COLUMNS, SPEAKER_MAP_COLUMNS, QC_COLUMNS))
WORD = "struct<word:string,start_ms:bigint,end_ms:bigint,score:double>"
SEGMENT = "interview_id string, idx int, start_ms bigint, end_ms bigint, speaker string, text string, needs_review boolean, note string, avg_logprob double"
SPAN = "interview_id string, kind string, idx int, start_ms bigint, end_ms bigint, speaker string"
TURN = "struct<start_ms:bigint,end_ms:bigint,speaker:string,human_label:string,text:string,flags:array<string>,notes:string,segments:int>"
EDIT = "interview_id string, seq bigint, at timestamp, action string, turn_id string, payload map<string,string>"
JOB = "file_id string, status string, stage string, progress int, duration_sec string, updated_at timestamp, last_error string, queued_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, estimated_finish_at timestamp_ntz"
LOG = "interview_id string, stage string, status string, started_at timestamp, model string, backend string, language string, compute_type string, batch_size int, variant string, output_dir string, returncode int, progress int, message string"
