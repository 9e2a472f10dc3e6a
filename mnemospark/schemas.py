"""Table schemas and operator defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "array<float>": T.ArrayType(T.FloatType()),
}


def _struct(columns: str) -> T.StructType:
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


DOCUMENTS = _struct(
    "id long, vault_path string, title string, summary string, note_type string, "
    "confidence double, created_at timestamp, updated_at timestamp, "
    "updated_by_human boolean, content_hash string, batch_id long, project string, "
    "status string, key_topics array<string>, full_body string, "
    "original_filename string, file_size_bytes long, blob_ref string, "
    "mime_type string, classify_content_hash string, classify_attempts int, "
    "classify_last_error string"
)

ENTRIES = _struct(
    "id long, dimension string, entity string, tag string, fact string, "
    "status string, confidence double, sources array<string>, reasoning string, "
    "created_at timestamp, updated_at timestamp, trust_score double, "
    "retrieval_score double"
)

CORRECTIONS = _struct(
    "id long, entry_id long, operation string, reason_category string, "
    "feedback string, old_fact string, new_fact string, old_trust_score double, "
    "new_trust_score double, created_at timestamp"
)

COMMENTS = _struct(
    "id long, entry_id long, comment_text string, created_at timestamp"
)

AUDIT = _struct(
    "id long, timestamp timestamp, pipeline string, stage string, "
    "source_ids array<string>, decision string, confidence double, "
    "reasoning string, outcome string, correlation_id string"
)

BATCHES = _struct(
    "batch_id long, folder_name string, destination_type string, "
    "destination_name string, confidence double, status string, file_count long, "
    "folder_path string, created_at timestamp"
)

# Kept so that old logs can be read; no operator produces or consumes it.
FIELD_CORRECTIONS = _struct(
    "id long, document_id long, field string, ai_value string, human_value string, "
    "created_at timestamp"
)

REPORTS = _struct(
    "id long, report_type string, title string, body string, prompt_used string, "
    "filters_used string, sources_used array<string>, created_at timestamp"
)

MANIFEST = _struct("vault_path string, hash string, size long, mtime double")

FILE_EVENTS = _struct(
    "ts timestamp, kind string, path string, new_path string, hash string"
)

VECTORS = _struct("id long, embedding array<float>")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``; columns it lacks become typed NULLs."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


@dataclass(frozen=True)
class Bands:
    """Confidence routing thresholds; ``suggest`` must lie below ``auto``."""

    auto: float = 0.85
    suggest: float = 0.60

    def __post_init__(self) -> None:
        if not self.suggest < self.auto:
            raise ValueError("suggest threshold must be below auto threshold")


@dataclass(frozen=True)
class TrustRules:
    confirm_delta: float = 0.05
    reject_delta: float = 0.10
    revise_base: float = 0.6
    overwrite_above: float = 0.5
    context_floor: float = 0.3
    volatile_count: int = 3
    few_shot_cap: int = 5


@dataclass(frozen=True)
class Defaults:
    bands: Bands = field(default_factory=Bands)
    trust: TrustRules = field(default_factory=TrustRules)
    rrf_k: int = 60
    search_candidates: int = 20
    search_results: int = 10
    fact_results: int = 20
    keyword_weight: float = 0.5
    entities_per_dimension: int = 15
    orientation_per_dimension: int = 5
    retrieval_decay: float = 0.95
    content_tokens: int = 10_000
    entries_per_dimension: int = 50
    classify_retries: int = 3
    debounce: str = "1 second"
    move_window_seconds: float = 2.0
    sweep_confirmations: int = 2
    folder_settle: str = "5 seconds"
    binary_settle_seconds: float = 5.0
    move_guard_seconds: float = 5.0
    max_file_bytes: int = 50 * 1024 * 1024
    describable_prefixes: tuple[str, ...] = ("image/",)
    describable_bytes: int = 10 * 1024 * 1024
    no_edit_extensions: tuple[str, ...] = ("pdf", "png", "jpg", "jpeg", "gif", "webp")
    office_extensions: tuple[str, ...] = ("md", "docx", "xlsx", "pptx", "txt")
    max_stem_length: int = 120


DEFAULTS = Defaults()
