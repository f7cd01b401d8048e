"""Fixed schemas of link exports, imports and side tables."""

from __future__ import annotations

from pyspark.sql import types as T

EXPORT_COLUMNS = ("id", "title", "note", "excerpt", "url", "folder", "tags", "created", "cover", "highlights", "favorite")
IMPORT_COLUMNS = ("url", "folder", "title", "note", "tags", "created")


def _strings(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


EXPORT_CSV = _strings(EXPORT_COLUMNS)
IMPORT_CSV = _strings(IMPORT_COLUMNS)

METADATA = "title string, description string, keywords array<string>, author string, publication_date timestamp, canonical_url string"
STATUS = (
    "url_validated boolean, url_validation_error string, content_extracted boolean, content_extraction_error string, "
    "ai_processed boolean, ai_processing_error string, tags_optimized boolean, processing_attempts int, last_attempt timestamp"
)
BOOKMARK = (
    "pos long, source_file string, id string, title string, note string, excerpt string, url string, folder string, tags array<string>, "
    "created timestamp, cover string, highlights string, favorite boolean, enhanced_description string, optimized_tags array<string>, "
    f"extracted_metadata struct<{METADATA.replace(' string', ': string').replace(' array', ': array').replace(' timestamp', ': timestamp')}>, "
    f"processing_status struct<{', '.join(': '.join(c.split(' ')) for c in STATUS.split(', '))}>, normalized_url string, folder_hierarchy array<string>"
)
VALIDATION = (
    "url string, is_valid boolean, status_code int, final_url string, response_time double, error_message string, error_type string, "
    "content_type string, content_length long, timestamp timestamp, security struct<is_safe: boolean, risk_level: string, issues: array<string>, blocked_reason: string>"
)
CONTENT = (
    "url string, title string, meta_description string, meta_keywords string, main_content string, headings array<string>, links array<string>, "
    "images array<string>, content_categories array<string>, content_type string, language string, word_count int, reading_time_minutes int, quality_score double"
)
PROCESSED = "url string, content_hash string, processed_at timestamp, ai_engine string, description string, tags string, folder string, title string, status string"
RUNS = "id long, started_at timestamp, completed_at timestamp, source string, total_processed long, total_succeeded long, total_failed long, config_hash string"
HISTORY = "id long, url string, run_id long, content_hash string, description string, tags string, folder string, title string, changed_at timestamp, change_type string"
COST = "timestamp timestamp, provider string, model string, input_tokens long, output_tokens long, cost_usd double, operation_type string, bookmark_count long, success boolean"
