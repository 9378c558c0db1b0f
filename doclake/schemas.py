"""Table shapes and the fixed values that results depend on."""

from __future__ import annotations

# Sizes and limits that decide results.
CHUNK_TOKENS = 462
OVERLAP_TOKENS = 50
MIN_CHUNK_TOKENS = 10
SPECIAL_TOKENS = 2
EMBEDDING_DIM = 384
ENCODE_BATCH = 32
TOP_K = 5
DOCUMENT_BUCKETS = 64
CONTEXT_TOKENS = 3000
MAX_FILE_BYTES = 26_214_400
MIN_OVERLAP = 0.15
DEFAULT_TENANT = "default"
DEFAULT_CHUNK_TYPE = "paragraph"
DEFAULT_SOURCE_TYPE = "url"
FILE_TYPES = ("pdf", "docx", "xlsx", "csv")

# Texts that callers compare against.
REFUSAL = "I don't have enough information in the provided document(s) to answer this question."
BLANK_ANSWER = "Please provide a valid question."
ERROR_ANSWER = "Sorry, an error occurred while answering this question."
CONTEXT_SEPARATOR = "\n\n---\n\n"
UNKNOWN_FORMAT = "Could not identify the document format (unsupported or unrecognized file type)"
PASSWORD_PROTECTED = "This PDF is password-protected and cannot be read without the correct password."
UNREADABLE = "This file could not be read as a valid {} document."
TOO_LARGE = "File exceeds the maximum allowed size of {} bytes."

# Reasons a file lands in the rejects table.
REASON_SIZE = "too_large"
REASON_UNKNOWN = "unknown_format"
REASON_UNREADABLE = "unreadable"
REASON_PASSWORD = "password_protected"
REASON_NO_DECODER = "no_decoder"

DOCUMENTS = (
    "document_id string, tenant_id string, source_type string, source_uri string, "
    "checksum string, created_at timestamp, version int"
)
SECTIONS = (
    "document_id string, tenant_id string, position int, text string, section_type string, "
    "page_number int, sheet_name string"
)
CHUNKS = (
    "document_id string, tenant_id string, chunk_index int, chunk_text string, text_hash string, "
    "page_number int, chunk_type string, sheet_name string, embedding array<float>"
)
QUESTIONS = (
    "query_id string, pos int, document_id string, tenant_id string, namespace string, question string"
)
MEMO = "memo_key string, embedding array<float>"
TOMBSTONES = "document_id string, tenant_id string, generation int"
REJECTS = "source_uri string, file_type string, reason string, message string"
SOURCE_REF = "struct<source int, document_id string, source_uri string, page_number int, sheet_name string>"
ANSWERS = f"query_id string, answer string, sources array<{SOURCE_REF}>, low_confidence boolean, status string"
