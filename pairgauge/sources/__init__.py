"""Sources and sinks."""

from .config import settings
from .readers import block_text, documents_with_rows, first_existing, jsonl, shards, xml_files
from .writers import append_rows, append_stream, content_manifest, sort_keys, transform_files, write_files, write_json_document, write_jsonl, write_shards

__all__ = [
    "append_rows", "append_stream", "block_text", "content_manifest", "documents_with_rows", "first_existing", "jsonl", "settings", "shards", "sort_keys", "transform_files",
    "write_files", "write_json_document", "write_jsonl", "write_shards", "xml_files",
]
