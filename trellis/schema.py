"""Tables of a code graph."""

from __future__ import annotations

FILES = "file_id bigint, path string, language string, content_hash bigint"
SYMBOLS = "symbol_id bigint, name string, kind string, file_id bigint, span struct<start_byte:bigint,end_byte:bigint,start_row:bigint,start_col:bigint>"
IMPORTS = "src bigint, dst bigint, confidence string, seq bigint"
CALLS = "src bigint, dst bigint, confidence string, seq bigint"
DIAGNOSTICS = "kind string, file_id bigint, message string, seq bigint"
TOKEN_EVENTS = "session_id string, seq int, at bigint, files_injected int, files_deduped int, est_tokens_injected bigint, est_tokens_saved bigint"

RESOLVED, HEURISTIC = "Resolved", "Heuristic"
UNRESOLVED_IMPORT, PARSE_ERROR = "UnresolvedImport", "ParseError"
#: The kinds of symbols.
SYMBOL_KINDS = ("Function", "Method", "Class", "Struct", "Interface", "Enum", "Constant", "Variable", "Module", "Other")

_SPAN = "struct<start_byte:bigint,end_byte:bigint,start_row:bigint,start_col:bigint>"
EXTRACTION = (
    "path string, language string, mtime_ns bigint, size bigint, content_hash bigint, package string,"
    f" symbols array<struct<name:string,kind:string,span:{_SPAN}>>,"
    f" imports array<struct<specifier:string,span:{_SPAN}>>,"
    f" calls array<struct<caller:int,callee:string,span:{_SPAN}>>"
)
