"""Tables and enumerations of the symbol index."""

from __future__ import annotations

# The language of each file suffix (case counts) and of some whole file names.
SUFFIXES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".c": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cs": "c_sharp",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".ini": "ini",
    ".cfg": "ini",
    ".md": "markdown",
    ".db": "sqlite",
    ".html": "html",
    ".htm": "html",
    ".css": "css",
    ".scss": "scss",
    ".sass": "scss",
    ".less": "less",
    ".vue": "vue",
    ".svelte": "svelte",
    ".lua": "lua",
    ".zig": "zig",
    ".dart": "dart",
    ".sh": "bash",
    ".bash": "bash",
    ".zsh": "bash",
    ".fish": "fish",
    ".ps1": "powershell",
    ".bat": "batch",
    ".cmd": "batch",
    ".scala": "scala",
    ".groovy": "groovy",
    ".clj": "clojure",
    ".cljs": "clojure",
    ".cljc": "clojure",
    ".ex": "elixir",
    ".exs": "elixir",
    ".erl": "erlang",
    ".hrl": "erlang",
    ".hs": "haskell",
    ".ml": "ocaml",
    ".mli": "ocaml",
    ".pl": "perl",
    ".pm": "perl",
    ".r": "r",
    ".R": "r",
    ".nix": "nix",
    ".xml": "xml",
    ".plist": "xml",
    ".graphql": "graphql",
    ".gql": "graphql",
    ".proto": "proto",
    ".tf": "hcl",
    ".hcl": "hcl",
    ".sql": "sql",
    ".dockerfile": "dockerfile",
    ".mk": "make",
    ".make": "make",
}
FILE_NAMES = {
    "Dockerfile": "dockerfile",
    "Makefile": "make",
    "makefile": "make",
    "GNUmakefile": "make",
}

# Files never read, folders never entered, and the size from which a file is large.
SECRET_FILES = [".env", ".env.local", ".env.production", ".env.development"]
SKIPPED_FOLDERS = ["node_modules", "__pycache__", ".git", "dist", "build", ".venv", "venv"]
LARGE_FILE = 524_288

#: Languages whose call sites are collected.
CALL_LANGUAGES = ["python", "javascript", "typescript", "tsx", "go", "rust", "java", "c", "cpp"]
HEADER_KINDS = ["import", "variable"]

FILES = "file_path string, checksum string, git_head string, symbol_count int, language string, file_size bigint, mtime_ns bigint, indexed_at timestamp"
SYMBOLS = (
    "id bigint, name string, kind string, file_path string, start_line int, end_line int, signature string, docstring string, "
    "parent_name string, parent_id bigint, language string, checksum string, indexed_at timestamp"
)
CALLS = "id bigint, caller_id bigint, callee_name string, call_line int, file_path string"
VECTORS = "symbol_id bigint, embedding array<float>, file_path string"
POSTINGS = "term string, id bigint, field string, places array<int>, file_path string"
LENGTHS = "id bigint, length bigint, file_path string"
