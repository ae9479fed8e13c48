"""Table-valued extraction of symbols and call sites from source files."""
