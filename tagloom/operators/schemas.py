"""Schemas of the tables that operators exchange."""

POSITION = "struct<line: bigint, character: bigint>"
FILES = "path string, content string"
COMMENTS = f"path string, seq int, start {POSITION}, end {POSITION}, byte_start bigint, byte_end bigint, text string"
CHANGES = "path string, line bigint, ranges array<struct<s: int, e: int>>"
BLOCKS = (
    f"path string, ordinal int, attrs map<string, string>, tag_start {POSITION}, tag_end {POSITION}, "
    f"content string, content_byte_start bigint, content_byte_end bigint, content_start {POSITION}, content_end {POSITION}, error string"
)
#: Every check returns these columns; a row with an error stands for a run that can't go on.
VIOLATIONS = f"path string, start {POSITION}, end {POSITION}, code string, message string, severity tinyint, data string, error string"
UNNAMED = "(unnamed)"
