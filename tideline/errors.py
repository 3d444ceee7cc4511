"""Errors that statements report, by number."""

from __future__ import annotations

PARSE, UNKNOWN_TABLE, TABLE_EXISTS, UNKNOWN_COLUMN, HAS_CHILDREN, BAD_PROPERTY = 1001, 1002, 1003, 1004, 1009, 1005
UNKNOWN_INDEX, INDEX_EXISTS, UNSUPPORTED, OUT_OF_RANGE, NULL_KEY, ARGUMENTS, CONFLICT = 1006, 1007, 1008, 2000, 2001, 1011, 1012


class EngineError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(f"E{code} - {message}")
        self.code = code
