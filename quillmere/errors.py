"""Errors with a code and, for queries, the span of bytes that is at fault."""

from __future__ import annotations


class QuillmereError(Exception):
    code = "INVALID"

    def __init__(self, message: str, pos: int = -1, length: int = 0):
        super().__init__(message if pos < 0 else f"{message} (at byte {pos})")
        self.message, self.pos, self.length = message, pos, length


class ParseError(QuillmereError):
    code = "PARSE"


class TypeMismatch(QuillmereError):
    code = "TYPE"


class Unsupported(QuillmereError):
    code = "UNSUPPORTED"


class LimitExceeded(QuillmereError):
    code = "LIMIT"


class AlreadyExists(QuillmereError):
    code = "EXISTS"


class NotFound(QuillmereError):
    code = "NOT_FOUND"


class Busy(QuillmereError):
    code = "BUSY"
