"""Typed failures of whole files, and the two ways to treat them."""

from __future__ import annotations


class FormatError(ValueError):
    """A malformed, hostile or unsupported input; code is stable and upper-case."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


def require(ok: object, code: str, message: str = "") -> None:
    if not ok:
        raise FormatError(code, message)
