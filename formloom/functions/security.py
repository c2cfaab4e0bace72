"""Predicates that reject hostile markup, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns in the order in which they are tried, and their error codes.
EXTERNAL_HREF = r"""(?:xlink:)?href\s*=\s*["']([^"'#][^"']*)["']"""


def svg_flags(text: Column) -> dict[str, Column]:
    return {
        "has_entity": F.contains(text, F.lit("<!ENTITY")), "has_doctype": F.contains(text, F.lit("<!DOCTYPE")),
        "has_script": text.rlike("(?i)<script"), "has_foreign_object": text.rlike("(?i)<foreignObject"), "has_external_href": text.rlike(EXTERNAL_HREF),
    }


def svg_error(text: Column) -> Column:
    """The first reason to refuse a document, or null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, flag in svg_flags(text).items():
        out = out.when(flag, name.removeprefix("has_").upper())
    return out


def entry_name_error(name: Column) -> Column:
    """Why an archive entry's name is refused, or null; backslashes count as slashes."""
    n = F.regexp_replace(name, r"\\", "/")
    return (F.when(F.length(n) == 0, "ENTRY_NAME_EMPTY").when(n.rlike("\x00"), "ENTRY_NAME_NUL").when(n.startswith("/"), "ENTRY_NAME_ABSOLUTE")
            .when(n.rlike("^[A-Za-z]:"), "ENTRY_NAME_DRIVE").when(n.rlike(r"(^|/)\.\.(/|$)"), "ENTRY_NAME_TRAVERSAL"))
