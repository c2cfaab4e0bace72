"""TOML, YAML (core schema) and XML as trees, flattened to rows, and their canonical texts."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from datetime import date, datetime, time

from formloom.errors import FormatError, require

MAX_DEPTH, MAX_ALIASES, MAX_NODES = 64, 1_000, 1_000_000


def flat(value, path: str = "$", depth: int = 0) -> Iterator[tuple[str, str, str]]:
    """path, type and text of every leaf, containers without members included."""
    require(depth <= MAX_DEPTH, "TREE_TOO_DEEP")
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from flat(v, f"{path}.{k}", depth + 1)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from flat(v, f"{path}[{i}]", depth + 1)
    else:
        yield path, kind(value), shown(value)


def kind(v) -> str:
    for t, name in ((bool, "boolean"), (int, "integer"), (float, "float"), (str, "string"), (datetime, "datetime"), (date, "date"), (time, "time"), (dict, "object"), (list, "array")):
        if isinstance(v, t):
            return name
    return "null"


def shown(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("inf" if v > 0 else "-inf") if math.isinf(v) else repr(v)
    if isinstance(v, (datetime, date, time)):
        return v.isoformat()
    return "" if isinstance(v, (dict, list)) else str(v)


# TOML ----------------------------------------------------------------------------------------


def parse_toml(text: str) -> dict:
    import tomllib

    try:
        out = tomllib.loads(text.removeprefix("﻿"))
    except (tomllib.TOMLDecodeError, RecursionError) as e:
        raise FormatError("TOML_PARSE_ERROR", str(e)) from None
    for _, k, v in flat(out):
        require(k != "integer" or -(1 << 63) <= int(v) < 1 << 63, "TOML_INTEGER_RANGE", v)
    return out


def _toml_key(k: str) -> str:
    return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else _quoted(k)


def _quoted(s: str) -> str:
    return json.dumps(s, ensure_ascii=False).replace("\x7f", "\\u007f")


def _toml_value(v) -> str:
    if isinstance(v, str):
        return _quoted(v)
    if isinstance(v, list):
        return "[" + ", ".join(map(_toml_value, v)) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{_toml_key(k)} = {_toml_value(x)}" for k, x in v.items()) + "}"
    return shown(v)


def build_toml(tree: dict, path: str = "") -> str:
    """Values, then tables, then arrays of tables, each in the order given."""
    tables = lambda v: isinstance(v, list) and v and all(isinstance(x, dict) for x in v)
    out = "".join(f"{_toml_key(k)} = {_toml_value(v)}\n" for k, v in tree.items() if not isinstance(v, dict) and not tables(v))
    for k, v in tree.items():
        if isinstance(v, dict):
            out += f"\n[{path}{_toml_key(k)}]\n" + build_toml(v, f"{path}{_toml_key(k)}.")
    for k, v in tree.items():
        if tables(v):
            for x in v:
                out += f"\n[[{path}{_toml_key(k)}]]\n" + build_toml(x, f"{path}{_toml_key(k)}.")
    return out


# YAML ----------------------------------------------------------------------------------------

#: The core schema's plain scalars, in the order in which they are tried.
_CORE = [(re.compile(r"(?:~|null|Null|NULL|)"), lambda s: None), (re.compile("true|True|TRUE"), lambda s: True), (re.compile("false|False|FALSE"), lambda s: False),
         (re.compile(r"[-+]?(?:0|[1-9][0-9]*)"), int), (re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?"), lambda s: s if re.fullmatch("[-+]?0[0-9]+", s) else float(s)),
         (re.compile(r"[-+]?\.(?:inf|Inf|INF)"), lambda s: -math.inf if s[0] == "-" else math.inf), (re.compile(r"\.(?:nan|NaN|NAN)"), lambda s: math.nan)]
#: Strings that other YAML versions read as something else.
_AMBIGUOUS = re.compile(r"(?i)y|n|yes|no|on|off|true|false|null|~|0x[0-9a-f]+|0o?[0-7]+|[-+]?[0-9_]+(:[0-9_]+)+|[-+]?\.?[0-9][0-9_]*(\.[0-9_]*)?(e[-+]?[0-9]+)?|[-+]?\.(inf|nan)|<<|=")


def plain(s: str):
    """What an unquoted scalar stands for."""
    for p, make in _CORE:
        if p.fullmatch(s):
            return make(s)
    return s


def parse_yaml(text: str):
    """One document; merge keys, duplicate and complex keys and unknown tags are refused."""
    import yaml

    tags = {f"tag:yaml.org,2002:{t}" for t in ("str", "int", "float", "bool", "null", "seq", "map")}
    try:
        events = list(yaml.parse(text.removeprefix("﻿"), Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)))
    except yaml.YAMLError as e:
        raise FormatError("YAML_PARSE_ERROR", str(e)) from None
    require(sum(isinstance(e, yaml.DocumentStartEvent) for e in events) <= 1, "YAML_MULTI_DOCUMENT")
    require(sum(isinstance(e, yaml.AliasEvent) for e in events) <= MAX_ALIASES, "YAML_ALIAS_LIMIT")
    anchors, size, at = {}, {}, 0
    nodes = 0

    def read(depth: int):
        nonlocal at, nodes
        require(depth <= MAX_DEPTH, "YAML_TOO_DEEP")
        e, at = events[at], at + 1
        if isinstance(e, yaml.AliasEvent):
            require(e.anchor in anchors, "YAML_UNKNOWN_ALIAS", e.anchor)
            nodes += size[e.anchor]
            require(nodes <= MAX_NODES, "YAML_ALIAS_BOMB")
            return anchors[e.anchor]
        before = nodes
        nodes += 1
        require(nodes <= MAX_NODES, "YAML_TOO_LARGE")
        require(e.tag is None or e.tag == "!" or e.tag in tags, "YAML_TAG", str(e.tag))
        if isinstance(e, yaml.ScalarEvent):
            v = _tagged(e.value, (e.tag or "").rpartition(":")[2]) if e.tag and e.tag != "!" else plain(e.value) if e.implicit[0] and not e.style and e.tag != "!" else e.value
        elif isinstance(e, yaml.SequenceStartEvent):
            v = []
            while not isinstance(events[at], yaml.SequenceEndEvent):
                v.append(read(depth + 1))
            at += 1
        else:
            v = {}
            while not isinstance(events[at], yaml.MappingEndEvent):
                require(isinstance(events[at], (yaml.ScalarEvent, yaml.AliasEvent)), "YAML_COMPLEX_KEY")
                merge = isinstance(events[at], yaml.ScalarEvent) and not events[at].style and events[at].value == "<<"
                require(not merge, "YAML_MERGE_KEY")
                k = read(depth + 1)
                require(not isinstance(k, (dict, list)), "YAML_COMPLEX_KEY")
                k = shown(k)
                require(k not in v, "YAML_DUPLICATE_KEY", k)
                v[k] = read(depth + 1)
            at += 1
        if getattr(e, "anchor", None):
            anchors[e.anchor], size[e.anchor] = v, nodes - before
        return v

    starts = [i for i, e in enumerate(events) if isinstance(e, yaml.DocumentStartEvent)]
    if not starts:
        return None
    at = starts[0] + 1
    return read(0)


def _tagged(s: str, tag: str):
    v = plain(s)
    if tag == "str":
        return s
    if tag == "bool":
        return v if isinstance(v, bool) else (s or None)
    if tag == "null":
        return None
    require(isinstance(v, (int, float)) and not isinstance(v, bool), "YAML_TAG_VALUE", s)
    return float(v) if tag == "float" else v


def _yaml_scalar(v) -> str:
    if isinstance(v, str):
        safe = re.fullmatch(r"[A-Za-z_./][A-Za-z0-9_./ -]*(?<! )", v) and not _AMBIGUOUS.fullmatch(v)
        return v if safe else _quoted(v)
    if isinstance(v, float):
        return ".nan" if math.isnan(v) else (".inf" if v > 0 else "-.inf") if math.isinf(v) else repr(v)
    return shown(v)


def build_yaml(v, depth: int = 0) -> str:
    """Block style with sorted keys."""
    pad = "  " * depth
    if isinstance(v, dict) and v:
        parts = []
        for k in sorted(v):
            x = v[k]
            nested = isinstance(x, (dict, list)) and x
            parts.append(f"{pad}{_yaml_scalar(k)}:" + ("\n" + build_yaml(x, depth + 1) if nested else " " + build_yaml(x).strip() + "\n"))
        return "".join(parts)
    if isinstance(v, list) and v:
        return "".join(f"{pad}-" + ("\n" + build_yaml(x, depth + 1) if isinstance(x, (dict, list)) and x else " " + build_yaml(x).strip() + "\n") for x in v)
    return pad + ("{}" if isinstance(v, dict) else "[]" if isinstance(v, list) else _yaml_scalar(v)) + "\n"


# XML -----------------------------------------------------------------------------------------


def scan_xml(text: str) -> None:
    """Refuse what could reach outside or blow up, before any parser sees it."""
    bare = re.sub(r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "", text)
    require(not re.search(r"(?i)<!DOCTYPE", bare), "XML_DOCTYPE")
    require(not re.search(r"(?i)<!ENTITY", bare), "XML_ENTITY")
    require(not re.search(r"<\?(?!xml[\s?])", bare), "XML_PROCESSING_INSTRUCTION")


def xml_nodes(text: str) -> Iterator[tuple[int, int, int, int, str, str, dict[str, str]]]:
    """node_id, parent_id (0 for the root), depth, ordinal among its siblings, name, text and sorted attributes; comments vanish, CDATA is text."""
    import xml.parsers.expat as expat

    text = text.removeprefix("﻿")
    scan_xml(text)
    p = expat.ParserCreate()
    p.buffer_text = True
    stack: list[list] = []
    out: list[list] = []

    def start(name, attrs):
        require(len(stack) < MAX_DEPTH, "XML_TOO_DEEP")
        parent = stack[-1] if stack else None
        if parent:
            parent[7] += 1
        node = [len(out) + 1, parent[0] if parent else 0, len(stack), parent[7] if parent else 1, name, "", dict(sorted(attrs.items())), 0]
        out.append(node)
        stack.append(node)

    def chars(s):
        stack[-1][5] += s

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, lambda _: stack.pop(), chars
    try:
        p.Parse(text.encode(), True)
    except expat.ExpatError as e:
        raise FormatError("XML_PARSE_ERROR", str(e)) from None
    for n in out:
        yield tuple(n[:7])


def _xml_text(s: str) -> str:
    # A carriage return as such would be read as a line feed.
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")


def build_xml(nodes: list[tuple[int, int, str, str, dict[str, str]]]) -> str:
    """nodes: node_id, parent_id, name, text, attributes in document order. Two spaces of indent; text stands before children."""
    kids: dict[int, list] = {}
    for n in nodes:
        kids.setdefault(n[1], []).append(n)

    def put(n, depth: int) -> str:
        pad, own = "  " * depth, kids.get(n[0], [])
        attrs = "".join(f' {k}="{_xml_text(v).replace(chr(34), "&quot;")}"' for k, v in sorted(n[4].items()))
        if not own:
            return f"{pad}<{n[2]}{attrs}>{_xml_text(n[3])}</{n[2]}>\n" if n[3] else f"{pad}<{n[2]}{attrs}/>\n"
        text = f"{pad}  {_xml_text(n[3].strip())}\n" if n[3].strip() else ""
        return f"{pad}<{n[2]}{attrs}>\n{text}" + "".join(put(k, depth + 1) for k in own) + f"{pad}</{n[2]}>\n"

    return "".join(put(n, 0) for n in kids.get(0, []))


# SVG -----------------------------------------------------------------------------------------


def parse_svg(text: str) -> tuple[float | None, float | None, str | None, str]:
    """width, height, view_box and namespace of a document that passes the security scan."""
    for code, p in (("ENTITY", "<!ENTITY"), ("DOCTYPE", "<!DOCTYPE"), ("SCRIPT", "(?i)<script"), ("FOREIGN_OBJECT", "(?i)<foreignObject"), ("EXTERNAL_HREF", r"""(?:xlink:)?href\s*=\s*["']([^"'#][^"']*)["']""")):
        require(not re.search(p, text), f"SVG_{code}")
    root = next(xml_nodes(text))
    require(root[4].rpartition(":")[2] == "svg" and "http://www.w3.org/2000/svg" in root[6].values(), "SVG_PARSE_ERROR")
    size = lambda k: float(m[0]) if (m := re.match(r"[0-9]*\.?[0-9]+", root[6].get(k, ""))) else None
    return size("width"), size("height"), root[6].get("viewBox"), "http://www.w3.org/2000/svg"
