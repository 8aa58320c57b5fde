"""YAML 1.2 text of nested mappings, sequences and scalars.

Rules are named as the specification numbers them: a scalar is written plain where
productions [126] to [133] allow it within flow collections (so it is safe anywhere)
and no tag but ``str`` is resolved from it, else in double quotes."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

# Narrower than the productions in three places where common readers are: no tab within,
# no question mark at all, no colon at the head.
# [22], [23]: fixed values
_FLOW = ",[]{}"
_INDICATOR = "-?:" + _FLOW + "#&*!|>'\"%@`"
#: [1], without the byte order mark and line breaks.
_PRINTABLE = r"\t\x20-\x7E\x85\xA0-\uD7FF\uE000-\uFEFE\uFF00-\uFFFD\U00010000-\U0010FFFF"
# [34] ns-char, [129] ns-plain-safe(flow-in), [126] ns-plain-first, [130] ns-plain-char, [133] one line
_NS = rf"(?![\s\x85])[{_PRINTABLE}]"
_SAFE = rf"(?![{re.escape(_FLOW)}]){_NS}"
_FIRST = rf"(?:(?![{re.escape(_INDICATOR)}]){_NS}|-(?={_SAFE}))"
_CHAR = rf"(?:(?![:#?]){_SAFE}|:(?={_SAFE})|(?<=\S)\#)"
_PLAIN = re.compile(rf"{_FIRST}(?: *{_CHAR})*")
#: 10.3.2, the core schema's table of tags other than str; and the booleans and numbers
#: that 1.1 has besides, for its readers.
_CORE = (
    r"~|null|Null|NULL",
    r"true|True|TRUE|false|False|FALSE",
    r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+",
    r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?",
    r"[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)",
)
_OLDER = (r"(?i:y|n|yes|no|on|off)", r"[-+]?[0-9][0-9_:.]*", r"[-+]?0b[01_]+|[-+]?0x[0-9a-fA-F_]+", r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}.*", r"=|<<")
_RESOLVED = re.compile("|".join(f"(?:{p})" for p in (*_CORE, *_OLDER)))
#: 9.1.2: what stands at the head of a line to part documents.
_MARKER = re.compile(r"(?:---|\.\.\.)(?:\s|$)")
#: [42] to [61]: escapes that have a letter of their own.
_ESCAPES = {"\0": "0", "\a": "a", "\b": "b", "\t": "t", "\n": "n", "\v": "v", "\f": "f", "\r": "r", "\x1b": "e", '"': '"', "\\": "\\"}
_ODD = re.compile(rf'["\\\t\x85\u2028\u2029]|[^{_PRINTABLE}]')


def quoted(s: str) -> str:
    def escape(m: re.Match[str]) -> str:
        n = ord(m[0])
        if m[0] in _ESCAPES:
            return "\\" + _ESCAPES[m[0]]
        return f"\\x{n:02X}" if n < 0x100 else f"\\u{n:04X}" if n < 0x10000 else f"\\U{n:08X}"

    return '"' + _ODD.sub(escape, s) + '"'


def string(s: str) -> str:
    if _PLAIN.fullmatch(s) and not _RESOLVED.fullmatch(s) and not _MARKER.match(s):
        return s
    return quoted(s)


def number(x: float) -> str:
    if x != x:
        return ".nan"
    if x in (float("inf"), float("-inf")):
        return ".inf" if x > 0 else "-.inf"
    # a whole number is written as one, as far as doubles hold each of them
    return f"{x:.0f}" if x == x // 1 and abs(x) < 1e21 else repr(float(x))


def scalar(v: Any) -> str:
    kinds = ((type(None), lambda _: "null"), (bool, lambda b: "true" if b else "false"), (int, str), (float, number))
    return next((f(v) for kind, f in kinds if isinstance(v, kind)), None) or string(str(v))


def _is_leaf(v: Any) -> bool:
    return not isinstance(v, (Mapping, list, tuple))


def _flow(v: Any) -> str | None:
    """The text of what fits beside a key or dash: a scalar, an empty collection, or a
    sequence of scalars."""
    if _is_leaf(v):
        return scalar(v)
    if isinstance(v, Mapping):
        return None if v else "{}"
    return "[" + ", ".join(map(scalar, v)) + "]" if all(map(_is_leaf, v)) else None


def lines(v: Any, indent: str = "") -> list[str]:
    """Block lines of a value."""
    flow = _flow(v)
    if flow is not None:
        return [indent + flow]
    out = []
    heads = [(string(str(k)) + ":", x) for k, x in v.items()] if isinstance(v, Mapping) else [("-", x) for x in v]
    for head, x in heads:
        beside = _flow(x)
        if beside is not None:
            out.append(f"{indent}{head} {beside}")
            continue
        body = lines(x, indent + "  ")
        if head == "-":  # compact: the first line beside the dash
            out += [f"{indent}- {body[0].lstrip()}", *body[1:]]
        else:
            out += [indent + head, *body]
    return out


def to_yaml(value: Any) -> str:
    return "\n".join(lines(value)) + "\n"
