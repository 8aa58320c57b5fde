"""Building CDF files (version 3, z-variables, row-major)."""

from __future__ import annotations

import struct
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from ..types import CHAR_TYPES, TYPES, compatible, infer, shapes_compatible
from . import codec

# Codes of the encodings that this writer knows, and numpy's names of their byte orders.
_ENCODINGS = {"little": (6, "<"), "big": (1, ">")}
_COPYRIGHT = b"Common Data Format (CDF)"
#: Most bytes of a block.
BLOCK_BYTES = 1 << 30


@dataclass
class NewVariable:
    name: str
    type: str
    shape: tuple[int, ...]  # records first; string length last
    data: np.ndarray  # flat
    is_nrv: bool = False
    compression: str = "none"
    attributes: dict[str, tuple[str, Any]] = field(default_factory=dict)


def _typed(values: Any, data_type: str | None) -> tuple[str, tuple[int, ...], np.ndarray]:
    """Inferred (type, shape, flat data), or converted to the given type."""
    if data_type == "CDF_EPOCH16":
        a = np.asarray(values, "f8")
        return data_type, a.shape[:-1], a.ravel()
    if data_type == "CDF_EPOCH" or data_type == "CDF_TIME_TT2000" and not isinstance(values, (list, tuple)):
        a = np.asarray(values)
        if a.dtype.kind != "M":
            return data_type, a.shape, a.ravel().astype(TYPES[data_type].dtype)
    name, shape, data = infer(values)
    if data_type is None or name == "CDF_NONE":
        return data_type or name, shape, data
    if data_type in CHAR_TYPES or name in CHAR_TYPES:
        if not compatible(data_type, name):
            raise ValueError(f"{name} values don't fit {data_type}")
        return data_type, shape, data
    if data_type == "CDF_TIME_TT2000":
        return data_type, shape, data.astype("i8")
    if data_type == "CDF_EPOCH":
        from ..functions.time import EPOCH_MS, ns_of_tt2000

        return data_type, shape, np.array([int(ns_of_tt2000(int(x)) / 1_000_000) + EPOCH_MS for x in data])
    t = TYPES[data_type]
    if data.dtype.kind in "iu" and np.dtype(t.dtype).kind in "iu" and len(data):
        r = np.iinfo(t.dtype)
        if data.min() < r.min or data.max() > r.max:
            raise ValueError(f"values out of the range of {data_type}")
    return data_type, shape, data.astype(t.dtype)


class Builder:
    """Collects variables and attributes, and gives the bytes of a file."""

    def __init__(self, compression: str = "none", block_bytes: int = BLOCK_BYTES, byte_order: str = "little"):
        self.compression, self.block_bytes = compression, block_bytes
        self._encoding, self._order = _ENCODINGS[byte_order]
        self.variables: dict[str, NewVariable] = {}
        self.attributes: dict[str, list[tuple[str, Any]]] = {}
        for c in (compression,):
            self._writable(c)

    @staticmethod
    def _writable(name: str) -> None:
        if name not in ("none", "rle", "gzip"):
            raise ValueError(f"can't write compression {name}")

    def add_variable(self, name: str, values: Any = None, data_type: str | None = None, is_nrv: bool = False, compression: str = "none", attributes: Mapping[str, Any] | None = None) -> NewVariable:
        if not name:
            raise ValueError("a variable needs a name")
        if name in self.variables:
            raise ValueError(f"{name} exists already")
        self._writable(compression)
        var = NewVariable(name, "CDF_NONE", (), np.zeros(0), is_nrv, compression)
        self.variables[name] = var
        if values is not None:
            self.set_values(name, values, data_type)
        for k, v in (attributes or {}).items():
            self.add_variable_attribute(name, k, v)
        return var

    def set_values(self, name: str, values: Any, data_type: str | None = None, force: bool = False) -> None:
        """Replace a variable's values.  Without ``force``, the type must be one that
        the present type takes, and the shape must fit."""
        var = self.variables[name]
        own = var.type if var.type != "CDF_NONE" else None
        kind, shape, data = _typed(values, data_type)
        if own and not force:
            if data_type and not compatible(own, data_type) or not data_type and not compatible(own, kind):
                raise ValueError(f"{name} holds {own}, not {data_type or kind}")
            if not shapes_compatible(var.shape, shape, var.is_nrv):
                raise ValueError(f"{name} has shape {var.shape}, not {shape}")
            kind, shape, data = _typed(values, own if kind not in CHAR_TYPES else kind)
        if var.is_nrv and (not shape or own and len(shape) < len(var.shape)):
            shape = (1, *shape)
        var.type, var.shape, var.data = kind, shape, data

    def add_variable_attribute(self, variable: str, name: str, value: Any, data_type: str | None = None) -> None:
        self.variables[variable].attributes[name] = self._entry(value, data_type)

    def add_attribute(self, name: str, entries: Sequence[Any], data_types: Sequence[str | None] | None = None) -> None:
        if name in self.attributes:
            raise ValueError(f"{name} exists already")
        kinds = data_types or [None] * len(entries)
        self.attributes[name] = [self._entry(v, t) for v, t in zip(entries, kinds, strict=True)]

    @staticmethod
    def _entry(value: Any, data_type: str | None) -> tuple[str, Any]:
        """(type, bytes-like): text is CHAR, an empty one a single NUL; numbers 1-D."""
        if isinstance(value, (str, bytes)):
            raw = value.encode() if isinstance(value, str) else value
            return data_type or "CDF_CHAR", raw or b"\0"
        if isinstance(value, (list, tuple)) and value and isinstance(value[0], (str, bytes)):
            raise ValueError("an attribute entry holds one text")
        if not isinstance(value, (list, tuple, np.ndarray)):
            value = [value]
        kind, shape, data = _typed(value, data_type)
        if len(shape) != 1:
            raise ValueError("an attribute entry has one dimension")
        return kind, data

    # -- layout ---------------------------------------------------------------

    def to_bytes(self) -> bytes:
        """Descriptors first, in one pass that appends records and patches the links
        to records that come later."""
        out = bytearray(struct.pack(">II", 0xCDF30001, 0x0000FFFF))

        def record(kind: int, body: bytes) -> int:
            at = len(out)
            out.extend(struct.pack(">QI", 12 + len(body), kind) + body)
            return at

        def patch(at: int, fmt: str, *values: int) -> None:
            struct.pack_into(">" + fmt, out, at, *values)

        cdr = record(1, struct.pack(">Q9i", 0, 3, 8, self._encoding, 3, 0, 0, 0, -1, -1) + _COPYRIGHT.ljust(256, b"\0"))
        gdr = record(2, struct.pack(">QQQQiiiiiQiii", 0, 0, 0, 0, 0, 0, -1, 0, len(self.variables), 0, 0, 20170101, -1))
        patch(cdr + 12, "Q", gdr)
        order = list(self.variables)
        own: dict[str, list[tuple[int, str, Any]]] = {}
        for i, v in enumerate(self.variables.values()):
            for k, (kind, value) in v.attributes.items():
                own.setdefault(k, []).append((i, kind, value))
        last = 0
        scopes = [(k, 1, [(i, *e) for i, e in enumerate(v)]) for k, v in self.attributes.items()] + [(k, 2, v) for k, v in own.items()]
        for num, (name, scope, entries) in enumerate(scopes):
            most = max((e[0] for e in entries), default=-1)
            g, z = ((len(entries), most), (0, -1)) if scope == 1 else ((0, -1), (len(entries), most))
            adr = record(4, struct.pack(">QQiiiiiQiii", 0, 0, scope, num, *g, 0, 0, *z, -1) + name.encode().ljust(256, b"\0"))
            patch(last + 12 if last else gdr + 28, "Q", adr)
            last = adr
            link = adr + (20 if scope == 1 else 48)
            for i, kind, value in entries:
                t = TYPES[kind]
                raw = value if isinstance(value, bytes) else value.astype(np.dtype(t.dtype).newbyteorder(self._order)).tobytes()
                edr = record(5 if scope == 1 else 9, struct.pack(">Q9i", 0, num, t.code, i, len(raw) // t.size, int(kind in CHAR_TYPES), 0, 0, -1, -1) + raw)
                patch(link, "Q", edr)
                link = edr + 12
        patch(gdr + 48, "i", len(scopes))
        last = 0
        for num, name in enumerate(order):
            at = self._variable(self.variables[name], num, record, patch)
            patch(last + 12 if last else gdr + 20, "Q", at)
            last = at
        patch(gdr + 36, "Q", len(out))
        if self.compression == "none":
            return bytes(out)
        return self._packed(bytes(out))

    def _variable(self, var: NewVariable, num: int, record, patch) -> int:
        t = TYPES[var.type]
        char = var.type in CHAR_TYPES
        dims = var.shape[1:-1] if char else var.shape[1:]
        count = var.shape[0] if var.shape else 0
        elements = var.shape[-1] if char and var.shape else 1
        width = int(np.prod(var.shape[1:], dtype=np.int64)) * t.size if var.shape else t.size
        code = codec.CODES[var.compression]
        flags = (0 if var.is_nrv else 1) | (4 if code else 0)
        body = struct.pack(">QiiQQiiiiiiiQi", 0, t.code, count - 1, 0, 0, flags, 0, 0, -1, -1, elements, num, 0xFFFFFFFFFFFFFFFF, 0)
        at = record(8, body + var.name.encode().ljust(256, b"\0") + struct.pack(f">i{2 * len(dims)}i", len(dims), *dims, *([-1] * len(dims))))
        if code:
            patch(at + 12 + 60, "Q", record(11, struct.pack(">iiii", code, 0, 1, codec.GZIP_LEVEL if code == codec.GZIP else 0)))
        if not count:
            return at
        raw = var.data.astype(np.dtype(t.dtype).newbyteorder(self._order)).tobytes() if not char else var.data.tobytes()
        per = max(1, self.block_bytes // max(1, width))
        starts = list(range(0, count, per))
        ends = [min(count, s + per) - 1 for s in starts]
        n = len(starts)
        vxr = record(6, struct.pack(f">Qii{2 * n}i{n}Q", 0, n, n, *starts, *ends, *([0] * n)))
        patch(at + 12 + 16, "QQ", vxr, vxr)
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            part = raw[a * width : (b + 1) * width]
            if code:
                packed = codec.deflate(code, part)
                block = record(13, struct.pack(">iQ", 0, len(packed)) + packed)
            else:
                block = record(7, part)
            patch(vxr + 12 + 16 + 8 * n + 8 * i, "Q", block)
        return at

    def _packed(self, plain: bytes) -> bytes:
        """The file within one compressed record."""
        code = codec.CODES[self.compression]
        packed = codec.deflate(code, plain[8:])
        head = struct.pack(">II", 0xCDF30001, 0xCCCC0001)
        size = 12 + 20 + len(packed)
        ccr = struct.pack(">QIQQi", size, 10, 8 + size, len(plain) - 8, 0) + packed
        return head + ccr + struct.pack(">QIiiii", 28, 11, code, 0, 1, codec.GZIP_LEVEL if code == codec.GZIP else 0)
