"""Reading the record layout of CDF files (versions 2.2 to 3.x).

A file is opened through a ``Bytes`` view with random access, so descriptors and
single blocks can be read without the rest."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np

from ..types import BY_CODE, CHAR_TYPES, CdfType
from . import codec

# Data encodings with the most significant byte first.
BIG_ENDIAN = {1: "network", 2: "sun", 5: "sgi", 7: "ibmrs", 9: "ppc", 12: "next", 18: "arm_big"}
#: What a record holds behind its size and type: "o" offset, "i" int, "n" name.
_CDR = "o iiii ii iii"
_GDR = "oooo iiiii o iii"
_ADR = "oo iiiii o iii n"
_AEDR = "o iiiii iiii"


class Bytes(Protocol):
    def read(self, at: int, size: int) -> bytes: ...
    def size(self) -> int: ...


class Memory:
    def __init__(self, raw: bytes | memoryview):
        self.raw = memoryview(raw)

    def __deepcopy__(self, memo: dict) -> Memory:
        return self  # read-only, so copies of what was parsed share it

    def read(self, at: int, size: int) -> bytes:
        return bytes(self.raw[at : at + size])

    def size(self) -> int:
        return len(self.raw)


class RandomFile:
    """A path or URI of any file system that pyarrow opens; local files are mapped into
    memory, so a read of a few descriptors touches few pages."""

    def __init__(self, path: str):
        import pyarrow as pa
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        mapped = isinstance(system, fs.LocalFileSystem) and system.get_file_info(name).size
        self.file = pa.memory_map(name) if mapped else system.open_input_file(name)

    def __deepcopy__(self, memo: dict) -> RandomFile:
        return self  # read-only, so copies of what was parsed share it

    def read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def size(self) -> int:
        return self.file.size()


@dataclass
class Block:
    first: int
    last: int
    offset: int
    compressed: bool


@dataclass
class Variable:
    name: str
    num: int
    type: CdfType
    is_zvariable: bool
    is_nrv: bool
    record_shape: tuple[int, ...]
    record_count: int
    elements: int
    compression: int
    head: int
    ord: int = 0

    @property
    def shape(self) -> tuple[int, ...]:
        return (self.record_count, *self.record_shape)

    @property
    def dims(self) -> tuple[int, ...]:
        """The record's dimensions without the string length."""
        return self.record_shape[:-1] if self.type.name in CHAR_TYPES else self.record_shape

    @property
    def record_bytes(self) -> int:
        return int(np.prod(self.record_shape, dtype=np.int64)) * self.type.size


@dataclass
class Entry:
    num: int
    type: CdfType
    value: Any


@dataclass
class Attribute:
    name: str
    num: int
    is_global: bool
    entries: list[Entry]
    zentries: list[Entry]
    ord: int = 0

    @property
    def listed(self) -> list[Entry]:
        return self.zentries or self.entries


@dataclass
class CdfFile:
    version: tuple[int, int, int]
    majority: str
    encoding: int
    compression: int
    leap_second_last_updated: int
    variables: list[Variable] = field(default_factory=list)
    attributes: list[Attribute] = field(default_factory=list)


def is_cdf(head: bytes) -> bool:
    if len(head) < 8:
        return False
    a, b = struct.unpack(">II", head[:8])
    return a & 0xFFF00000 == 0xCDF00000 and b in (0xCCCC0001, 0x0000FFFF) or a == b == 0x0000FFFF


def decode_text(raw: bytes, latin1: bool = True) -> str:
    """UTF-8, or Latin-1 where the bytes are not valid UTF-8 (unless disallowed)."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1" if latin1 else "utf-8", "strict" if latin1 else "replace")


class Parser:
    """Descriptors and values of one file."""

    def __init__(self, source: Bytes, latin1: bool = True):
        head = source.read(0, 8)
        if not is_cdf(head):
            raise ValueError("not a CDF file")
        self.latin1 = latin1
        a, b = struct.unpack(">II", head)
        self.v3 = (a >> 16) & 0xF >= 3 and a != 0x0000FFFF
        self.off, self.name_bytes = ("Q", 256) if self.v3 else ("I", 64)
        self.head = 12 if self.v3 else 8
        self.source, self.compression = source, codec.NONE
        if b == 0xCCCC0001:
            self._inflate_file()
        self._open()

    def _fields(self, at: int, layout: str) -> tuple[list[Any], int]:
        """The fields of the record at an offset, and where they end."""
        kinds = "".join({"o": self.off, "i": "i", "n": f"{self.name_bytes}s", "x": "x"}.get(c, c) for c in layout.replace(" ", ""))
        fmt = ">" + kinds
        size = struct.calcsize(fmt)
        return list(struct.unpack(fmt, self.source.read(at + self.head, size))), at + self.head + size

    def _type(self, at: int) -> tuple[int, int]:
        return struct.unpack(">" + self.off + "I", self.source.read(at, self.head))

    def _ints(self, at: int, n: int) -> tuple[list[int], int]:
        return list(struct.unpack(f">{n}i", self.source.read(at, 4 * n))), at + 4 * n

    def _compression(self, at: int) -> int:
        return self._fields(at, "i")[0][0]

    def _inflate_file(self) -> None:
        (cpr, size, _), body = self._fields(8, "ooi")
        record_size, _ = self._type(8)
        self.compression = self._compression(cpr)
        packed = self.source.read(body, 8 + record_size - body)
        self.source = Memory(self.source.read(0, 8) + codec.inflate(self.compression, packed, size))

    def _open(self) -> None:
        (gdr, version, release, encoding, flags, *rest), _ = self._fields(8, _CDR)
        self.old = (version, release) <= (2, 4)
        self.order = ">" if encoding in BIG_ENDIAN else "<"
        (rhead, zhead, ahead, _, _, _, _, rdims, _, _, _, leap, _), at = self._fields(gdr, _GDR)
        self.rdims, _ = self._ints(at, rdims)
        self.file = CdfFile((version, release, rest[2]), "row" if flags & 1 else "column", encoding, self.compression, leap)
        for at in self._chain(ahead):
            self.file.attributes.append(self._attribute(at, len(self.file.attributes)))
        for head, z in ((rhead, False), (zhead, True)):
            for at in self._chain(head):
                self.file.variables.append(self._variable(at, z, len(self.file.variables)))

    def _chain(self, at: int) -> Iterator[int]:
        """Offsets of a linked list of records, whose first field is the next offset."""
        seen = set()
        while at and at not in seen:
            seen.add(at)
            yield at
            (at,), _ = self._fields(at, "o")

    def _name(self, raw: bytes) -> str:
        return decode_text(raw.split(b"\0")[0], self.latin1)

    def _attribute(self, at: int, ord_: int) -> Attribute:
        (_, head, scope, num, _, _, _, zhead, _, _, _, name), _ = self._fields(at, _ADR)
        entries = [[self._entry(e) for e in self._chain(h)] for h in (head, zhead)]
        return Attribute(self._name(name), num, scope in (1, 3), *entries, ord_)

    def _entry(self, at: int) -> Entry:
        (_, _, kind, num, n, *_), at = self._fields(at, _AEDR)
        t = BY_CODE[kind]
        raw = self.source.read(at, n * t.size)
        if t.name in CHAR_TYPES:
            return Entry(num, t, decode_text(raw.rstrip(b"\0"), self.latin1))
        value = np.frombuffer(raw, np.dtype(t.dtype).newbyteorder(self.order)).astype(t.dtype)
        return Entry(num, t, value.reshape(-1, 2) if t.name == "CDF_EPOCH16" else value)

    def _variable(self, at: int, z: bool, ord_: int) -> Variable:
        pad = "128x i" if self.old else "i"
        layout = f"o ii oo iii i {pad} ii o i n"
        (_, kind, last, vxr, _, flags, _, _, _, _, elements, num, cpr, _, name), at = self._fields(at, layout)
        t = BY_CODE[kind]
        if z:
            (n,), at = self._ints(at, 1)
            sizes, at = self._ints(at, n)
        else:
            sizes = self.rdims
        varies, _ = self._ints(at, len(sizes))
        shape = tuple(s for s, v in zip(sizes, varies, strict=True) if v)
        if t.name in CHAR_TYPES:
            shape = (*shape, elements)
        elif not z and not shape:
            shape = (1,)
        nrv = not flags & 1
        count = min(last + 1, 1) if nrv else last + 1
        packed = self._compression(cpr) if flags & 4 and cpr and cpr < self.source.size() else codec.NONE
        return Variable(self._name(name), num, t, z, nrv, shape, max(0, count), elements, packed, vxr, ord_)

    def blocks(self, var: Variable) -> Iterator[Block]:
        """The data blocks of a variable, from its index records, nested or not."""

        def walk(head: int) -> Iterator[Block]:
            for at in self._chain(head):
                (_, n, used), p = self._fields(at, "oii")
                first, p = self._ints(p, n)
                last, p = self._ints(p, n)
                width = struct.calcsize(">" + self.off)
                offsets = struct.unpack(f">{n}{self.off}", self.source.read(p, n * width))
                for a, b, o in list(zip(first, last, offsets, strict=True))[:used]:
                    kind = self._type(o)[1]
                    if kind == 6:
                        yield from walk(o)
                    else:
                        yield Block(a, b, o, kind == 13)

        if var.head:
            yield from walk(var.head)

    def block_bytes(self, var: Variable, block: Block) -> bytes:
        want = (block.last - block.first + 1) * var.record_bytes
        if not block.compressed:
            return self.source.read(block.offset + self.head, want)
        (_, size), at = self._fields(block.offset, "io")
        return codec.inflate(var.compression, self.source.read(at, size), want)

    def values(self, var: Variable, blocks: list[Block] | None = None) -> tuple[int, np.ndarray]:
        """(first record, values) with records first and each record row-major.
        Strings come as bytes; EPOCH16 has a last dimension of two."""
        if not var.type.dtype:
            return 0, np.zeros((0, *var.dims))
        blocks = list(self.blocks(var)) if blocks is None else blocks
        blocks = [b for b in blocks if b.first < var.record_count]
        first = blocks[0].first if blocks else 0
        count = min(var.record_count, blocks[-1].last + 1) - first if blocks else 0
        raw = bytearray(count * var.record_bytes)
        for before, b in zip(blocks, blocks[1:]):
            if b.first > before.last + 1:
                raise ValueError(f"{var.name}: sparse records aren't supported; none holds {before.last + 1} to {b.first - 1}")
        for b in blocks:
            got = self.block_bytes(var, b)
            a = (b.first - first) * var.record_bytes
            raw[a : a + len(got)] = got[: len(raw) - a]
        if var.type.name in CHAR_TYPES:
            length = var.record_shape[-1]
            data = np.frombuffer(bytes(raw), f"S{length}" if length else "S1")
            tail: tuple[int, ...] = ()
        else:
            data = np.frombuffer(bytes(raw), np.dtype(var.type.dtype).newbyteorder(self.order)).astype(var.type.dtype)
            tail = (2,) if var.type.name == "CDF_EPOCH16" else ()
        dims = var.dims
        if self.file.majority == "column" and len(dims) > 1:
            data = data.reshape(count, *dims[::-1], *tail)
            axes = (0, *range(len(dims), 0, -1), *((len(dims) + 1,) if tail else ()))
            data = np.ascontiguousarray(data.transpose(axes))
        return first, data.reshape(count, *dims, *tail)

    def attributes_of(self, var: Variable) -> Iterator[tuple[Attribute, Entry]]:
        """The variable attributes of a variable, from the list of its own kind."""
        for a in self.file.attributes:
            if not a.is_global:
                for e in a.zentries if var.is_zvariable else a.entries:
                    if e.num == var.num:
                        yield a, e
