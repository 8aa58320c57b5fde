"""Single CDF files as objects, on the driver.

For many or large files use ``sources.reader``, which gives DataFrames.  Values of
a loaded file are read when they are first asked for."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np

from .functions import scalars
from .sources import codec
from .sources.build import Builder, NewVariable
from .sources.layout import Memory, Parser, RandomFile, decode_text, is_cdf
from .types import CHAR_TYPES, TIME_TYPES


class Variable:
    def __init__(self, own: CDF, name: str, parsed: tuple[Parser, Any] | None = None):
        self._own, self.name, self._parsed = own, name, parsed

    @property
    def _new(self) -> NewVariable:
        """The variable in the builder; this reads its values."""
        b = self._own._builder
        if self._parsed is not None:
            p, v = self._parsed
            _, data = p.values(v)
            flat = np.frombuffer(b"".join(x.ljust(v.record_shape[-1], b"\0") for x in data.ravel().tolist()), "u1") if v.type.name in CHAR_TYPES else data.ravel()
            b.variables[self.name].data = flat
            self._parsed = None
        return b.variables[self.name]

    @property
    def values_loaded(self) -> bool:
        return self._parsed is None

    @property
    def type(self) -> str:
        return self._own._builder.variables[self.name].type

    @property
    def shape(self) -> tuple[int, ...]:
        return self._own._builder.variables[self.name].shape

    @property
    def is_nrv(self) -> bool:
        return self._own._builder.variables[self.name].is_nrv

    @property
    def compression(self) -> str:
        return self._own._builder.variables[self.name].compression

    @compression.setter
    def compression(self, name: str) -> None:
        Builder._writable(name)
        self._own._builder.variables[self.name].compression = name

    @property
    def attributes(self) -> dict[str, tuple[str, Any]]:
        """name to (type, value); a text is a str."""
        return {k: (t, decode_text(v.rstrip(b"\0")) if isinstance(v, bytes) else v) for k, (t, v) in self._own._builder.variables[self.name].attributes.items()}

    @property
    def values(self) -> np.ndarray:
        """Records first; texts as bytes, EPOCH16 with a last dimension of two."""
        n = self._new
        if n.type in CHAR_TYPES:
            width = n.shape[-1] if n.shape else 0
            return n.data.view(f"S{width}").reshape(n.shape[:-1]) if width else np.zeros(n.shape[:-1], "S1")
        return n.data.reshape(*n.shape, 2) if n.type == "CDF_EPOCH16" else n.data.reshape(n.shape)

    @property
    def values_encoded(self) -> np.ndarray:
        """Texts as str; other values as they are."""
        if self.type not in CHAR_TYPES:
            return self.values
        return np.vectorize(lambda b: decode_text(b), otypes=[object])(self.values)

    def set_values(self, values: Any, data_type: str | None = None, force: bool = False) -> None:
        self._own._builder.set_values(self.name, values, data_type, force)
        self._parsed = None

    def add_attribute(self, name: str, value: Any, data_type: str | None = None) -> None:
        if name in self._own._builder.variables[self.name].attributes:
            raise ValueError(f"{name} exists already")
        self.set_attribute(name, value, data_type)

    def set_attribute(self, name: str, value: Any, data_type: str | None = None) -> None:
        self._own._builder.add_variable_attribute(self.name, name, value, data_type)

    def to_datetime64(self) -> np.ndarray:
        return scalars.to_datetime64(self.values, self.type)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Variable) and self._key() == other._key() and np.array_equal(self.values, other.values)

    def _key(self) -> tuple:
        plain = lambda v: v if isinstance(v, str) else np.asarray(v).tolist()
        return self.name, self.is_nrv, self.compression, self.shape, self.type, {k: (t, plain(v)) for k, (t, v) in self.attributes.items()}

    def skeleton(self) -> dict[str, Any]:
        return {"attributes": {k: {"values": [_texts(*e)], "types": [e[0]]} for k, e in self.attributes.items()}, "type": self.type, "shape": list(self.shape), "compression": self.compression, "is_nrv": self.is_nrv}

    def __repr__(self) -> str:
        return f"{self.name}: {list(self.shape)} {self.type}, {'non-record-varying, ' * self.is_nrv}compression: {self.compression}, attributes: {', '.join(self.attributes) or 'none'}"


def _texts(kind: str, value: Any) -> Any:
    if kind in TIME_TYPES:
        return [str(x) for x in np.atleast_1d(scalars.to_datetime64(value, kind))]
    return value if isinstance(value, str) else np.asarray(value).tolist()


class CDF:
    def __init__(self, compression: str = "none"):
        self._builder = Builder(compression)
        self._variables: dict[str, Variable] = {}
        self.majority, self.distribution_version, self.lazy_loaded = "row", (3, 8, 0), False

    # -- reading and writing --------------------------------------------------

    @classmethod
    def parse(cls, source: Memory | RandomFile, latin1: bool = True, lazy: bool = True) -> CDF:
        p = Parser(source, latin1)
        out = cls()
        out._builder.compression = codec.NAMES[p.file.compression]
        out.majority, out.distribution_version, out.lazy_loaded = p.file.majority, p.file.version, lazy
        raw = lambda e: e.value.encode() or b"\0" if isinstance(e.value, str) else e.value
        for a in p.file.attributes:
            if a.is_global:
                out._builder.attributes[a.name] = [(e.type.name, raw(e)) for e in a.listed]
        for v in p.file.variables:
            out._builder.variables[v.name] = NewVariable(v.name, v.type.name, v.shape, np.zeros(0), v.is_nrv, codec.NAMES[v.compression], {a.name: (e.type.name, raw(e)) for a, e in p.attributes_of(v)})
            out._variables[v.name] = var = Variable(out, v.name, (p, v))
            if not lazy:
                var._new  # noqa: B018
        return out

    def to_bytes(self) -> bytes:
        for v in self._variables.values():
            v._new  # noqa: B018
        return self._builder.to_bytes()

    def save(self, path: str) -> None:
        raw = self.to_bytes()
        with open(path, "wb") as f:
            f.write(raw)

    # -- looking up -----------------------------------------------------------

    def __getitem__(self, name: str) -> Variable:
        return self._variables[name]

    def __contains__(self, name: str) -> bool:
        return name in self._variables

    def __len__(self) -> int:
        return len(self._variables)

    def __iter__(self) -> Iterator[str]:
        return iter(self._variables)

    def keys(self) -> Any:
        return self._variables.keys()

    def items(self) -> Any:
        return self._variables.items()

    @property
    def compression(self) -> str:
        return self._builder.compression

    @compression.setter
    def compression(self, name: str) -> None:
        Builder._writable(name)
        self._builder.compression = name

    @property
    def attributes(self) -> dict[str, list[tuple[str, Any]]]:
        """name to its entries, each (type, value)."""
        return {k: [(t, decode_text(v.rstrip(b"\0")) if isinstance(v, bytes) else v) for t, v in es] for k, es in self._builder.attributes.items()}

    # -- changing -------------------------------------------------------------

    def add_variable(self, name: str, values: Any = None, data_type: str | None = None, is_nrv: bool = False, compression: str = "none", attributes: Mapping[str, Any] | None = None) -> Variable:
        self._builder.add_variable(name, values, data_type, is_nrv, compression, attributes)
        self._variables[name] = Variable(self, name)
        return self._variables[name]

    def clone_variable(self, other: Variable) -> Variable:
        """A deep copy of another file's variable; its name must be free here."""
        if other.name in self._variables:
            raise ValueError(f"{other.name} exists already")
        self._builder.variables[other.name] = copy.deepcopy(other._new)
        self._variables[other.name] = Variable(self, other.name)
        return self._variables[other.name]

    def add_attribute(self, name: str, entries: list, data_types: list[str | None] | None = None) -> None:
        self._builder.add_attribute(name, entries, data_types)

    def remove_variable(self, name: str) -> None:
        del self._variables[name], self._builder.variables[name]

    def remove_attribute(self, name: str) -> None:
        del self._builder.attributes[name]

    def filter(self, variables: Any = None, attributes: Any = None, inplace: bool = False) -> CDF:
        """Keep variables and attributes by a list of names, a regular expression that
        matches at the start, or a function of the object; None keeps none."""
        out = self if inplace else copy.deepcopy(self)
        for keep, names, drop in ((_criterion(variables), dict(out._variables), out.remove_variable), (_criterion(attributes), dict(out.attributes), out.remove_attribute)):
            for name, value in names.items():
                if not keep(name, value):
                    drop(name)
        return out

    def __eq__(self, other: object) -> bool:
        plain = lambda c: {k: [(t, v if isinstance(v, str) else np.asarray(v).tolist()) for t, v in e] for k, e in c.attributes.items()}
        return isinstance(other, CDF) and plain(self) == plain(other) and dict(self.items()) == dict(other.items())

    def skeleton(self) -> dict[str, Any]:
        """Metadata without values, ready for JSON or YAML."""
        return {"compression": self.compression, "attributes": {k: {"values": [_texts(*e) for e in es], "types": [t for t, _ in es]} for k, es in self.attributes.items()}, "variables": {k: v.skeleton() for k, v in self.items()}}

    def __repr__(self) -> str:
        version = ".".join(map(str, self.distribution_version))
        lines = [f"CDF version {version}, majority: {self.majority}, compression: {self.compression}", "Attributes:"]
        lines += [f"  {k}: {json.dumps([_texts(*e) for e in es], ensure_ascii=False)}" for k, es in self.attributes.items()]
        return "\n".join([*lines, "Variables:", *(f"  {v!r}" for v in self._variables.values())])


def _criterion(c: Any) -> Callable[[str, Any], bool]:
    import re

    if c is None:
        return lambda name, value: False
    if isinstance(c, (list, tuple)):
        return lambda name, value: name in c
    if isinstance(c, (str, re.Pattern)):
        return lambda name, value: re.match(c, name) is not None
    if callable(c):
        return lambda name, value: bool(c(value))
    raise TypeError(f"unsupported criterion: {type(c)}")


def load(source: str | bytes, latin1: bool = True, lazy: bool = True) -> CDF | None:
    """A file by path or URI, or its bytes; None if it is absent or no CDF file.  A
    folder is an error."""
    import os

    if isinstance(source, str):
        if os.path.isdir(source):
            raise IsADirectoryError(source)
        try:
            view: Memory | RandomFile = RandomFile(source)
        except FileNotFoundError:
            return None
    else:
        view = Memory(source)
    return CDF.parse(view, latin1, lazy) if is_cdf(view.read(0, 8)) else None


def save(cdf: CDF, path: str | None = None) -> bytes | None:
    """To a path, or without one the bytes."""
    return cdf.to_bytes() if path is None else cdf.save(path)
