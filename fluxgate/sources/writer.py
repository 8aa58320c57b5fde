"""Writing DataFrames as CDF files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from .build import Builder

#: The CDF type a column is written as, unless one is named.
_KINDS = {T.ByteType: "CDF_INT1", T.ShortType: "CDF_INT2", T.IntegerType: "CDF_INT4", T.LongType: "CDF_INT8", T.FloatType: "CDF_FLOAT", T.DoubleType: "CDF_DOUBLE", T.StringType: "CDF_CHAR", T.BooleanType: "CDF_UINT1"}


def column_type(kind: T.DataType) -> str:
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if type(kind) not in _KINDS:
        raise ValueError(f"can't write a column of {kind.simpleString()}")
    return _KINDS[type(kind)]


def _array(values: list[Any], kind: str) -> Any:
    if kind in ("CDF_CHAR", "CDF_UCHAR"):
        return ["" if v is None else v for v in values]
    if kind == "CDF_EPOCH16":
        return np.array([(-1e31, -1e31) if v is None else (v["seconds"], v["picoseconds"]) for v in values], "f8").reshape(-1, 2)
    from ..types import TYPES

    t = TYPES[kind]
    if any(isinstance(v, list) for v in values):
        width = {len(v) for v in values if v is not None}
        if len(width) > 1:
            raise ValueError("records of one variable differ in length")
        values = [[t.fill] * min(width) if v is None else [t.fill if x is None else x for x in v] for v in values]
    else:
        values = [t.fill if v is None else v for v in values]
    return np.array(values, t.dtype)


def build_file(rows: pa.Table, kinds: Mapping[str, str], compression: str = "none", variable_compression: str = "none", attributes: Mapping[str, Mapping[str, Any]] | None = None, global_attributes: Mapping[str, list] | None = None, order: str | None = "rec") -> bytes:
    """One file of a table's rows, a variable per column named in ``kinds``, in the
    order of the column ``order``.  Nulls become the type's fill value."""
    if order and order in rows.column_names:
        rows = rows.sort_by(order)
    b = Builder(compression)
    for name, kind in kinds.items():
        values = _array(rows.column(name).to_pylist(), kind)
        b.add_variable(name, values if rows.num_rows else None, kind, compression=variable_compression, attributes=(attributes or {}).get(name))
    for name, entries in (global_attributes or {}).items():
        b.add_attribute(name, entries)
    return b.to_bytes()


def to_cdf(df: DataFrame, key: str, types: Mapping[str, str] | None = None, **options: Any) -> DataFrame:
    """(key, content): one CDF file for each value of ``key``, assembled in one task
    from that file's rows.  ``types`` names CDF types by column; options as in
    ``build_file``.  A file must fit in a task's memory, as it does in any reader's."""
    order = options.get("order", "rec")
    names = [f.name for f in df.schema if f.name != key and f.name != order]
    kinds = {n: (types or {}).get(n) or column_type(df.schema[n].dataType) for n in names}
    out = T.StructType([df.schema[key], T.StructField("content", T.BinaryType())])

    def run(rows: pa.Table) -> pa.Table:
        return pa.table({key: rows.column(key).slice(0, 1), "content": pa.array([build_file(rows, kinds, **options)], pa.binary())})

    return df.groupBy(key).applyInArrow(run, out)


@dataclass
class _Written(WriterCommitMessage):
    staged: str | None


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path or URI names, and the path on it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), os.path.abspath(path)


class CdfWriter(DataSourceArrowWriter):
    """One file per partition under the option ``path``, on any file system that
    pyarrow knows by URI; files appear on commit by renaming on it, so a failed or
    repeated task leaves none behind."""

    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.uri, self.overwrite = options["path"], overwrite
        self.compression = options.get("compression", "none")
        self.variable_compression = options.get("variablecompression", "none")
        self.kinds = {f.name: options.get(f"type.{f.name}".lower()) or column_type(f.dataType) for f in schema if f.name not in ("rec", "file_id")}
        self.stage = f"_stage-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return _Written(None)
        store, path = file_system(self.uri)
        store.create_dir(f"{path}/{self.stage}", recursive=True)
        name = f"part-{uuid.uuid4().hex}.cdf"
        with store.open_output_stream(f"{path}/{self.stage}/{name}") as f:
            f.write(build_file(pa.Table.from_batches(batches), self.kinds, self.compression, self.variable_compression))
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = file_system(self.uri)
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(path)):
                if f.is_file and f.base_name.endswith(".cdf"):
                    store.delete_file(f.path)
        for m in messages:
            if m is not None and m.staged:
                store.move(f"{path}/{self.stage}/{m.staged}", f"{path}/{m.staged}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, path = file_system(self.uri)
        if store.get_file_info(f"{path}/{self.stage}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.stage}")
