"""Reading CDF files into DataFrames.

``read_cdf`` reads whole files through Spark's own file systems and parses them in
Arrow batches; it suits many files of moderate size, in any store Spark reads.
``spark.read.format("cdf")`` (``CdfSource``) splits a file by variables and blocks
and reads only these, from paths that pyarrow opens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..types import CHAR_TYPES
from . import codec
from .layout import Block, Entry, Memory, Parser, RandomFile, Variable, decode_text, is_cdf

_VALUE = "v_str array<string>, v_long array<bigint>, v_double array<double>"
SCHEMAS = {
    "files": "file_id string, version array<int>, majority string, compression string, encoding int, leap_second_last_updated int, n_vars int, n_attrs int",
    "variables": "file_id string, ord int, name string, num int, cdf_type string, shape array<int>, record_len bigint, is_nrv boolean, is_zvariable boolean, majority string, compression string, var_group string, is_contiguous boolean",
    "global_attrs": "file_id string, ord int, attr string, entry_index int, cdf_type string, v_str string, v_long array<bigint>, v_double array<double>",
    "variable_attrs": "file_id string, variable string, attr string, cdf_type string, v_str string, v_long array<bigint>, v_double array<double>",
    "blocks": "file_id string, variable string, block int, first bigint, last bigint, offset bigint, compressed boolean",
    "records": f"file_id string, variable string, rec bigint, {_VALUE}",
}
#: Rows of a batch of records.
BATCH = 8192


def _value(e: Entry) -> dict[str, Any]:
    if e.type.name in CHAR_TYPES:
        return {"v_str": e.value, "v_long": None, "v_double": None}
    flat = np.asarray(e.value).ravel()
    kind = flat.dtype.kind
    return {"v_str": None, "v_long": flat.astype("i8").tolist() if kind in "iu" else None, "v_double": flat.astype("f8").tolist() if kind == "f" else None}


def _group(p: Parser, var: Variable) -> str:
    text = next((e.value for a, e in p.attributes_of(var) if a.name == "VAR_TYPE" and isinstance(e.value, str)), "")
    text = text.strip().lower()
    return text if text in ("data", "support_data", "metadata") else "data"


def metadata_rows(p: Parser, file_id: str, table: str, variables: Sequence[str] | None) -> Iterator[dict[str, Any]]:
    f = p.file
    own = [v for v in f.variables if variables is None or v.name in variables]
    if table == "files":
        yield {"file_id": file_id, "version": list(f.version), "majority": f.majority, "compression": codec.NAMES[f.compression], "encoding": f.encoding, "leap_second_last_updated": f.leap_second_last_updated, "n_vars": len(f.variables), "n_attrs": sum(a.is_global for a in f.attributes)}
    elif table == "variables":
        for v in own:
            # two blocks settle the question; the rest of the index isn't read
            few = [b for b, _ in zip(p.blocks(v), range(2), strict=False)]
            yield {"file_id": file_id, "ord": v.ord, "name": v.name, "num": v.num, "cdf_type": v.type.name, "shape": list(v.shape), "record_len": int(np.prod(v.record_shape, dtype=np.int64)), "is_nrv": v.is_nrv, "is_zvariable": v.is_zvariable, "majority": f.majority, "compression": codec.NAMES[v.compression], "var_group": _group(p, v), "is_contiguous": len(few) <= 1}
    elif table == "global_attrs":
        for a in f.attributes:
            for i, e in enumerate(a.listed if a.is_global else ()):
                yield {"file_id": file_id, "ord": a.ord, "attr": a.name, "entry_index": i, "cdf_type": e.type.name, **_value(e)}
    elif table == "variable_attrs":
        for v in own:
            for a, e in p.attributes_of(v):
                yield {"file_id": file_id, "variable": v.name, "attr": a.name, "cdf_type": e.type.name, **_value(e)}
    elif table == "blocks":
        for v in own:
            for i, b in enumerate(p.blocks(v)):
                yield {"file_id": file_id, "variable": v.name, "block": i, "first": b.first, "last": b.last, "offset": b.offset, "compressed": b.compressed}
    else:
        raise ValueError(f"no such table: {table}")


def _lists(flat: pa.Array, rows: int, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), flat)


def record_batches(p: Parser, file_id: str, var: Variable, blocks: list[Block] | None = None) -> Iterator[pa.RecordBatch]:
    """Records of a variable in the layout of the ``records`` table."""
    first, values = p.values(var, blocks)
    for at in range(0, len(values), BATCH):
        part = values[at : at + BATCH].reshape(min(BATCH, len(values) - at), -1)
        n, width = part.shape
        cols: dict[str, pa.Array] = {"v_str": pa.nulls(n, pa.list_(pa.string())), "v_long": pa.nulls(n, pa.list_(pa.int64())), "v_double": pa.nulls(n, pa.list_(pa.float64()))}
        if part.dtype.kind == "S":
            text = [decode_text(x.rstrip(b"\0"), p.latin1) for x in part.ravel().tolist()]
            cols["v_str"] = _lists(pa.array(text, pa.string()), n, width)
        elif part.dtype.kind == "f":
            cols["v_double"] = _lists(pa.array(part.ravel().astype("f8")), n, width)
        else:
            cols["v_long"] = _lists(pa.array(part.ravel().astype("i8")), n, width)
        yield pa.RecordBatch.from_arrays([pa.array([file_id] * n, pa.string()), pa.array([var.name] * n, pa.string()), pa.array(np.arange(first + at, first + at + n)), *cols.values()], names=["file_id", "variable", "rec", *cols])


_ARROW = {
    "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
}


def _arrow_schema(table: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (c.split(" ") for c in SCHEMAS[table].split(", "))])


def parsed_batches(p: Parser, file_id: str, table: str, variables: Sequence[str] | None) -> Iterator[pa.RecordBatch]:
    if table == "records":
        for v in p.file.variables:
            if variables is None or v.name in variables:
                yield from record_batches(p, file_id, v)
    else:
        rows = list(metadata_rows(p, file_id, table, variables))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _arrow_schema(table))


def parse_content(df: DataFrame, table: str = "records", variables: Sequence[str] | None = None, latin1: bool = True) -> DataFrame:
    """A table of the CDF files in ``df`` (file_id, content); what is not a CDF file,
    or null, gives no rows.  A corrupt block is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, raw in zip(batch.column("file_id").to_pylist(), batch.column("content"), strict=True):
                raw = memoryview(raw.as_buffer()) if raw.is_valid else b""
                if is_cdf(bytes(raw[:8])):
                    yield from parsed_batches(Parser(Memory(raw), latin1), file_id, table, variables)

    return df.select("file_id", "content").mapInArrow(run, SCHEMAS[table])


def read_cdf(spark: SparkSession, path: str, table: str = "records", variables: Sequence[str] | None = None, latin1: bool = True, pattern: str = "*") -> DataFrame:
    """A table of all CDF files under a path that Spark reads; see ``SCHEMAS``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return parse_content(files.select(F.col("path").alias("file_id"), "content"), table, variables, latin1)


class _Part(InputPartition):
    def __init__(self, path: str, variable: str | None, blocks: list[Block] | None):
        super().__init__((path, variable, blocks))


class _Reader(DataSourceReader):
    def __init__(self, table: str, options: dict[str, str]):
        self.table = table
        self.paths = _expand(options["path"])
        names = options.get("variables")
        self.variables = [n.strip() for n in names.split(",")] if names else None
        self.latin1 = options.get("latin1", "true").lower() == "true"
        self.bytes = int(options.get("partitionbytes", 64 << 20))
        self.first, self.last = int(options.get("firstrecord", 0)), int(options.get("lastrecord", (1 << 63) - 1))

    def partitions(self) -> Sequence[InputPartition]:
        """One per file for metadata; for records, runs of blocks of one variable of
        about ``partitionBytes``.  Only descriptors are read for this."""
        if self.table != "records":
            return [_Part(p, None, None) for p in self.paths]
        out = []
        for path in self.paths:
            p = Parser(RandomFile(path), self.latin1)
            for v in p.file.variables:
                if self.variables is not None and v.name not in self.variables:
                    continue
                held, size = [], 0
                for b in p.blocks(v):
                    if not v.is_nrv and (b.last < self.first or b.first > self.last):
                        continue
                    held.append(b)
                    size += (b.last - b.first + 1) * v.record_bytes
                    if size >= self.bytes:
                        out.append(_Part(path, v.name, held))
                        held, size = [], 0
                if held:
                    out.append(_Part(path, v.name, held))
        return out or [_Part("", None, None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, name, blocks = partition.value
        if not path:
            return
        p = Parser(RandomFile(path), self.latin1)
        if name is None:
            yield from parsed_batches(p, path, self.table, self.variables)
        else:
            var = next(v for v in p.file.variables if v.name == name)
            for batch in record_batches(p, path, var, blocks):
                if not var.is_nrv:
                    rec = batch.column("rec").to_numpy()
                    batch = batch.filter(pa.array((rec >= self.first) & (rec <= self.last)))
                yield batch


def _expand(path: str) -> list[str]:
    from pyarrow import fs

    out = []
    for one in path.split(","):
        system, name = fs.FileSystem.from_uri(one) if "://" in one or one.startswith("file:") else (fs.LocalFileSystem(), one)
        prefix = one[: len(one) - len(name)] if one.endswith(name) else ""
        info = system.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(one)
        if info.type == fs.FileType.Directory:
            found = [f.path for f in system.get_file_info(fs.FileSelector(name, recursive=True)) if f.is_file]
        else:
            found = [name]
        for f in sorted(found):
            with system.open_input_file(f) as h:
                if is_cdf(h.read_at(8, 0)):
                    out.append(prefix + f)
    return out


def _lower(options) -> dict[str, str]:
    """Options by lower-cased names, as Spark takes them in any case."""
    return {k.lower(): v for k, v in options.items()}


class CdfSource(DataSource):
    """``spark.read.format("cdf").option("table", ...).option("variables", "a,b").load(path)``.

    Python sources get no column pruning, so the variables are an option: only their
    blocks are read.  The options ``firstRecord`` and ``lastRecord`` bound the records
    of record-varying variables; blocks outside are not read."""

    @classmethod
    def name(cls) -> str:
        return "cdf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "records")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("table", "records"), _lower(self.options))

    def writer(self, schema, overwrite: bool):
        from .writer import CdfWriter

        return CdfWriter(_lower(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CdfSource)


def time_series(records: DataFrame, variables: DataFrame, names: Sequence[str]) -> DataFrame:
    """A wide table (file_id, rec, one typed column per name) of variables that share
    record numbers: scalars as values, others as flat row-major arrays."""
    kinds = {r["name"]: r for r in variables.where(F.col("name").isin(*names)).select("name", "cdf_type", F.size("shape").alias("rank")).distinct().collect()}
    if len(kinds) != len(set(names)):
        raise ValueError(f"absent, or of several types or ranks: {sorted(set(names) - set(kinds)) or names}")
    from ..types import TYPES

    cols = []
    for n in names:
        kind, rank = TYPES[kinds[n]["cdf_type"]], kinds[n]["rank"] - (kinds[n]["cdf_type"] in CHAR_TYPES)
        source = F.col("v_str") if kind.name in CHAR_TYPES else F.col("v_double") if kind.dtype.startswith("f") else F.col("v_long")
        own = F.first(F.when(F.col("variable") == n, source), ignorenulls=True)
        if kind.name == "CDF_EPOCH16":
            cols.append(F.struct(F.get(own, 0).alias("seconds"), F.get(own, 1).alias("picoseconds")).alias(n))
        else:
            cols.append((F.get(own, 0).cast(kind.spark) if rank == 1 else own.cast(f"array<{kind.spark}>")).alias(n))
    return records.where(F.col("variable").isin(*names)).groupBy("file_id", "rec").agg(*cols)
