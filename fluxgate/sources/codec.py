"""Block codecs: run-length of zeros, gzip and zstandard."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Compression codes of the format.
NONE, RLE, GZIP, ZSTD = 0, 1, 5, 16
NAMES = {NONE: "none", RLE: "rle", 2: "huffman", 3: "adaptive_huffman", GZIP: "gzip", ZSTD: "zstd"}
CODES = {v: k for k, v in NAMES.items()}
GZIP_LEVEL = 6


def rle_deflate(raw: bytes) -> bytes:
    """Each run of 1 to 256 zeros as a zero and the run's length less one."""
    a = np.frombuffer(raw, np.uint8)
    zero = a == 0
    ends = np.flatnonzero(np.diff(zero, prepend=False, append=False))
    first, size = ends[::2], ends[1::2] - ends[::2]
    if not len(first):
        return raw
    if size.max() > 256:  # longer runs are several
        per = (size + 255) >> 8
        nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        first, size = np.repeat(first, per) + 256 * nth, np.minimum(np.repeat(size, per) - 256 * nth, 256)
    # the first zero of each run stays, and its count goes behind it
    stays = ~zero
    stays[first] = True
    kept = a[stays]
    behind = np.flatnonzero(kept == 0) + np.arange(1, len(first) + 1)
    out = np.empty(len(kept) + len(first), np.uint8)
    is_count = np.zeros(len(out), bool)
    is_count[behind] = True
    out[behind] = size - 1
    out[~is_count] = kept
    return out.tobytes()


def rle_inflate(packed: bytes, size: int | None = None) -> bytes:
    """The inverse; a zero without its count at the end is dropped, and the output
    stops at ``size`` bytes."""
    a = np.frombuffer(packed, np.uint8)
    zero = np.flatnonzero(a == 0)
    if not len(zero):
        return packed if size is None else packed[:size]
    # what follows a byte other than zero begins anew, so of adjacent zeros each second is a count
    begins = np.concatenate([[True], zero[1:] != zero[:-1] + 1])
    nth = zero - zero[begins][np.cumsum(begins) - 1]
    mark = zero[nth & 1 == 0]
    times = np.ones(len(a), np.int64)
    if mark[-1] == len(a) - 1:
        times[mark[-1]], mark = 0, mark[:-1]
    times[mark] = a[mark + 1].astype(np.int64) + 1
    times[mark + 1] = 0
    out = np.repeat(a, times).tobytes()
    return out if size is None else out[:size]


def inflate(code: int, packed: bytes, size: int) -> bytes:
    """Unpack a block to exactly ``size`` bytes; a corrupt or short block raises."""
    if code == RLE:
        out = rle_inflate(packed, size)
    elif code == GZIP:
        out = zlib.decompress(packed, 47)[:size]
    elif code == ZSTD:
        import zstandard

        try:
            out = zstandard.ZstdDecompressor().decompress(packed, max_output_size=size)[:size]
        except zstandard.ZstdError as e:
            raise ValueError(f"corrupt block: {e}") from e
    else:
        raise ValueError(f"unsupported compression: {NAMES.get(code, code)}")
    if len(out) < size:
        raise ValueError(f"corrupt block: {len(out)} bytes, not {size}")
    return out


def deflate(code: int, raw: bytes) -> bytes:
    if code == RLE:
        return rle_deflate(raw)
    if code == GZIP:
        c = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
        return c.compress(raw) + c.flush()
    raise ValueError(f"can't write compression: {NAMES.get(code, code)}")


def _column(fn, c: Column) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else fn(bytes(x)))

    return run(c)


def inflate_column(code: Column, packed: Column, size: Column) -> Column:
    """struct(content, error): ``inflate`` for columns.  A block that it refuses, or that
    its library can't read, has null content and the reason; null packed gives both null."""

    def one(c: int, p: bytes, n: int) -> tuple[bytes | None, str | None]:
        try:
            return inflate(c, bytes(p), n), None
        except (ValueError, zlib.error) as e:
            return None, str(e)

    @F.pandas_udf("content binary, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for codes, blocks, sizes in batches:
            rows = [(None, None) if p is None else one(int(c), p, int(n)) for c, p, n in zip(codes, blocks, sizes, strict=True)]
            yield pd.DataFrame(rows, columns=["content", "error"], dtype=object)

    return run(code, packed, size)


def rle_deflate_column(c: Column) -> Column:
    return _column(rle_deflate, c)


def rle_inflate_column(c: Column) -> Column:
    return _column(rle_inflate, c)
