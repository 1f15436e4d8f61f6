"""Detector files through pyarrow file systems: local paths and URIs alike."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*://", path) else (fs.LocalFileSystem(), path)


def read_bytes(path: str, start: int = 0, length: int | None = None) -> bytes:
    system, name = resolve(path)
    with system.open_input_file(name) as source:
        source.seek(start)
        return source.read(source.size() - start if length is None else length)


def size_of(path: str) -> int | None:
    """Bytes of a file; None if it does not exist."""
    system, name = resolve(path)
    info = system.get_file_info(name)
    return info.size if info.is_file else None


def write_bytes(path: str, data: bytes) -> None:
    system, name = resolve(path)
    with system.open_output_stream(name, compression=None) as sink:
        sink.write(data)


def blocks(path: str, start: int, count: int, size: int, target: int = 8 << 20) -> Iterator[bytes]:
    """``count`` records of ``size`` bytes from byte ``start`` on, some megabytes at a time."""
    system, name = resolve(path)
    step = max(1, target // size)
    with system.open_input_file(name) as source:
        source.seek(start)
        for at in range(0, count, step):
            yield source.read(min(step, count - at) * size)


class Bounds:
    """A range of one integer column that pushed-down predicates narrow; Spark still applies them."""

    def __init__(self, column: str):
        self.column, self.low, self.high = column, -math.inf, math.inf

    def push(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == (self.column,):
                v = getattr(f, "value", None)
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, v), min(self.high, v)
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self.high = min(self.high, v - isinstance(f, LessThan))
                elif isinstance(f, In):
                    self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value))
            yield f

    def holds(self, value: int) -> bool:
        return self.low <= value <= self.high

    def cut(self, first: int, count: int) -> tuple[int, int]:
        """The part of [first, first + count) inside the range, as (first, count)."""
        low = max(first, self.low)
        return low, max(0, min(first + count, self.high + 1) - low)


def widen(a: np.ndarray) -> np.ndarray:
    """Unsigned values as signed ones of the next size; 64-bit ones stay (below 2**63 in practice)."""
    kinds = {"uint8": np.int16, "uint16": np.int32, "uint32": np.int64, "uint64": np.int64}
    return a.astype(kinds.get(a.dtype.name, a.dtype))


def packed(frames: np.ndarray) -> pa.ListArray:
    """(n, values) as a list column of integers or doubles."""
    flat = widen(frames).astype(np.float64 if frames.dtype.kind == "f" else np.int64)
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))
