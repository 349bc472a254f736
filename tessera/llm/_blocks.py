"""Compressed blocks of sorted arrays for shuffles, and flat array files in the shared folder."""

from __future__ import annotations

import os
import uuid

import numpy as np
import zstandard
from pyarrow import fs


def put(uri: str, array: np.ndarray) -> None:
    """Write a flat file so that it's there as a whole or not at all; a repeated task writes the same bytes again."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0])
    with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
        f.write(np.ascontiguousarray(array).tobytes())
    store.move(part, path)


def mapped(uri: str, dtype) -> np.ndarray:
    """The file as an array: mapped into memory where its store is a local or mounted one, else read."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype=dtype)


def narrow(array: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold the largest of them."""
    most = int(array.max()) if array.size else 0
    return array.astype(next(f"<u{k}" for k in (1, 2, 4, 8) if most < 1 << (8 * k)))


def numbers(uri: str, n: int) -> np.ndarray:
    """A file of n such counts."""
    store, path = fs.FileSystem.from_uri(uri)
    return mapped(uri, f"<u{store.get_file_info(path).size // n}") if n else np.zeros(0, dtype=np.int64)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, the first sorted: it goes as differences, all byte by byte, compressed."""
    out = [np.diff(arrays[0], prepend=arrays[0].dtype.type(0)), *arrays[1:]]
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in out)
    return np.int64(len(arrays[0])).tobytes() + zstandard.ZstdCompressor(level=1).compress(planes)


def opened(blob: bytes, *dtypes) -> list[np.ndarray]:
    n, planes, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), zstandard.ZstdDecompressor().decompress(blob[8:]), 0, []
    for d in map(np.dtype, dtypes):
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8, n * d.itemsize, at).reshape(d.itemsize, n).T).view(d).reshape(n))
        at += n * d.itemsize
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their values (one row or several columns)."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first, axis=0) if len(first) else values
