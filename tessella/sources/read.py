"""Reading a section of a variable from its storage description into a numpy array."""

from __future__ import annotations

import zlib

import numpy as np

from tessella.model import Variable
from tessella.operators.layout import Tiling, size, strides
from tessella.operators.section import Range


def _runs(shape: list[int], section: list[Range]) -> tuple[list[int], int, int]:
    """Start elements of the contiguous runs of a section in a row-major array, elements of a run, and the runs' dimension."""
    k = len(shape)
    while k and len(section[k - 1]) == shape[k - 1]:
        k -= 1
    k = max(k - 1, 0)
    s = strides(shape)
    inner = size([len(r) for r in section[k:]]) if shape else 1
    base = sum(r.start * w for r, w in zip(section, s, strict=False)) if shape else 0
    outer = np.zeros(1, np.int64)
    for r, w in zip(section[:k], s[:k], strict=True):
        outer = (outer[:, None] + np.arange(len(r)) * w).ravel()
    return (base + outer).tolist(), inner, k


def _pread(f, pos: int, n: int) -> bytes:
    f.seek(pos)
    out = f.read(n)
    if len(out) < n:
        raise EOFError(f"file ends before {pos + n}")
    return out


def defilter(data: bytes, filters: list[dict], mask: int) -> bytes:
    """Undo a chunk's filters in reverse order; a set mask bit means the filter was not applied."""
    for k in range(len(filters) - 1, -1, -1):
        f = filters[k]
        if mask >> k & 1:
            continue
        if f["id"] == 1:
            data = zlib.decompress(data)
        elif f["id"] == 2:
            w = f["values"][0]
            n = len(data) // w
            if w > 1 and n > 1:
                data = np.frombuffer(data[: n * w], np.uint8).reshape(w, n).T.tobytes() + data[n * w :]
        elif f["id"] == 3:
            data = data[:-4]
        else:
            raise NotImplementedError(f"filter {f['id']} ({f.get('name', 'unknown')})")
    return data


def fill_array(v: Variable, shape: list[int]) -> np.ndarray:
    dtype = v.type.numpy()
    raw = v.storage.get("fill")
    return np.full(shape, np.frombuffer(raw, dtype)[0] if raw else np.zeros(1, dtype)[0], dtype)


def read_section(path: str, v: Variable, section: list[Range]) -> np.ndarray:
    """The section's elements in their stored type; never-written parts have the fill value."""
    st, dtype, shape = v.storage, v.type.numpy(), v.shape
    want = [len(r) for r in section][: len(shape)]
    kind = st["kind"]
    if kind == "fill" or not size(want):
        return fill_array(v, want)
    if kind == "bytes":
        full = np.frombuffer(st["data"], dtype)[: size(shape)].reshape(shape)
        return full[tuple(slice(r.start, r.last + 1) for r in section[: len(shape)])]
    with open(path, "rb") as f:
        if kind == "contiguous":
            starts, inner, _ = _runs(shape, section)
            return np.frombuffer(b"".join(_pread(f, st["pos"] + s * dtype.itemsize, inner * dtype.itemsize) for s in starts), dtype).reshape(want)
        if kind == "records":
            starts, inner, _ = _runs(shape[1:], section[1:])
            record = lambda r: b"".join(_pread(f, st["pos"] + r * st["recsize"] + s * dtype.itemsize, inner * dtype.itemsize) for s in starts)
            return np.frombuffer(b"".join(record(r) for r in range(section[0].start, section[0].last + 1)), dtype).reshape(want)
        if kind == "linked":
            data = b"".join(_pread(f, pos, n) for pos, n in st["blocks"])
            data = zlib.decompress(data) if st.get("deflate") else data
            full = np.frombuffer(data[: size(shape) * dtype.itemsize], dtype).reshape(shape)
            return full[tuple(slice(r.start, r.last + 1) for r in section)]
        if kind == "chunked":
            return _read_chunks(f, v, section, want)
    raise NotImplementedError(kind)


def _read_chunks(f, v: Variable, section: list[Range], want: list[int]) -> np.ndarray:
    st, dtype, out = v.storage, v.type.numpy(), fill_array(v, want)
    tiling = Tiling(tuple(v.shape), tuple(st["chunk"]))
    cover = tiling.cover(section)
    counts = [len(r) for r in cover]
    for number in range(size(counts)):
        tile = [r.start + number // w % n for r, w, n in zip(cover, strides(counts), counts, strict=True)]
        start = tiling.index(tile)
        stored = st["index"].get(tuple(start))
        if stored is None:
            continue
        pos, n, mask = stored
        data = defilter(_pread(f, pos, n), st.get("filters", []), mask) if n >= 0 else b""
        full = np.frombuffer(data[: size(st["chunk"]) * dtype.itemsize], dtype).reshape(st["chunk"])
        lo = [max(r.start, s) for r, s in zip(section, start, strict=True)]
        hi = [min(r.last, s + c - 1) for r, s, c in zip(section, start, st["chunk"], strict=True)]
        out[tuple(slice(a - r.start, b - r.start + 1) for a, b, r in zip(lo, hi, section, strict=True))] = full[tuple(slice(a - s, b - s + 1) for a, b, s in zip(lo, hi, start, strict=True))]
    return out
