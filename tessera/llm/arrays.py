"""Packed arrays in shuffles, and array files in the shared folder that workers map into memory."""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
import uuid

import numpy as np

_fetched: dict[str, str] = {}


def packed(*columns: tuple[np.ndarray, bool]) -> bytes:
    """Arrays as byte planes, so that the codec of the shuffle removes their empty high bytes; (array, True) is sorted and stored as differences."""
    out = [struct.pack("<I", len(columns))]
    for values, increasing in columns:
        v = np.ascontiguousarray(values).astype(np.uint64)
        if increasing and len(v):
            v = np.concatenate((v[:1], np.diff(v)))
        planes = v.view(np.uint8).reshape(-1, 8).T
        used = [k for k in range(8) if planes[k].any()]
        out.append(struct.pack("<QBB", len(v), increasing, sum(1 << k for k in used)))
        out += [planes[k].tobytes() for k in used]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(n):
        size, increasing, used = struct.unpack_from("<QBB", data, at)
        at += 10
        planes = np.zeros((size, 8), np.uint8)
        for k in range(8):
            if used >> k & 1:
                planes[:, k] = np.frombuffer(data, np.uint8, size, at)
                at += size
        v = planes.reshape(-1).view(np.uint64)
        out.append(np.cumsum(v, dtype=np.uint64) if increasing else v)
    return out


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def put(uri: str, arrays: list[np.ndarray]) -> None:
    """Writes arrays as one file, under its name only when whole, so a repeated task does no harm."""
    head = [(len(a), a.dtype.str.encode()) for a in arrays]
    data = struct.pack("<I", len(head)) + b"".join(struct.pack("<Q8s", n, t) for n, t in head)
    data += b"\0" * (-len(data) % 64)
    parts = [data]
    for a in arrays:
        raw = a.tobytes()
        parts.append(raw + b"\0" * (-len(raw) % 64))
    path = _local(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{path}.{uuid.uuid4().hex}"
        with open(draft, "wb") as f:
            f.writelines(parts)
        os.replace(draft, path)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    draft = f"{at}.{uuid.uuid4().hex}"
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(draft) as f:
        for p in parts:
            f.write(p)
    store.move(draft, at)


def mapped(uri: str) -> list[np.ndarray]:
    """The arrays of a file, mapped and not read; from a store that isn't local, of a copy that the workers of a node share."""
    path = _local(uri) or _fetched.get(uri)
    if path is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri)
        path = os.path.join(tempfile.gettempdir(), f"tessera-{hashlib.sha256(uri.encode()).hexdigest()[:32]}")
        if not os.path.exists(path):
            draft = f"{path}.{uuid.uuid4().hex}"
            with store.open_input_stream(at) as f, open(draft, "wb") as g:
                while chunk := f.read(1 << 24):
                    g.write(chunk)
            os.replace(draft, path)  # whole or not at all; workers that meet make it twice at most
        _fetched[uri] = path
    if os.path.getsize(path) == 0:
        return []
    raw = np.memmap(path, np.uint8, "r")
    (n,) = struct.unpack_from("<I", raw[:4].tobytes())
    at, out = 4 + 16 * n, []
    head = raw[4:at].tobytes()
    at += -at % 64
    for k in range(n):
        size, kind = struct.unpack_from("<Q8s", head, 16 * k)
        kind = np.dtype(kind.rstrip(b"\0").decode())
        out.append(raw[at : at + size * kind.itemsize].view(kind))
        at += size * kind.itemsize
        at += -at % 64
    return out


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sorted wanted values in the sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted
