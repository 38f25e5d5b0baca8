"""Files in any store that Arrow's file systems reach: listing, ranged reads, compressed files, bytes in memory."""

from __future__ import annotations

import fnmatch
import zlib

import pyarrow.fs as pafs

from ..layout import is_data_file


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    if "://" in path:
        scheme, rest = path.split("://", 1)
        if scheme == "file":
            return pafs.LocalFileSystem(), rest
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def list_files(path: str, recursive: bool = False) -> list[tuple[str, int]]:
    """(path, bytes) of the data files that a file, folder or file-name pattern stands for, in order of path."""
    fs, inner = file_system(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        if not is_data_file(inner):
            raise ValueError(f"not a .fit, .fits or .fts file, plain or .gz: {path}")
        return [(path, info.size)]
    folder, pattern = (inner, "*") if info.type == pafs.FileType.Directory else inner.rsplit("/", 1) if "/" in inner else (".", inner)
    if info.type == pafs.FileType.NotFound and not any(c in pattern for c in "*?["):
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(folder, recursive=recursive, allow_not_found=True))
    names = ((f, f.path.rsplit("/", 1)[-1]) for f in found if f.type == pafs.FileType.File)
    return sorted((prefix + f.path, f.size) for f, name in names if is_data_file(name) and fnmatch.fnmatch(name, pattern) and name[0] not in "._")


class Bytes:
    """Ranged reads of bytes in memory."""

    def __init__(self, data: bytes, name: str = "memory"):
        self.data, self.name, self.size = data, name, len(data)

    def at(self, offset: int, n: int) -> bytes:
        return bytes(self.data[offset : offset + n])

    def close(self) -> None:
        pass


class Ranged:
    """Ranged reads of a stored file."""

    def __init__(self, path: str):
        fs, inner = file_system(path)
        self.name, self.file = path, fs.open_input_file(inner)
        self.size = self.file.size()

    def at(self, offset: int, n: int) -> bytes:
        n = max(0, min(n, self.size - offset))
        return self.file.read_at(n, offset) if n else b""

    def close(self) -> None:
        self.file.close()


def unzipped(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data.lstrip(b"\0")
    return b"".join(out)


def open_file(path: str) -> Bytes | Ranged:
    """A plain file is read by ranges; a compressed one is unpacked once, offsets being those of its content."""
    if path.endswith(".gz"):
        fs, inner = file_system(path)
        with fs.open_input_stream(inner, compression=None) as f:
            return Bytes(unzipped(f.read()), path)
    return Ranged(path)


def open_bytes(data: bytes, name: str = "memory") -> Bytes:
    """Bytes of a file, unpacked if they are a gzip file's."""
    return Bytes(unzipped(data) if data[:2] == b"\x1f\x8b" else data, name)
