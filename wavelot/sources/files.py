"""Small files on any file system that pyarrow knows."""

from __future__ import annotations

import json
import posixpath
import uuid


def filesystem(uri: str):
    """The file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def make_folder(uri: str) -> None:
    system, path = filesystem(uri)
    system.create_dir(path, recursive=True)


def put(uri: str, data: bytes) -> None:
    """Write a file whole or not at all."""
    system, path = filesystem(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with system.open_output_stream(tmp) as out:
        out.write(data)
    system.move(tmp, path)


def put_json(uri: str, value) -> None:
    put(uri, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).encode())


def put_lines(uri: str, lines: list[str]) -> None:
    put(uri, "".join(f"{x}\n" for x in lines).encode())


def read_file(uri: str) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def open_random(uri: str):
    """A file, open at any place."""
    system, path = filesystem(uri)
    return system.open_input_file(path)


def read_head(uri: str, size: int) -> tuple[bytes, int]:
    """A file's first bytes, and its size."""
    system, path = filesystem(uri)
    with system.open_input_file(path) as f:
        return f.read(size), f.size()


def exists(uri: str) -> bool:
    from pyarrow import fs

    system, path = filesystem(uri)
    return system.get_file_info(path).type == fs.FileType.File
