"""Files that tasks write to and read from the shared folder, local or in a store."""

from __future__ import annotations

import posixpath

import pyarrow.fs


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path)


def put(path: str, data: bytes) -> None:
    fs, at = opened(path)
    fs.create_dir(posixpath.dirname(at), recursive=True)
    with fs.open_output_stream(at, compression=None) as out:
        out.write(data)


def get(path: str) -> bytes:
    fs, at = opened(path)
    with fs.open_input_stream(at, compression=None) as source:
        return source.read()


def moved(source: str, target: str) -> None:
    """``source`` under its final name; a repeated attempt finds it there already."""
    fs, a = opened(source)
    b = opened(target)[1]
    if fs.get_file_info(a).type == pyarrow.fs.FileType.NotFound:
        if fs.get_file_info(b).type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(source)
        return
    fs.move(a, b)
