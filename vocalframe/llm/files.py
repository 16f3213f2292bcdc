"""Files in the shared folder, by URI, from tasks and from the driver."""

from __future__ import annotations

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; a bare path is local."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri[len("file:"):]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def is_local(filesystem: fs.FileSystem) -> bool:
    return isinstance(filesystem, fs.LocalFileSystem)


def write_bytes(uri: str, data: bytes) -> None:
    f, path = open_fs(uri)
    f.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with f.open_output_stream(path, compression=None) as out:
        out.write(data)


def read_bytes(uri: str) -> bytes:
    f, path = open_fs(uri)
    with f.open_input_stream(path, compression=None) as src:
        return src.read()
