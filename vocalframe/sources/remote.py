"""Files by URI, from tasks and from the driver, through one small set of calls."""

from __future__ import annotations

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; a bare path is local."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def kind(uri: str) -> str:
    """``file``, ``dir`` or ``none``."""
    f, path = open_fs(uri)
    return {fs.FileType.File: "file", fs.FileType.Directory: "dir"}.get(f.get_file_info(path).type, "none")


def children(uri: str) -> list[tuple[str, str]]:
    """(name, kind) of a folder's entries."""
    f, path = open_fs(uri)
    found = f.get_file_info(fs.FileSelector(path, recursive=False))
    return sorted((x.base_name, {fs.FileType.File: "file", fs.FileType.Directory: "dir"}.get(x.type, "none")) for x in found)


def read_text(uri: str) -> str:
    f, path = open_fs(uri)
    with f.open_input_stream(path, compression=None) as src:
        return src.read().decode("utf-8")


def write_text(uri: str, text: str) -> None:
    f, path = open_fs(uri)
    f.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with f.open_output_stream(path, compression=None) as out:
        out.write(text.encode("utf-8"))
