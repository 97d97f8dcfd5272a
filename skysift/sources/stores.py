"""Files of any store that pyarrow can open (local, HDFS, S3, GCS), by URI."""

from __future__ import annotations

import fnmatch
import posixpath

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path within it, what a URI has before such a path)."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri, ""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/"), "file://"
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, uri[: len(uri) - len(path)] if uri.endswith(path) else uri.split("://")[0] + "://"


def listed(uri: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, of the files in a folder, or of those that match a
    pattern in the last part; nothing if there is none. Hidden files are left out."""
    system, path, head = _at(uri)
    name = posixpath.basename(path.rstrip("/"))
    if any(c in name for c in "*?["):
        folder, keep = posixpath.dirname(path.rstrip("/")), name
    else:
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [(head + path, info.size)]
        folder, keep = path, "*"
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    files = [f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, keep) and f.base_name[:1] not in "._"]
    return sorted((head + f.path, f.size) for f in files)


def opened(uri: str):
    """A file to read and seek in."""
    system, path, _ = _at(uri)
    return system.open_input_file(path)
