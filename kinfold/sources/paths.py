"""Files for Python data sources, on any file system that Arrow opens: local ones, hdfs, s3."""

from __future__ import annotations

import os

from pyarrow import fs


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; without a scheme it is the local one, which on a cluster must be shared."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def listed(path: str) -> list[fs.FileInfo]:
    """The file of a path, or the files below it in the order of their names, without hidden ones."""
    system, root = open_path(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    shown = lambda x: not any(part[0] in "._" for part in x.path[len(root) :].strip("/").split("/"))
    return sorted((x for x in found if x.type == fs.FileType.File and shown(x)), key=lambda x: x.path)
