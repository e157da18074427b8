"""Which files a source means."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterable

# Fixed value: the suffix of container files.
SUFFIX = ".hipo"


def store_of(path: str):
    """(filesystem, path within it) of a local path or URI, for reading, writing and listing alike."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def is_uri(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


def resolve(source: str | os.PathLike | Iterable[str | os.PathLike], suffix: str = SUFFIX) -> list[str]:
    """Paths in reading order.

    A folder, local or a URI, gives its files with the suffix (any case), sorted, not those of folders within; a glob
    gives its matches, sorted, maybe none; a path has to be there; a list is taken as it is.
    """
    if not isinstance(source, (str, os.PathLike)):
        return [os.fspath(p) for p in source]
    path = os.fspath(source)
    if not is_uri(path):
        path = path.removeprefix("file://").removeprefix("file:")
        if any(c in path for c in "*?[") and not os.path.exists(path):
            return sorted(glob.glob(path))
    from pyarrow import fs

    store, inner = store_of(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type != fs.FileType.Directory:
        return [path]
    base = path.rstrip("/")
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(inner)) if f.is_file and f.base_name.lower().endswith(suffix)]
    return [f"{base}/{n}" for n in sorted(names)]
