"""Files and folders by URI, for the Python data sources of this package; everything goes through ``pyarrow.fs``."""

from __future__ import annotations

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is local."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def files(uri: str, ending: str = "") -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files right in a folder, by name; hidden ones (``.``, ``_``) are left out."""
    store, path = at(uri)
    info = store.get_file_info(path.rstrip("/"))
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        return []
    found = store.get_file_info(fs.FileSelector(info.path))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(ending) and not f.base_name.startswith((".", "_")))


def existing(uri: str) -> None:
    """Raises where there is neither a file nor a folder."""
    store, path = at(uri)
    if store.get_file_info(path.rstrip("/")).type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
