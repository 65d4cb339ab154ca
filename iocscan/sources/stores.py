"""Places that hold evidence: a file system that all executors mount, or a store that is named by a URI.

A path without a scheme, or with ``file:``, is on a mount and goes through ``os``, which tells links, odd names and owners. Any
other URI goes through ``pyarrow.fs``, which knows HDFS and the common object stores, and could know more by ``register``.
"""

from __future__ import annotations

import os
import pwd
import stat
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

from pyarrow import fs

#: (path, length, modified, owner, error) of a regular file.
FileRow = tuple
_OWN: dict[str, Callable[[str], tuple[fs.FileSystem, str]]] = {}


def register(scheme: str, opener: Callable[[str], tuple[fs.FileSystem, str]]) -> None:
    """Give a scheme of one's own a file system: ``opener(uri)`` returns it and the path in it. To be called where the tasks run too."""
    _OWN[scheme] = opener
    _connected.cache_clear()


def _shown(path: str) -> str:
    return path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


class Mount:
    """Files as ``os`` sees them; links are not followed."""

    def is_folder(self, path: str) -> bool:
        return os.path.isdir(path)

    def folders(self, folder: str) -> list[str]:
        with os.scandir(folder) as entries:
            return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))

    def entries(self, folder: str) -> Iterator[tuple[str, FileRow | None]]:
        """(path, None) of each folder in a folder, and (path, row) of each regular file."""
        with os.scandir(folder) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.path, None
                elif not entry.is_symlink():
                    row = self.row(entry.path)
                    if row is not None:
                        yield entry.path, row

    def row(self, path: str) -> FileRow | None:
        try:
            info = os.lstat(path)
            if not stat.S_ISREG(info.st_mode):
                return None
            path.encode("utf-8")
            return path, info.st_size, int(info.st_mtime), self._owner(info), None
        except UnicodeEncodeError:
            return _shown(path), None, None, None, "the name is not valid UTF-8"
        except OSError as error:
            return _shown(path), None, None, None, str(error)

    @staticmethod
    def _owner(info: os.stat_result) -> str:
        try:
            return pwd.getpwuid(info.st_uid).pw_name
        except KeyError:
            return str(info.st_uid)

    def open(self, path: str) -> BinaryIO:
        return open(path, "rb")

    def write(self, path: str, content: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as file:
            file.write(content)


class Store:
    """Files of a ``pyarrow`` file system; paths are URIs. Stores know no links, and no owner that could be told."""

    def __init__(self, system: fs.FileSystem, base: str, root: str):
        #: ``base`` is the place of the URI ``root`` in the file system: a bucket, the root folder, or nothing
        self.system, self.base, self.root = system, base if not base or base.endswith("/") else f"{base}/", root

    def _inner(self, path: str) -> str:
        inner = self.base + path.removeprefix(self.root).lstrip("/")
        return inner.rstrip("/") or inner

    def _uri(self, inner: str) -> str:
        return self.root + inner.removeprefix(self.base).lstrip("/")

    def _row(self, info: fs.FileInfo) -> FileRow:
        modified = info.mtime_ns
        return self._uri(info.path), info.size, None if modified is None else modified // 10**9, None, None

    def is_folder(self, path: str) -> bool:
        inner = self._inner(path)
        return not inner or self.system.get_file_info(inner).type == fs.FileType.Directory

    def _list(self, folder: str) -> list[fs.FileInfo]:
        return self.system.get_file_info(fs.FileSelector(self._inner(folder)))

    def folders(self, folder: str) -> list[str]:
        return sorted(self._uri(i.path) for i in self._list(folder) if i.type == fs.FileType.Directory)

    def entries(self, folder: str) -> Iterator[tuple[str, FileRow | None]]:
        for info in self._list(folder):
            if info.type == fs.FileType.Directory:
                yield self._uri(info.path), None
            elif info.type == fs.FileType.File:
                yield self._uri(info.path), self._row(info)

    def row(self, path: str) -> FileRow | None:
        try:
            info = self.system.get_file_info(self._inner(path))
        except OSError as error:
            return path, None, None, None, str(error)
        if info.type == fs.FileType.NotFound:
            return path, None, None, None, f"no such file: {path}"
        return self._row(info) if info.type == fs.FileType.File else None

    def open(self, path: str) -> BinaryIO:
        return self.system.open_input_file(self._inner(path))

    def write(self, path: str, content: bytes) -> None:
        inner = self._inner(path)
        self.system.create_dir(inner.rsplit("/", 1)[0])
        with self.system.open_output_stream(inner) as stream:
            stream.write(content)


def on_mount(path: str) -> str:
    """The plain path of a ``file:`` URI; any other path as it is."""
    if not path.startswith("file:"):
        return path
    parts = urlsplit(path)
    # no part of a file name is a query or a fragment
    rest = path[len("file:"):]
    return unquote(rest.removeprefix(f"//{parts.netloc}") if rest.startswith("//") else rest)


@lru_cache(maxsize=16)
def _connected(scheme: str, authority: str) -> Store:
    root = f"{scheme}://{authority}/"
    return Store(*(_OWN[scheme](root) if scheme in _OWN else fs.FileSystem.from_uri(root)), root)


def store_of(path: str) -> Mount | Store:
    """Who lists, opens and writes what is at ``path`` (see ``on_mount``). Connections are kept for each worker."""
    scheme, mark, rest = path.partition("://")
    return _connected(scheme, rest.split("/", 1)[0]) if mark and "/" not in scheme and scheme else Mount()
