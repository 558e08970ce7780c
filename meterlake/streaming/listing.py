"""What files there are: a listing that is kept between triggers, and the files that changed last.

A folder's modification time moves when an entry comes or goes, so a folder is listed again only when
its own has moved; an idle tree costs one ``stat`` per folder and per file. A folder that changed just
before it was listed may change again within the clock's step, so its listing is not trusted yet.
"""

from __future__ import annotations

import fnmatch
import heapq
import os
import time
from dataclasses import dataclass, field

#: Nanoseconds that a folder must have rested when it is listed, for the listing to be kept.
SETTLED_NS = 2_000_000_000


@dataclass(frozen=True)
class File:
    """A file by its identity (device and inode), which a rename does not change."""

    file_id: str
    path: str
    size: int
    mtime_ns: int


@dataclass
class _Folder:
    mtime_ns: int
    settled: bool
    folders: list[str]
    files: list[str]


@dataclass
class Listing:
    """The files below ``root`` whose names match ``glob`` and that can be opened; kept from one call to the next."""

    root: str
    glob: str
    #: Folders listed so far, for tests and metrics.
    listed: int = 0
    _folders: dict[str, _Folder] = field(default_factory=dict)

    def _entries(self, path: str) -> _Folder | None:
        try:
            mtime = os.stat(path).st_mtime_ns
            known = self._folders.get(path)
            if known is not None and known.settled and known.mtime_ns == mtime:
                return known
            self.listed += 1
            folders, files = [], []
            now = time.time_ns()
            with os.scandir(path) as entries:
                for entry in entries:
                    if entry.is_dir(follow_symlinks=False):
                        folders.append(entry.path)
                    elif fnmatch.fnmatch(entry.name, self.glob):
                        files.append(entry.path)
            return _Folder(mtime, mtime < now - SETTLED_NS, sorted(folders), sorted(files))
        except OSError:  # it went meanwhile, or may not be read
            return None

    def files(self) -> dict[str, File]:
        """file_id -> File; of several names of one file the last in order."""
        found, seen, todo = {}, {}, [self.root]
        while todo:
            path = todo.pop()
            folder = self._entries(path)
            if folder is None:
                continue
            seen[path] = folder
            todo += folder.folders
            for name in folder.files:
                try:
                    stat = os.stat(name)
                except OSError:
                    continue
                if os.access(name, os.R_OK):
                    file_id = f"{stat.st_dev}-{stat.st_ino}"
                    if file_id not in found or found[file_id].path < name:
                        found[file_id] = File(file_id, name, stat.st_size, stat.st_mtime_ns)
        self._folders = seen
        return found


def newest(files: dict[str, File], k: int) -> list[File]:
    """The ``k`` files that changed last, the latest first; ties by path."""
    return heapq.nsmallest(k, files.values(), key=lambda f: (-f.mtime_ns, f.path))
