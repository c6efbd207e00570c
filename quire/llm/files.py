"""Files that executors write to the shared folder, and the table that names those of finished tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs

#: Bytes after which a writer begins another file.
ROLL = 64 << 20


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Rolling:
    """Files of some ROLL bytes under a folder, each with a name of its own, so that attempts of a task never meet.

    finished() gives (file, bytes, members) of those closed so far; only what reaches a committed table counts as written."""

    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix
        self.files, self.where = at(folder)
        self.files.create_dir(self.where, recursive=True)
        self.out, self.done, self.members = None, [], 0

    def _open(self) -> None:
        self.name = f"{uuid.uuid4().hex}{self.suffix}"
        self.out, self.members = self.files.open_output_stream(f"{self.where}/{self.name}"), 0
        self.opened()

    def opened(self) -> None: ...

    def closing(self) -> None: ...

    def write(self, data: bytes) -> None:
        if self.out is None:
            self._open()
        self.out.write(data)

    def member_over(self) -> None:
        self.members += 1
        if self.out.tell() >= ROLL:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.closing()
            size = self.out.tell()
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", size, self.members))
            self.out = None

    def finished(self) -> list[tuple[str, int, int]]:
        self.close()
        done, self.done = self.done, []
        return done
