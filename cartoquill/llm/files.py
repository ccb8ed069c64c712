"""Files that tasks write to the shared folder: by a temporary name first, then renamed, so that there are only whole files.

A file's name holds its partition and the attempt that wrote it. Readers are told the attempts whose results Spark has
taken, one for each partition, so that what lost or second attempts have left is never read."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark import TaskContext


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def attempt() -> tuple[int, int]:
    """The partition and the attempt of the running task."""
    context = TaskContext.get()
    return context.partitionId(), context.taskAttemptId()


def wrote(path: str) -> tuple[int, int]:
    """The partition and the attempt in a file's name: kind-partition-attempt..."""
    parts = path.rsplit("/", 1)[-1].split(".")[0].split("-")
    return int(parts[1]), int(parts[2])


def number(path: str) -> int:
    """The number behind partition and attempt in a file's name."""
    return int(path.rsplit("/", 1)[-1].split(".")[0].split("-")[3])


class Output:
    """A binary file under construction; done() gives it its name."""

    def __init__(self, folder: str, name: str):
        context = TaskContext.get()
        temporary = f"_{name}.{context.taskAttemptId() if context else os.getpid()}"
        if (local := _local(folder)) is not None:
            os.makedirs(local, exist_ok=True)
            self.fs, self.temporary, self.path = None, f"{local}/{temporary}", f"{local}/{name}"
            self.out = open(self.temporary, "wb")
        else:
            from pyarrow.fs import FileSystem

            self.fs, top = FileSystem.from_uri(folder)
            self.fs.create_dir(top)
            self.temporary, self.path = f"{top}/{temporary}", f"{top}/{name}"
            self.out = self.fs.open_output_stream(self.temporary)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def done(self) -> None:
        self.out.close()
        if self.fs is None:
            os.replace(self.temporary, self.path)
        else:
            self.fs.move(self.temporary, self.path)
