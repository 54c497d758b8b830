"""Byte files in the shared folder, written and read by executors: any file system that Arrow knows by URI."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextlib.contextmanager
def writing(uri: str) -> Iterator[BinaryIO]:
    """A new file that appears under its name only when it is whole, so that a task that is lost or
    runs twice leaves nothing half written: the last to end replaces the file with equal bytes."""
    system, path = place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(temporary, compression=None) as f:
            yield f
    except BaseException:
        with contextlib.suppress(OSError):
            system.delete_file(temporary)
        raise
    try:
        system.move(temporary, path)
    except OSError:  # some stores don't move onto a file that is there
        system.delete_file(path)
        system.move(temporary, path)


def reading(uri: str) -> BinaryIO:
    system, path = place(uri)
    return system.open_input_file(path)


def remove(uri: str) -> None:
    """Deletes a folder, if it is there."""
    system, path = place(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)
