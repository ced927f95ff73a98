"""Reading and writing files of the shared folder by URI (``file:``, ``hdfs:``, ``s3:`` ...)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + (uri.removeprefix("file:"))
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str) -> Iterator:
    """A stream to a draft that gets its name at the end: a repeated attempt replaces the file by an equal one."""
    where, path = locate(uri)
    folder = path.rsplit("/", 1)[0]
    where.create_dir(folder, recursive=True)
    draft = f"{folder}/.{uuid.uuid4().hex}"
    with where.open_output_stream(draft) as out:
        yield out
    where.move(draft, path)


def put_bytes(uri: str, data: bytes) -> None:
    with writing(uri) as out:
        out.write(data)
