"""Binary files on shared storage, opened inside tasks by their URI."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of ``uri``: a store that pyarrow knows, or a plain path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def create(folder: str, prefix: str, suffix: str):
    """A new file of ``folder`` as URI and stream.

    Every attempt of a task writes a file of its own.  A list of files that is
    written by a Spark job names those of the attempts that counted.
    """
    uri = f"{folder}/{prefix}-{uuid.uuid4().hex}{suffix}"
    system, path = locate(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, system.open_output_stream(path, compression=None)


def open_read(uri: str):
    system, path = locate(uri)
    return system.open_input_file(path)


def kept(name: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, once for all tasks of a worker process."""
    store = sys.__dict__.setdefault("_larder_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


def give_back() -> None:
    """Memory that is free in this process goes back to the system."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()
