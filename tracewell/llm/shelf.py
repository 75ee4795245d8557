"""Python objects in a folder that all executors share, read by tasks: built by tasks, or by the driver where their size
is fixed. There is one copy on disk; a broadcast has one on the driver and on each executor.

The folder must be on one of pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import pickle
import uuid

import pyarrow.fs as pafs

_LAST: dict[str, object] = {}


def put(path: str, name: str, thing: object) -> None:
    """Written whole or not at all; a task that runs twice leaves one file."""
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    part = f"{root}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(pickle.dumps(thing, protocol=5))
    fs.move(part, f"{root}/_{name}")


def get(path: str, name: str) -> object:
    """The object; a worker keeps the last one it read."""
    key = f"{path}/_{name}"
    if key not in _LAST:
        _LAST.clear()
        fs, root = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(f"{root}/_{name}") as f:
            _LAST[key] = pickle.loads(f.read())
    return _LAST[key]
