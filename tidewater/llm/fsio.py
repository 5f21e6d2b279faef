"""Files in the shared store, written from tasks: whole or not at all.

A task writes under a name of its own and then renames, so a retried or
speculative attempt replaces the file by the same bytes and no reader sees half
of one.  Any store that pyarrow.fs knows by URI will do.
"""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    store, path = _open(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    mine = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(mine, compression=None) as out:
        out.write(data)
    store.move(mine, path)


def get(uri: str) -> bytes:
    store, path = _open(uri)
    with store.open_input_stream(path, compression=None) as source:
        return source.read()
