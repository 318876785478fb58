"""Files that tasks read and write by themselves, in a local or shared folder or another store."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlsplit


def _place(path: str):
    """Local path, or (file system, path) in another store."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return None, unquote(parts.path)
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_file(path: str, chunks) -> int:
    """Write under another name, then rename: a task that runs twice leaves one whole file. Returns bytes."""
    store, at = _place(path)
    part, size = f"{at}.{uuid.uuid4().hex}.part", 0
    if store is None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(part, "wb") as f:
            for x in chunks:
                size += f.write(x)
        os.replace(part, at)
        return size
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(part) as f:
        for x in chunks:
            size += f.write(x)
    store.move(part, at)
    return size


def open_file(path: str):
    store, at = _place(path)
    return open(at, "rb") if store is None else store.open_input_file(at)
