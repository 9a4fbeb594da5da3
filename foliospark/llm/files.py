"""Files that tasks write to and read from the folder all executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(folder: str, suffix: str):
    """A writable stream and the final URI.  The name is new for each attempt and the file takes it only when complete, so a
    lost task leaves nothing that a reader could mistake for a result; readers open only names that a finished task has
    reported."""
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    with store.open_output_stream(f"{base}/_{name}", compression=None) as out:
        yield out, f"{folder}/{name}"
    store.move(f"{base}/_{name}", f"{base}/{name}")


def open_file(uri: str):
    store, name = _store(uri)
    return store.open_input_file(name)
