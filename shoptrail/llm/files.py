"""Binary files in a folder that all executors share: written under a name of the attempt, then moved into place, so that a
task that is tried again leaves one whole file."""
from __future__ import annotations

import posixpath
import uuid
from urllib.parse import urlsplit

from pyarrow import fs


def put(folder: str, name: str, data: bytes) -> str:
    """Writes one file below the folder (a path or URI of any file system that Arrow knows); returns its path."""
    parts = urlsplit(folder)
    if parts.scheme in ("", "file"):
        store, path = fs.LocalFileSystem(), parts.path
    else:
        store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    draft, final = (posixpath.join(path, x) for x in (f"_{name}.{uuid.uuid4().hex}", name))
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, final)
    return final
