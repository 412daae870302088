"""Files on any store that pyarrow reaches by URI, for data sources written in Python."""

from __future__ import annotations

import re

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI and the path in it. Paths are taken as they are written,
    as Spark does, so names with spaces, ``#`` or ``%`` are those of the files."""
    m = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)$", uri)
    if not m or m[1] == "file":
        return fs.LocalFileSystem(), m[3] if m else uri
    store, base = fs.FileSystem.from_uri(f"{m[1]}://{m[2] or ''}/")
    return store, base.rstrip("/") + m[3]
