"""Files of our own formats on any store that pyarrow reaches by URI."""

from __future__ import annotations

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI and the path in it; a bare path is a local one."""
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)
