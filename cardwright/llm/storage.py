"""Files in the shared folder, as Python on the executors reads and writes them."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or a plain path, and the path there."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class Reader:
    """Range reads; the last few files stay open."""

    def __init__(self, keep: int = 16):
        self.files: dict[str, object] = {}
        self.keep = keep

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.files:
            while len(self.files) >= self.keep:
                self.files.pop(next(iter(self.files))).close()
            store, path = opened(uri)
            self.files[uri] = store.open_input_file(path)
        return self.files[uri].read_at(length, offset)

    def whole(self, uri: str) -> bytes:
        store, path = opened(uri)
        with store.open_input_file(path) as f:
            return f.read()
