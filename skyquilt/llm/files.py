"""Small binary files in the shared folder, written and read inside tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Sink:
    """A file that appears under its name only when complete; a repeated task replaces it by the same bytes."""

    def __init__(self, uri: str):
        self.store, self.path = locate(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.stream = self.store.open_output_stream(self.part)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        self.store.move(self.part, self.path)

    def abandon(self) -> None:
        self.stream.close()
        self.store.delete_file(self.part)


def read_all(uri: str) -> bytes:
    store, path = locate(uri)
    with store.open_input_file(path) as f:
        return f.readall()
