"""Files in the shared folder, written and read by tasks through the file system its address names."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> str:
    """An address no other task or attempt has; only those that a finished task reports are ever read."""
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


class Writer:
    """An output stream that knows its place."""

    def __init__(self, uri: str):
        own, path = open_fs(uri)
        own.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.at, self._stream = uri, 0, own.open_output_stream(path, compression=None)

    def write(self, data: bytes) -> int:
        self._stream.write(data)
        self.at += len(data)
        return len(data)

    def close(self) -> None:
        self._stream.close()


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        own, path = open_fs(uri)
        self._file = own.open_input_file(path)
        self.size = self._file.size()

    def read_at(self, offset: int, length: int) -> bytes:
        return self._file.read_at(length, offset)

    def close(self) -> None:
        self._file.close()
