"""Binary files in shared folders, written and read inside tasks through Arrow's file systems (local paths,
hdfs://, s3:// and others). A task names its files anew at each attempt and lists them in its output rows; what
an attempt that failed has left is listed nowhere."""

from __future__ import annotations

import uuid


def located(uri: str):
    """(file system, path) of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Appender:
    """Byte strings appended to files below `folder`, a new file whenever one has reached `limit` bytes."""

    def __init__(self, folder: str, suffix: str, limit: int):
        self.fs, self.root = located(folder)
        self.folder, self.suffix, self.limit = folder, suffix, limit
        self.stream, self.name, self.size = None, "", 0

    def add(self, data: bytes) -> tuple[str, int]:
        """The URI of the file and the offset in it."""
        if self.stream is None:
            self.fs.create_dir(self.root, recursive=True)
            name = f"{uuid.uuid4().hex}{self.suffix}"
            self.name, self.size = f"{self.folder}/{name}", 0
            self.stream = self.fs.open_output_stream(f"{self.root}/{name}", compression=None)
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return self.name, at

    @property
    def full(self) -> bool:
        return self.size >= self.limit

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


class Reader:
    """Ranges of files, with one file open at a time."""

    def __init__(self):
        self.uri, self.file = "", None

    def open(self, uri: str):
        if uri != self.uri:
            self.close()
            fs, path = located(uri)
            self.uri, self.file = uri, fs.open_input_file(path)
        return self.file

    def read(self, uri: str, offset: int, length: int) -> bytes:
        data = self.open(uri).read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{uri}: {len(data)} of {length} bytes at {offset}")
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.uri, self.file = "", None
