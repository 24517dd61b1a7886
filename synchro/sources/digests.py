"""A data source of file digests: each file is read as a stream by one task, a mebibyte at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1 << 20


class _Files(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = _open(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [InputPartition(path)]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        # as Spark's own readers do, names that begin with a dot or an underscore are left out
        return [InputPartition(f.path) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import hashlib

        if partition is None:  # a folder without files
            return
        system, _ = _open(self.path)
        digest, size = hashlib.sha256(), 0
        with system.open_input_stream(partition.value) as stream:
            while chunk := stream.read(CHUNK):
                digest.update(chunk)
                size += len(chunk)
        yield partition.value, size, digest.hexdigest()


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FileDigests(DataSource):
    """path, bytes and sha256 of a file, or of all files under a folder, on any file system that pyarrow opens."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, bytes long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _Files(self.options["path"])
