"""A data source of files' first bytes: detection over many large files reads 1 KiB of each.

spark.dataSource.register(HeadSource); spark.read.format("heads").option("n", 1024).load(folder)
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from formloom.sources.detect import HEAD


class _Part(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.n, self.per_task = options["path"], int(options.get("n", HEAD)), int(options.get("files_per_task", 1_000))

    def _fs(self):
        from pyarrow import fs

        if "://" in self.folder:
            return fs.FileSystem.from_uri(self.folder)
        return fs.LocalFileSystem(), self.folder.removeprefix("file:")

    def partitions(self) -> list[_Part]:
        from pyarrow import fs

        files, root = self._fs()
        found = sorted((i.path, i.size) for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File)
        return [_Part(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)] or [_Part([])]

    def read(self, partition: _Part):
        files, _ = self._fs()
        for path, size in partition.paths:
            with files.open_input_file(path) as f:
                yield path, size, f.read(self.n)


class HeadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "heads"

    def schema(self) -> str:
        return "path string, length long, head binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
