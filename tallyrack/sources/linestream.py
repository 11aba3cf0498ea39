"""A stream of the lines of monitor files: a data source whose offsets are places in the order of files.

Files are taken in the order of (change time, path), ``$`` lines included; a run that starts
again goes on behind the last file that it has committed.  A file has to be whole when it
appears, and to be changed later than those before it (a moved file keeps an old time: touch it).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "monitor_lines"
SCHEMA = "file string, pos long, line string"


class LineStream(DataSource):
    """Option: ``path``, a folder of files on any store that pyarrow reads.  A batch has all that is new; a task has one file."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LineReader(self.options["path"])


class LineReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _opened(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def _files(self) -> list[tuple[int, str]]:
        from pyarrow import fs

        system, root = self._opened()
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return sorted((x.mtime_ns, x.path) for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        time, path = max(self._files(), default=(-1, ""))
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return [InputPartition(path) for time, path in self._files() if low < (time, path) <= high]

    def read(self, partition: InputPartition):
        system, _ = self._opened()
        with system.open_input_stream(partition.value) as f:
            rest, pos = b"", 0
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    yield (partition.value, pos, line.decode("utf-8", "replace"))
                    pos += 1
            if rest:
                yield (partition.value, pos, rest.decode("utf-8", "replace"))


def lines(spark: SparkSession, path: str):
    """A streaming DataFrame (file, pos, line)."""
    spark.dataSource.register(LineStream)
    return spark.readStream.format(FORMAT).option("path", path).load()
