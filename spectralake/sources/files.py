"""Files in any store that pyarrow reaches, and a data source that writes ordered files.

``ordered_files`` writes one file per name from rows ``(file, data)`` that lie together in
order. A task writes below a folder of its own job; only what the committed attempts
wrote moves to its place, then that folder goes with all that lost attempts left there.
"""

import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "ordered_files"


def opened(path):
    """(file system, path within it) of a path or URI."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    """Where a task wrote its files."""

    folder: str
    names: list


class OrderedFiles(DataSource):
    """Sink for rows ``(file string, data binary)``; option ``path`` is the target folder."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "file string, data binary"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path):
        self.path = path.rstrip("/")
        self.job = f"{self.path}/_job-{uuid.uuid4().hex}"

    def write(self, iterator):
        fs, job = opened(self.job)
        folder, names, out, last = f"{job}/{uuid.uuid4().hex}", [], None, None
        try:
            for batch in iterator:
                for name, data in zip(batch.column("file"), batch.column("data")):
                    if name.as_py() != last:
                        if out:
                            out.close()
                        if not names:
                            fs.create_dir(folder)
                        last = name.as_py()
                        names.append(last)
                        out = fs.open_output_stream(f"{folder}/{last}")
                    out.write(data.as_buffer())
        finally:
            if out:
                out.close()
        if len(set(names)) < len(names):
            raise ValueError("rows of a file must lie together")
        return Written(folder, names)

    def commit(self, messages):
        fs, path = opened(self.path)
        fs.create_dir(path)
        for message in filter(None, messages):
            for name in message.names:
                fs.move(f"{message.folder}/{name}", f"{path}/{name}")
        self._clear(fs)

    def abort(self, messages):
        self._clear(opened(self.path)[0])

    def _clear(self, fs):
        job = opened(self.job)[1]
        if fs.get_file_info(job).type == pafs.FileType.Directory:
            fs.delete_dir(job)


def write_files(rows, path):
    """Write ``(file, part, data)`` as one file per name, its parts in order.

    The rows of a file are brought together and sorted, so a file is written by one task
    as it streams by; a task holds one Arrow batch.
    """
    spark = rows.sparkSession
    spark.dataSource.register(OrderedFiles)
    together = rows.repartition("file").sortWithinPartitions("file", "part").select("file", "data")
    together.write.format(FORMAT).mode("append").option("path", path).save()
