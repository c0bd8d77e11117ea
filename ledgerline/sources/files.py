"""A sink that makes one file of each row, all or none: a Python data source with a commit in two phases.

Tasks write under a folder of their own attempt in a staging folder; when all tasks have succeeded the
driver moves the files of the attempts that count to their places, and else everything staged goes. So a
task that is tried again, or runs twice at once, leaves its files once, and a job that fails leaves none
(at most a hidden staging folder, of a task that was still running when the job was given up).
A file that cannot be written is told in `_not_saved`, and is no failure of the job.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME, SCHEMA = "one_file_each", "path string, content string"
#: Files moved at once when a job commits.
MOVERS = 16
NOT_SAVED = "_not_saved"


def place(folder: str):
    """The file system of a path or URI that driver and executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


@dataclass
class Staged(WriterCommitMessage):
    attempt: str


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str, run: str):
        self.folder, self.run = folder.rstrip("/"), run

    def _staging(self) -> tuple:
        system, root = place(self.folder)
        return system, root, f"{root}/.staging-{self.run}"

    def write(self, rows) -> Staged:
        system, _, staging = self._staging()
        context = TaskContext.get()
        attempt = str(context.taskAttemptId()) if context is not None else uuid.uuid4().hex
        lost, made = [], set()
        for row in rows:
            try:
                parts = row.path.split("/")
                if not all(parts) or {".", ".."} & {*parts}:
                    raise OSError(f"not a path below the folder: {row.path}")
                file = f"{staging}/{attempt}/files/{row.path}"
                if (above := file.rpartition("/")[0]) not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                with system.open_output_stream(file) as out:
                    out.write((row.content or "").encode())
            except OSError as e:
                lost.append({"path": row.path, "error": str(e)})
        if lost:
            system.create_dir(f"{staging}/{attempt}", recursive=True)
            with system.open_output_stream(f"{staging}/{attempt}/lost.json") as out:
                out.write("\n".join(map(json.dumps, lost)).encode())
        return Staged(attempt)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        system, root, staging = self._staging()
        system.create_dir(root, recursive=True)
        moves, folders = [], set()
        for attempt in sorted(m.attempt for m in messages if m is not None):
            whole = f"{staging}/{attempt}/files/"
            for info in system.get_file_info(fs.FileSelector(whole, recursive=True, allow_not_found=True)):
                if info.type == fs.FileType.File:
                    to = f"{root}/{info.path[info.path.index(whole) + len(whole) :]}"
                    moves.append((info.path, to))
                    folders.add(to.rpartition("/")[0])
            if system.get_file_info(f"{staging}/{attempt}/lost.json").type == fs.FileType.File:
                moves.append((f"{staging}/{attempt}/lost.json", f"{root}/{NOT_SAVED}/{self.run}-{attempt}.json"))
                folders.add(f"{root}/{NOT_SAVED}")
        for folder in sorted(folders):
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVERS) as movers:
            list(movers.map(lambda m: system.move(*m), moves))
        self._clear(system, staging)

    def abort(self, messages: list[Staged | None]) -> None:
        system, _, staging = self._staging()
        self._clear(system, staging)

    @staticmethod
    def _clear(system, staging: str) -> None:
        from pyarrow import fs

        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class Files(DataSource):
    """Rows of path (below the folder) and content as files."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], self.options.get("run") or uuid.uuid4().hex)


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Files of rows (path, content), replacing those that are there already; gives (path, error) of files that could not be written."""
    from pyarrow import fs

    spark, run = rows.sparkSession, uuid.uuid4().hex
    system, root = place(folder.rstrip("/"))
    try:
        system.create_dir(root, recursive=True)
    except OSError as e:  # there is no such place, so there is no file
        return rows.select("path", F.lit(str(e)).alias("error"))
    spark.dataSource.register(Files)
    rows.select("path", "content").write.format(NAME).mode("append").option("run", run).save(folder)
    told = [x for x in system.get_file_info(fs.FileSelector(f"{root}/{NOT_SAVED}", allow_not_found=True)) if x.base_name.startswith(run)]
    if not told:
        return spark.createDataFrame([], "path string, error string")
    return spark.read.schema("path string, error string").json(f"{folder.rstrip('/')}/{NOT_SAVED}/{run}-*.json")
