"""A pretty JSON array as a folder of ordered parts, written by the tasks and committed at once.

Laid end to end in the order of their names the parts are one array, indented by two blanks, as an editor or a JSON library would
write it. Each task writes its rows to a part in a folder of the job; when all are done the driver puts the brackets and commas, parts of
a few bytes, between them and renames the folder, so readers see the whole or nothing. A task that fails takes its part away, a job
that fails its folder.

    spark.dataSource.register(JsonArray)
    df.orderBy("id").write.format("json_array").mode("overwrite").save(folder)

An empty frame is an empty array; nulls are written as null; values that JSON lacks are written as their text. Fields are in the order
of the columns.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    rows: int


class JsonArrayWriter(DataSourceWriter):
    """[SNK-1]"""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.work = f"{self.folder}.{uuid.uuid4().hex[:12]}"

    def store(self):
        from pyarrow import fs

        uri = self.work if "://" in self.work else f"file://{self.work.removeprefix('file:')}"
        store, work = fs.FileSystem.from_uri(uri)
        return store, work

    def write(self, rows: Iterator[Row]) -> Part:
        store, work = self.store()
        task, n = TaskContext.get(), 0
        name = f"{task.partitionId():08d}.{task.taskAttemptId()}"
        store.create_dir(work)
        try:
            with store.open_output_stream(f"{work}/{name}") as f:
                for row in rows:
                    said = json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2, default=str)
                    f.write(((",\n  " if n else "  ") + said.replace("\n", "\n  ")).encode())
                    n += 1
        except BaseException:
            store.delete_file(f"{work}/{name}")
            raise
        return Part(task.partitionId(), name, n)

    def commit(self, messages: list[Part]) -> None:
        store, work = self.store()
        store.create_dir(work)
        done = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number)
        kept = {m.name for m in done}
        from pyarrow import fs

        for info in store.get_file_info(fs.FileSelector(work)):
            if info.base_name not in kept:  # empty parts, and those of attempts that were not taken
                store.delete_file(info.path)
        for k, m in enumerate(done):
            store.move(f"{work}/{m.name}", f"{work}/part-{k:08d}-rows.json")
            self.put(store, f"{work}/part-{k:08d}-0.json", ",\n" if k else "[\n")
        self.put(store, f"{work}/part-{len(done):08d}-end.json", "\n]\n" if done else "[]\n")
        final = work[: work.rindex(".")]
        if store.get_file_info(final).type != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(final)
            store.delete_dir(final)
        store.move(work, final)

    def put(self, store, path: str, text: str) -> None:
        with store.open_output_stream(path) as f:
            f.write(text.encode())

    def abort(self, messages: list[Part]) -> None:
        from pyarrow import fs

        store, work = self.store()
        if store.get_file_info(work).type != fs.FileType.NotFound:
            store.delete_dir(work)


class JsonArray(DataSource):
    """Option path: the folder."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def writer(self, schema, overwrite: bool) -> JsonArrayWriter:
        return JsonArrayWriter(self.options["path"], overwrite)


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """[SRC-3] The objects of such an array, each part parsed where it lies."""
    parts = spark.read.option("pathGlobFilter", "*-rows.json").text(folder, wholetext=True)
    whole = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<struct<{schema}>>")
    return parts.select(F.explode(whole).alias("x")).select("x.*")
