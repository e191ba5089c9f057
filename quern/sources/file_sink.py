"""A Spark data sink for files: each row names a file and holds its content, or a part of it.

    spark.dataSource.register(FileSink)
    rows.write.format("quern_files").mode("append").save(folder)    # file string, content binary

Tasks write to a folder of their own beside the files; only when all have ended does the driver move the files to their
names. A job that fails leaves nothing to be seen, and a task that is run again does no harm. Files are moved within one
file system, opened by Arrow, so any that it knows will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Moves that run side by side.
MOVES = 16


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: name, where it is until the job ends, bytes, SHA-256."""

    files: list[tuple[str, str, int, str]]


def _named(name: str) -> str:
    if not name or name.startswith("/") or any(p in ("", ".", "..") for p in name.split("/")):
        raise ValueError(f"not a name of a file below the folder: {name!r}")
    return name


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, replace: bool) -> None:
        self.path, self.replace, self.job = options["path"], replace, uuid.uuid4().hex
        self.manifest, self.parts = options.get("manifest"), options.get("parts") == "true"
        if not {"file", "content"} <= set(schema.fieldNames()):
            raise ValueError("rows of files have the columns file and content")

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Writes the rows in turn; with ``parts`` neighbours of one name go to one file."""
        store, root = self._store()
        own = f"{root}/_writing-{self.job}/{uuid.uuid4().hex}"
        files: list[tuple[str, str, int, str]] = []
        last, out, size, digest = None, None, 0, hashlib.sha256()

        def end() -> None:
            if out is not None:
                out.close()
                files.append((last, f"{own}/{last}", size, digest.hexdigest()))

        try:
            for batch in iterator:
                for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                    if name != last or not self.parts:
                        end()
                        last, size, digest, out = _named(name), 0, hashlib.sha256(), None
                        store.create_dir(f"{own}/{name}".rpartition("/")[0])
                        out = store.open_output_stream(f"{own}/{name}")
                    data = content.as_buffer() if content.is_valid else b""
                    out.write(data)
                    digest.update(data)
                    size += len(data)
            end()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Moves all files to their names; two rows of one name, and without ``overwrite`` a file of other content, are errors."""
        store, root = self._store()
        files = [f for m in messages if m is not None for f in m.files]
        try:
            if len({name for name, *_ in files}) < len(files):
                raise ValueError("two rows name one file: " + next(n for i, (n, *_) in enumerate(files) if n in {m for m, *_ in files[:i]}))

            def same(file: tuple[str, str, int, str]) -> bool:
                at = store.get_file_info(f"{root}/{file[0]}")
                if at.type == fs.FileType.NotFound:
                    return False
                if not self.replace:
                    with store.open_input_stream(at.path) as f:
                        digest = hashlib.sha256()
                        while piece := f.read(1 << 20):
                            digest.update(piece)
                    if digest.hexdigest() != file[3]:
                        raise FileExistsError(f"{at.path} is there with other content")
                    return True
                return False

            def move(file: tuple[str, str, int, str]) -> None:
                target = f"{root}/{file[0]}"
                store.create_dir(target.rpartition("/")[0])
                store.move(file[1], target)

            with ThreadPoolExecutor(MOVES) as pool:
                there = list(pool.map(same, files))  # all are looked at before any is moved
                list(pool.map(move, [f for f, known in zip(files, there, strict=True) if not known]))
            if self.manifest:
                with store.open_output_stream(f"{root}/{_named(self.manifest)}") as f:
                    for name, _, size, sha in sorted(files):
                        f.write((json.dumps({"file": name, "size": size, "sha256": sha}) + "\n").encode())
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        staged = f"{root}/_writing-{self.job}"
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


class FileSink(DataSource):
    """``quern_files``; options: path, parts (rows that follow each other may share a file), manifest (a JSON
    lines file of names, sizes and hashes, written last). ``overwrite`` replaces files."""

    @classmethod
    def name(cls) -> str:
        return "quern_files"

    def schema(self) -> str:
        return "file string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options), schema, overwrite)


def write(rows: DataFrame, folder: str, replace: bool = False, manifest: str | None = None) -> None:
    """Writes rows ``file, content`` (and ``part``: several rows to a file, in that order) below a folder that all executors share."""
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    parts = "part" in rows.columns
    if parts:
        rows = rows.repartition("file").sortWithinPartitions("file", "part")
    out = rows.select("file", "content").write.format("quern_files").mode("overwrite" if replace else "append").option("parts", str(parts).lower())
    (out.option("manifest", manifest) if manifest else out).save(folder)
