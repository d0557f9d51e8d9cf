"""One file a document, read and written by the executors.

The format ``folio_files`` has a row for each file: name, and body (text in UTF-8). A writing task puts its files into a
folder of its own attempt, and the driver, when all tasks are done, renames the folders to ``part-00000-<job>``, one
rename a task: a task that is run again, or a job that fails, leaves nothing that is read. Readers see the files
of finished folders only. Paths are those of pyarrow's file systems, a plain one being local; on a cluster they
have to be shared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from folioflow.operators import annots

NAME = "folio_files"
#: Bytes of files that a reading task takes, and files at most.
TASK_BYTES, TASK_FILES = 64 << 20, 2_000
MARK = "\ufeff"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    """Files of one reading task."""

    paths: list[str]


@dataclass
class Folder(WriterCommitMessage):
    """What a task has written: its folder, if there is any."""

    path: str | None
    n: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")

    def partitions(self) -> list[Files]:
        system, root = _opened(self.path)
        out, size = [Files([])], 0
        for folder in sorted((i.path for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and i.base_name.startswith("part-"))):
            for info in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
                if info.type != fs.FileType.File or not info.base_name.endswith(self.suffix):
                    continue
                if out[-1].paths and (size + info.size > TASK_BYTES or len(out[-1].paths) >= TASK_FILES):
                    out.append(Files([]))
                    size = 0
                out[-1].paths.append(info.path)
                size += info.size
        return out

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        system, _ = _opened(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                body = f.read().decode("utf-8", "replace")
            name = unquote(path.rpartition("/")[2])
            yield name[: len(name) - len(self.suffix)], body


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")
        self.mark = options.get("mark", "false").lower() == "true"
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Folder:
        system, root = _opened(self.path)
        folder, n = f"{root}/_open/{self.job}/{uuid.uuid4().hex}", 0
        for r in rows:
            if r["name"] is None:
                raise ValueError("a file needs a name")
            if not n:
                system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{quote(str(r['name']), safe=' ')}{self.suffix}") as f:
                f.write(((MARK if self.mark else "") + (r["body"] or "")).encode("utf-8", "surrogatepass"))
            n += 1
        return Folder(folder if n else None, n)

    def commit(self, messages: list[Folder]) -> None:
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        old = [i.path for i in system.get_file_info(fs.FileSelector(root)) if i.base_name.startswith("part-")] if self.overwrite else []
        for k, m in enumerate(m for m in messages if m is not None and m.path):
            system.move(m.path, f"{root}/part-{k:05d}-{self.job}")
        for path in old:
            system.delete_dir(path)
        self._tidy(system, root)

    def abort(self, messages: list[Folder | None]) -> None:
        self._tidy(*_opened(self.path))

    def _tidy(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_open/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_open/{self.job}")


class DocumentFiles(DataSource):
    """Options: path; suffix of the files' names; mark (true: a byte-order mark before each text)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "name string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def read_files(spark: SparkSession, path: str, *, suffix: str = "") -> DataFrame:
    """name (without the suffix) and body of the files of finished writes; a byte-order mark is taken off."""
    spark.dataSource.register(DocumentFiles)
    rows = spark.read.format(NAME).option("suffix", suffix).load(path)
    return rows.withColumn("body", F.when(F.col("body").startswith(MARK), F.substring("body", F.lit(2), F.char_length("body"))).otherwise(F.col("body")))


def write_files(docs: DataFrame, path: str, *, suffix: str = "", mark: bool = False, mode: str = "append") -> None:
    """A file for each row of name and body; of rows with one name in different tasks, each has a file in its task's folder."""
    docs.sparkSession.dataSource.register(DocumentFiles)
    docs.select(F.col("name").cast("string").alias("name"), "body").write.format(NAME).option("suffix", suffix).option("mark", str(mark)).mode(mode).save(path)


def write_csv_files(lines: DataFrame, path: str, *, mode: str = "append") -> None:
    """A CSV file, with a byte-order mark and CR LF after each line, for each table of (doc_id, page, r, line)."""
    rows = F.array_sort(F.collect_list(F.struct("r", "line")))
    body = F.concat(F.array_join(F.transform(rows, lambda x: x["line"]), "\r\n"), F.lit("\r\n"))
    write_files(lines.groupBy("doc_id", "page").agg(body.alias("body")).select(F.concat_ws("-", "doc_id", "page").alias("name"), "body"), path, suffix=".csv", mark=True, mode=mode)


def write_corpus_files(docs: DataFrame, path: str, *, suffix: str = ".md", mode: str = "append") -> None:
    """A text (.txt) or Markdown (.md) file for each document (doc_id, body)."""
    write_files(docs.select(F.col("doc_id").alias("name"), "body"), path, suffix=suffix, mode=mode)


def write_annot_files(annotations: DataFrame, path: str, *, fields: DataFrame | None = None, mode: str = "append") -> None:
    """An annotation document for each doc_id, with its form fields (see :func:`annots.write_documents`)."""
    write_files(annots.write_documents(annotations, fields).select(F.col("doc_id").alias("name"), "body"), path, suffix=".xfdf", mode=mode)


def read_annot_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The annotations and the form fields of a folder of annotation documents."""
    docs = read_files(spark, path, suffix=".xfdf").select(F.col("name").alias("doc_id"), "body")
    return annots.read_annots(docs), annots.read_fields(docs)
