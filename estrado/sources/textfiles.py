"""Rows as text files under their own names: a Python data source for writing.

Tasks write below a folder of the job that no reader of texts sees; the commit moves the files into place, and a job that fails leaves nothing behind. Paths
are whatever ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes of a file name before its ending.
LONGEST = 200


def named(docs: DataFrame, folder: str = "carpeta", name: str = "nombre", text: str = "contenido") -> DataFrame:
    """docs -> carpeta, nombre, contenido with names that a file may have and no two rows of a folder share.

    Characters that file systems refuse become ``_``; names are told apart without regard to case, and the second to use one ends in `` (2)``. A name that already ends like
    that gets a number in any case, so that no numbered name meets another.
    """
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r'[\x00-\x1f<>:"/\\|?*]', "_"), r"(?i)\.txt$", "")
    safe = F.regexp_replace(F.regexp_replace(F.substring(safe, 1, LONGEST // 4), r"^[.\s]+|[.\s]+$", ""), r"^$", "sin_nombre")
    where = F.regexp_replace(F.coalesce(F.col(folder), F.lit("")) if folder in docs.columns else F.lit(""), r'[\x00-\x1f<>:"/\\|?*]|^\.+', "_")
    d = docs.select(where.alias("carpeta"), safe.alias("_base"), F.col(name).alias("_name"), F.coalesce(F.col(text), F.lit("")).alias("contenido"))
    n = F.row_number().over(Window.partitionBy("carpeta", F.lower("_base")).orderBy("_base", F.xxhash64("_name", "contenido")))
    d = d.withColumn("_n", n)
    again = (F.col("_n") > 1) | F.col("_base").rlike(r" \(\d+\)$")
    return d.select("carpeta", F.concat("_base", F.when(again, F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(F.lit("")), F.lit(".txt")).alias("nombre"), "contenido")


def write_named(docs: DataFrame, path: str, **names: str) -> None:
    """Writes each row of ``docs`` as one file below ``path``, in the folder of its ``carpeta`` if there is that column."""
    spark = docs.sparkSession
    spark.dataSource.register(TextFiles)
    named(docs, **names).write.format("named_texts").option("path", path).mode("append").save()


@dataclass
class Done(WriterCommitMessage):
    files: int


class Writer(DataSourceWriter):
    def __init__(self, path: str, stop_at: str | None = None):
        self.path, self.hidden, self.stop_at = path.rstrip("/"), f"_files-{uuid.uuid4().hex}", stop_at

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or not self.path.startswith("file:") else self.path.replace("file:", "file://", 1))

    def write(self, iterator: Iterator) -> Done:
        """A row's file is written under its own name, so that a task that runs again writes the same files."""
        at, root = self._open()
        n, made = 0, set()
        for row in iterator:
            if self.stop_at is not None and row["nombre"] == self.stop_at:
                raise OSError(f"can't write {self.stop_at}")
            where = posixpath.join(root, self.hidden, row["carpeta"])
            if where not in made:
                at.create_dir(where, recursive=True)
                made.add(where)
            with at.open_output_stream(posixpath.join(where, row["nombre"])) as out:
                out.write(row["contenido"].encode())
            n += 1
        return Done(n)

    def commit(self, messages: list[Done | None]) -> None:
        at, root = self._open()
        hidden = posixpath.join(root, self.hidden)
        for info in at.get_file_info(fs.FileSelector(hidden, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File:
                to = posixpath.join(root, posixpath.relpath(info.path, hidden))
                at.create_dir(posixpath.dirname(to), recursive=True)
                at.move(info.path, to)
        self.abort(messages)

    def abort(self, messages: list[Done | None]) -> None:
        at, root = self._open()
        if at.get_file_info(posixpath.join(root, self.hidden)).type != fs.FileType.NotFound:
            at.delete_dir(posixpath.join(root, self.hidden))


class TextFiles(DataSource):
    """``named_texts``: columns carpeta, nombre, contenido, as of ``named``. Option ``stopat`` makes the row of that name fail, for tests."""

    @classmethod
    def name(cls) -> str:
        return "named_texts"

    def schema(self) -> str:
        return "carpeta string, nombre string, contenido string"

    def writer(self, schema, overwrite: bool) -> Writer:
        o = {k.lower(): v for k, v in self.options.items()}
        return Writer(o["path"], o.get("stopat"))
