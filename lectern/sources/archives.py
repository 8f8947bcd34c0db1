"""Members of zip archives as a data source: tasks read shares of an archive, and what is broken is a row that says so."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, member string, size long, content binary, problem string"


class _Share(InputPartition):
    """Every ``of``-th member of an archive, from ``number`` on."""

    def __init__(self, path: str, number: int, of: int):
        self.path, self.number, self.of = path, number, of


def _listed(store, path: str, size: int) -> int:
    """Bytes of an archive's list of members by the record at its end; 1 if no record is there."""
    with store.open_input_file(path) as file:
        file.seek(max(0, size - 22))
        end = file.read(22)
    return max(1, int.from_bytes(end[12:16], "little")) if end[:4] == b"PK\5\6" else 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.name = options["path"], options.get("member")
        self.share = int(options.get("sharebytes", 64 << 20))

    def partitions(self) -> list[_Share]:
        """Only names and sizes of archives are listed here, and of those to share out the size of their list of members.

        Each share reads the whole list, so an archive has no more shares than keep all these reads within four times its size.
        """
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(where)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(where, recursive=True))
        prefix = self.path.split("://")[0] + "://" if "://" in self.path else ""
        archives = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))
        shares = [(prefix + path, max(1, min(-(-size // self.share), 4 * size // _listed(store, path, size)) if size > self.share else 1)) for path, size in archives]
        return [_Share(path, k, n) for path, n in shares for k in range(n)] or [_Share("", 0, 1)]

    def read(self, partition: _Share) -> Iterator[tuple]:
        import zipfile
        import zlib

        from pyarrow import fs

        if not partition.path:
            return
        store, where = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        with store.open_input_file(where) as file:
            try:
                archive = zipfile.ZipFile(file)
            except (zipfile.BadZipFile, ValueError) as broken:  # a file too short to look at is a ValueError
                if partition.number == 0:
                    yield partition.path, None, None, None, f"no archive: {broken}"
                return
            for k, info in enumerate(archive.infolist()):
                if k % partition.of != partition.number or info.is_dir() or (self.name and info.filename != self.name):
                    continue
                try:
                    content = archive.read(info)  # checks the stored sum
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError) as broken:
                    yield partition.path, info.filename, info.file_size, None, f"broken member: {broken}"
                    continue
                problem = None if len(content) == info.file_size else f"broken member: {len(content)} bytes instead of {info.file_size}"
                yield partition.path, info.filename, info.file_size, None if problem else content, problem


class ZipMembers(DataSource):
    """``zip_members``: a row a member.  Options: path (an archive or a folder of them), member (one name), shareBytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def zip_members(spark: SparkSession, path: str, member: str | None = None, share_bytes: int = 64 << 20) -> DataFrame:
    """(archive, member, size, content, problem) of all members, or of those of one name.

    An archive of more than share_bytes is read by several tasks, each some of its members; by few if it has many small ones.  A member whose size or sum is wrong, and a file
    that is no archive, is a row without content that names the problem; nothing is dropped.  path must be one that all executors reach.
    """
    spark.dataSource.register(ZipMembers)
    reader = spark.read.format("zip_members").option("shareBytes", share_bytes)
    return (reader.option("member", member) if member else reader).load(path)


def write_archives(df: DataFrame, path: str, archive: str, member: str, text: str) -> DataFrame:
    """Write a zip file for each value of archive below path, with a member for each row; (archive, members), a row a file.

    Rows of an archive meet in one task, as the format asks for one writer.
    """

    def write(key, pdf):
        import zipfile

        import pandas as pd
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        store.create_dir(where, recursive=True)
        with store.open_output_stream(f"{where}/{key[0]}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
            for name, body in sorted(zip(pdf["m"], pdf["t"])):
                target.writestr(zipfile.ZipInfo(name), body)
        return pd.DataFrame({"archive": [str(key[0])], "members": [len(pdf)]})

    from pyspark.sql import functions as F

    rows = df.select(F.col(archive).cast("string").alias("a"), F.col(member).cast("string").alias("m"), F.col(text).cast("string").alias("t"))
    return rows.groupBy("a").applyInPandas(write, "archive string, members long")
