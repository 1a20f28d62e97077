"""Packages as a Spark data source: spark.read.format("paragraph_packages") and .write.format("paragraph_packages").

Reading gives a row per part (option ``rows`` = parts) or per paragraph (``paragraphs``). Files are dealt to partitions of about
``bytes_per_partition``; filters on ``part`` that Spark pushes down (``register`` sets spark.sql.python.filterPushdown.enabled) keep other
members from being read at all. A Python source is not told the columns that a query needs, so these are not pruned; an archive that can't be read gives one row
with its error.

Writing takes path, part, content, a package's rows next to each other in one partition (``for_packing`` sees to that). Each task writes its
packages under names of its own; only the commit of the whole job gives them their final names, and an abort deletes what was written, so
that a failed task leaves nothing. A package that two tasks wrote in part fails the commit.

Paths are those that pyarrow can open: local ones, or URIs of a store that all executors reach."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from paragrid.sources.packages import PARAGRAPH_ROW, paragraph_rows
from paragrid.sources.schemas import PART

NAME = "paragraph_packages"
PROSE = r"word/document\.xml|word/(header|footer)[0-9]*\.xml"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    """Final names and the names under which a task wrote them."""

    packages: list[tuple[str, str]]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.rows = options["path"], options.get("rows", "parts")
        self.size, self.suffix, self.wanted = int(options.get("bytes_per_partition", 32 << 20)), options.get("suffix", ".docx"), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("part",):
                these = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = these if self.wanted is None else self.wanted & these
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = _opened(self.path)
        found = sorted((i.path, i.size or 0) for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.endswith(self.suffix))
        out, held = [], 0
        for path, size in found:
            if not out or held + size > self.size:
                out, held = [*out, Files([])], 0
            out[-1].paths.append(path)
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _opened(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as f:
                data = f.read()
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in [n for n in z.namelist() if not n.endswith("/") and (self.wanted is None or n in self.wanted)]:
                        if self.rows == "parts":
                            yield path, name, z.read(name), None
                        elif re.fullmatch(PROSE, name):
                            yield from self.paragraphs(path, name, z.read(name))
            except (zipfile.BadZipFile, EOFError, OSError) as e:
                if self.wanted is None:
                    yield (path, None, None, type(e).__name__) if self.rows == "parts" else (path, *[None] * 11, type(e).__name__)

    @staticmethod
    def paragraphs(path: str, name: str, content: bytes) -> Iterator[tuple]:
        try:
            for row in paragraph_rows(content):
                yield path, name, *row, None
        except ElementTree.ParseError as e:
            yield path, name, *[None] * 10, str(e)


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, str]] = []
        try:
            held, of = [], None
            for row in rows:
                if row["path"] != of and held:
                    done.append(self.pack(store, root, of, held))
                    held = []
                of = row["path"]
                held.append((row["part"], bytes(row["content"])))
            if held:
                done.append(self.pack(store, root, of, held))
        except Exception:
            for _, temporary in done:
                store.delete_file(temporary)
            raise
        return Written(done)

    def pack(self, store: fs.FileSystem, root: str, path: str, members: list[tuple[str, bytes]]) -> tuple[str, str]:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(members, key=lambda m: (m[0] != "[Content_Types].xml", m[0])):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
        if (bad := zipfile.ZipFile(io.BytesIO(out.getvalue())).testzip()) is not None:
            raise ValueError(f"{path}: {bad} can't be read back")
        final = f"{root}/{path.rstrip('/').rpartition('/')[2]}"
        temporary = f"{root}/_{self.job}-{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as f:
            f.write(out.getvalue())
        return final, temporary

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _opened(self.path)
        made = [p for m in messages if m is not None for p in m.packages]
        names = [final for final, _ in made]
        twice = {n for n, k in Counter(names).items() if k > 1}
        there = [] if self.overwrite else [i.path for i in store.get_file_info(names) if i.is_file] if names else []
        if twice or there:
            self.abort(messages)
            raise ValueError(f"written by two tasks or there already: {sorted(twice | set(there))[:5]}")
        for final, temporary in made:
            store.move(temporary, final)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        left = [i.path for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.is_file and i.base_name.startswith(f"_{self.job}")]
        for path in left:
            store.delete_file(path)


class Packages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PART if self.options.get("rows", "parts") == "parts" else PARAGRAPH_ROW

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark push filters down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(Packages)


def for_packing(parts: DataFrame) -> DataFrame:
    """path, part, content with each package's rows next to each other in one partition."""
    return parts.where("part is not null and content is not null").select("path", "part", "content").repartition("path").sortWithinPartitions("path", F.col("part"))
