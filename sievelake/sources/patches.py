"""Patches as a data source of Spark: ``spark.read.format("patches")`` reads bundles of diffs, ``df.write.format("findings")`` writes findings with a commit.

A bundle is what a series of patches is written to: each begins with a line ``From <id> Mon Sep 17 00:00:00 2001``. Files are read through pyarrow's file
systems, so a path may be of any store that these know (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith, WriterCommitMessage

PATCHES = "diff_id string, section int, path string, language string, diff_content string"
#: What begins a patch in a bundle, and the line that names a file after the change.
FROM, TO = re.compile(r"^From (\S+) Mon Sep 17 00:00:00 2001$"), "+++ b/"
PUSHED = "spark.sql.python.filterPushdown.enabled"
BATCH_BYTES = 8 << 20  # of diffs in one Arrow batch


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else f"file://{path.removeprefix('file:')}")


def sections(lines: Iterator[str]) -> Iterator[tuple[str | None, int, str | None, str]]:
    """diff_id, section from 1, path and text of each file's part of each patch; what stands before a patch's first ``diff --git`` line is left out.

    Lines before the first patch belong to one without an id. One part stands in memory at a time.
    """
    diff_id, section, part, path = None, 0, [], None

    def ended():
        return (diff_id, section, path, "\n".join(part))

    for line in lines:
        head = FROM.match(line)
        if head or line.startswith("diff --git "):
            if part:
                yield ended()
            part, path = [], None
            if head:
                diff_id, section = head[1], 0
                continue
            section += 1
        if section:
            part.append(line)
            path = line[len(TO) :] if line.startswith(TO) else path
    if part:
        yield ended()


@dataclass
class Bundle(InputPartition):
    path: str


class PatchReader(DataSourceReader):
    """A partition for each file of the folder; sections whose path the pushed filters rule out never become rows."""

    def __init__(self, path: str):
        self.path, self.wanted = path, []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if f.__class__ in (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith) and f.attribute == ("path",):
                self.wanted.append((f.__class__.__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, base = store_of(self.path)
        found = store.get_file_info(base)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        return [Bundle(f.path) for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def keeps(self, path: str | None) -> bool:
        tests = {"IsNotNull": lambda v: True, "EqualTo": lambda v: path == v, "In": lambda v: path in v, "StringStartsWith": lambda v: path.startswith(v), "StringEndsWith": lambda v: path.endswith(v)}
        return not self.wanted or (path is not None and all(tests[kind](value) for kind, value in self.wanted))

    def read(self, partition: Bundle | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's own stand-in for no partitions
            return
        store, _ = store_of(self.path)
        schema = pa.schema([("diff_id", pa.string()), ("section", pa.int32()), ("path", pa.string()), ("language", pa.string()), ("diff_content", pa.string())])
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        with store.open_input_stream(partition.path) as raw:
            for diff_id, section, path, content in sections(_lines(raw)):
                if self.keeps(path):
                    rows.append((diff_id, section, path, "", content))
                    size += len(content)
                if size > BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


def _lines(raw) -> Iterator[str]:
    """Lines of a stream, ended by newlines alone, read a few megabytes at a time."""
    rest = b""
    while block := raw.read(4 << 20):
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            yield line.decode("utf-8", "replace")
    if rest:
        yield rest.decode("utf-8", "replace")


class PatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "patches"

    def schema(self) -> str:
        return PATCHES

    def reader(self, schema: T.StructType) -> PatchReader:
        return PatchReader(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class FindingsWriter(DataSourceArrowWriter):
    """A Parquet file a task. Only a file that the commit's manifest names counts: those of tasks that failed, or ran twice, are never read."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, base = store_of(self.path)
        name, rows, out = f"part-{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in batches:
                if out is None:
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(posixpath.join(base, name))
                    out = pq.ParquetWriter(sink, batch.schema)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
                sink.close()
        return Written(name if out is not None else None, rows)

    def commit(self, messages: list) -> None:
        store, base = store_of(self.path)
        store.create_dir(base, recursive=True)
        before = [] if self.overwrite else manifest(self.path)
        files = [*before, *({"file": m.file, "rows": m.rows} for m in messages if m and m.file)]
        aside = posixpath.join(base, f"_{uuid.uuid4().hex}")
        with store.open_output_stream(aside) as out:
            out.write(json.dumps(files).encode())
        store.move(aside, posixpath.join(base, MANIFEST))

    def abort(self, messages: list) -> None:
        store, base = store_of(self.path)
        for m in messages:
            if m and m.file:
                store.delete_file(posixpath.join(base, m.file))


MANIFEST = "_manifest.json"


def manifest(path: str) -> list[dict]:
    """The committed files of a folder of findings, each with its number of rows; none before the first commit."""
    store, base = store_of(path)
    at = posixpath.join(base, MANIFEST)
    if store.get_file_info(at).type != fs.FileType.File:
        return []
    with store.open_input_stream(at) as found:
        return json.loads(found.read())


class FindingsSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "findings"

    def writer(self, schema: T.StructType, overwrite: bool) -> FindingsWriter:
        return FindingsWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and lets it push filters to Python sources."""
    spark.dataSource.register(PatchSource)
    spark.dataSource.register(FindingsSink)
    spark.conf.set(PUSHED, "true")


def read_findings(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The committed rows of a folder that ``findings`` wrote."""
    files = manifest(path)
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[posixpath.join(path, f["file"]) for f in files])


def bundled(diffs: DataFrame, path: str, content: str = "diff_content") -> None:
    """Writes ``diffs`` (diff_id, content) as bundles, a file a task."""
    head = F.concat(F.lit("From "), F.col("diff_id").cast("string"), F.lit(" Mon Sep 17 00:00:00 2001\n"))
    diffs.select(F.concat(head, content).alias("value")).write.text(path)
