"""FASTA files as a Spark data source, batch and stream: plain, gzip, bzip2 or xz, on any file system that Arrow opens.

``spark.dataSource.register(Fasta)``, then ``spark.read.format("fasta").option("paths", json list)``, ``read_fasta(spark, paths)`` or
``stream_fasta(spark, folder)``.  A header is what follows the first ``>`` of a line; sequence lines are joined without blanks
in upper case; a header without a sequence is no record.  ``ordinal`` counts on over the files in the order given.

An xz file of several blocks (or streams, as the sink writes it) is read in several tasks, each of which decodes its own blocks and, for its
last record, the beginning of the next ones.  Other files are a partition each; ``read_fasta_text`` reads plain ones in splits.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import uuid
from collections.abc import Iterator, Sequence
from itertools import chain

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from . import files
from .storage import written

SCHEMA = "file string, file_number int, part int, number long, name string, seq string"
#: Text of the blocks that a task reads, and of a block that the sink writes.
PART, BLOCK = 64 << 20, 8 << 20
#: Bits of an ordinal in a stream: a record's place in its part, the part's in its file; those above number the file.
PLACES, PARTS = 28, 15


def headed(line: bytes) -> tuple[str, bool, str]:
    """A line's text before the first ``>``, whether there is one, and what follows it."""
    before, mark, header = line.decode("utf-8", "replace").partition(">")
    return before, bool(mark), header.strip()


def records(lines: Iterator[bytes], first: bool = True, own: int | None = None) -> Iterator[tuple[str, str]]:
    """Records whose header stands in the first ``own`` bytes of ``lines`` (all, if ``None``).

    Lines from the second on to the one that begins right after those bytes are the part's own; a part that is not the ``first`` of its
    file leaves its first line, or what there is of it, to the part before."""
    name, parts, at = None, [], 0
    for whole in lines:
        begins, at = at, at + len(whole)
        if not begins and not first:
            continue
        for line in whole.replace(b"\r\n", b"\n").split(b"\r"):
            before, mark, header = headed(line)
            past = own is not None and begins > own
            if not mark:
                if name is None and past:
                    return
                parts.append("".join(before.split()).upper())
                continue
            if name is not None and any(parts):
                yield name, "".join(parts)
            if past:
                return
            name, parts = header, []
    if name is not None and any(parts):
        yield name, "".join(parts)


class FilePartition(InputPartition):
    """A file, or blocks ``begin`` to ``end`` of one whose blocks from ``begin`` on are ``blocks``."""

    def __init__(self, number: int, path: str, part: int = 0, blocks: list[files.Block] | None = None, own: int = 0):
        self.number, self.path, self.part, self.blocks, self.own = number, path, part, blocks, own

    def records(self) -> Iterator[tuple]:
        if self.blocks is None:
            found = records(files.text_lines(self.path))
            yield from ((self.path, self.number, self.part, i, name, seq) for i, (name, seq) in enumerate(found))
            return
        with files.opened(self.path) as f:
            text = chain.from_iterable(files.block_text(f, b) for b in self.blocks)
            found = records(files.lines(text), self.part == 0, sum(b.text for b in self.blocks[: self.own]))
            for i, (name, seq) in enumerate(found):
                yield self.path, self.number, self.part, i, name, seq


def parts_of_file(number: int, path: str, size: int = PART) -> list[FilePartition]:
    """An xz file's blocks in runs of about ``size`` bytes of text; any other file whole."""
    system, at = files.located(path)
    with files.opened(path) as f:
        xz = f.read(6) == files.XZ
        blocks = files.blocks(f, system.get_file_info(at).size) if xz else []
    if len(blocks) < 2:
        return [FilePartition(number, path)]
    out, begin, held = [], 0, 0
    for k, b in enumerate(blocks):
        held += b.text
        if held >= size or k == len(blocks) - 1:
            out.append(FilePartition(number, path, len(out), blocks[begin:], k + 1 - begin))
            begin, held = k + 1, 0
    return out


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.size = int(options.get("partSize", PART))

    def partitions(self) -> list[FilePartition]:
        return [x for i, p in enumerate(self.paths) for x in parts_of_file(i, p, self.size)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        return partition.records()


class FastaStreamReader(DataSourceStreamReader):
    """Files of a folder as they appear, whole.  An offset numbers the files that have been taken; it is kept in the stream's checkpoint, so
    that a batch that is run again has the same files under the same numbers, and a new run goes on with new files."""

    def __init__(self, options: dict):
        self.folder, self.most = options["path"], int(options.get("maxFilesPerTrigger", 0))
        self.size = int(options.get("partSize", PART))
        self.taken: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        new = [p for p, _ in files.listed(self.folder) if p not in self.taken]
        first = len(self.taken)
        self.taken = self.taken | {p: first + k for k, p in enumerate(new[: self.most or None])}
        return self.taken

    def partitions(self, start: dict, end: dict) -> Sequence[FilePartition]:
        self.taken = self.taken | end  # after a restart: what the checkpoint has
        return [x for p, number in sorted(end.items(), key=lambda x: x[1]) if p not in start for x in parts_of_file(number, p, self.size)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        return partition.records()


class TaskFile:
    """A task's file, hidden until the job has succeeded."""

    def __init__(self, folder: str, codec: str, block: int = BLOCK):
        self.block = block
        self.suffix = {"xz": ".xz", "gzip": ".gz", "bzip2": ".bz2", "none": ""}[codec]
        self.codec, (self.system, self.folder) = codec, files.located(folder)

    def written(self, texts: Iterator[str]) -> tuple[str, str, int]:
        """The hidden file, the suffix of its name to be, and how many texts it has.  xz texts go out in blocks that can be read on their own."""
        packed = {"xz": lzma.compress, "gzip": gzip.compress, "bzip2": bz2.compress, "none": bytes}[self.codec]
        hidden, n, held, size = f"{self.folder}/.{uuid.uuid4().hex}", 0, [], 0
        with self.system.open_output_stream(hidden, compression=None) as out:
            for text in texts:
                held.append(text.encode())
                size, n = size + len(held[-1]), n + 1
                if size >= self.block:
                    out.write(packed(b"".join(held)))
                    held, size = [], 0
            if held:
                out.write(packed(b"".join(held)))
        return hidden, self.suffix, n


class FastaWriter(DataSourceWriter):
    """One file for each task with records, which takes its name when the job has succeeded."""

    def __init__(self, options: dict):
        self.path, self.codec, self.block = options["path"], options.get("compression", "xz"), int(options.get("blockSize", BLOCK))
        system, folder = files.located(self.path)
        system.create_dir(folder, recursive=True)

    def text(self, row) -> str:
        return f">{row.name}\n{row.seq}\n"

    def name(self, part: int, batch: int | None = None) -> str:
        return f"part-{part:05d}.aln" if batch is None else f"batch-{batch:08d}-part-{part:05d}.aln"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        message = WriterCommitMessage()
        message.part, message.file = TaskContext.get().partitionId(), TaskFile(self.path, self.codec, self.block).written(map(self.text, iterator))
        return message

    def moved(self, messages: list, batch: int | None) -> None:
        system, folder = files.located(self.path)
        for m in messages:
            hidden, suffix, n = m.file
            if n:
                system.move(hidden, f"{folder}/{self.name(m.part, batch)}{suffix}")
            else:
                system.delete_file(hidden)

    def commit(self, messages: list) -> None:
        self.moved(messages, None)

    def abort(self, messages: list) -> None:
        system, _ = files.located(self.path)
        for m in messages:
            if m is not None and system.get_file_info(m.file[0]).is_file:
                system.delete_file(m.file[0])


class FastaStreamWriter(FastaWriter, DataSourceStreamWriter):
    """The same for each batch of a stream; a batch that is committed again replaces its files."""

    def commit(self, messages: list, batchId: int) -> None:
        system, folder = files.located(self.path)
        for path, _ in files.listed(folder):
            if path.rsplit("/", 1)[1].startswith(f"batch-{batchId:08d}-"):
                system.delete_file(path)
        self.moved(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        FastaWriter.abort(self, messages)


class Fasta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)

    def streamReader(self, schema) -> FastaStreamReader:
        return FastaStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> FastaWriter:
        return FastaWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> FastaStreamWriter:
        return FastaStreamWriter(self.options)


class LinesWriter(FastaWriter):
    def __init__(self, options: dict):
        super().__init__(options)
        self.prefix = options.get("prefix", "part")

    def text(self, row) -> str:
        return f"{row.value}\n"

    def name(self, part: int, batch: int | None = None) -> str:
        return f"{self.prefix}-{part:05d}.txt"


class Lines(DataSource):
    """A sink for lines of text (``value``) with the codecs of ``Fasta``: what Spark's text writer lacks is xz."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options)


def read_fasta(spark: SparkSession, paths: list[str], part_size: int = PART) -> DataFrame:
    """``ordinal, name, seq`` of all files; the first file's records come first.  They are decoded once, into a table in the shared folder."""
    spark.dataSource.register(Fasta)
    df = written(spark.read.format("fasta").option("paths", json.dumps(paths)).option("partSize", part_size).load(), "fasta")
    parts = df.groupBy("file_number", "part").agg(F.count("*").alias("n"))  # a row for each task that read
    before = parts.select("file_number", "part", (F.sum("n").over(Window.orderBy("file_number", "part")) - F.col("n")).alias("before"))
    return df.join(F.broadcast(before), ["file_number", "part"]).select((F.col("before") + F.col("number")).cast("long").alias("ordinal"), "name", "seq")


def stream_fasta(spark: SparkSession, folder: str, files_per_batch: int = 0, part_size: int = PART) -> DataFrame:
    """``ordinal, name, seq`` of the files in a folder as they appear.

    ``files_per_batch``: for triggers that go on; ``availableNow`` takes one batch of what is there, which should have no limit.
    Ordinals rise with the number of the file and the record's place in it, but don't follow each other; a part of a
    file with more records than there are places for them stops the stream."""
    spark.dataSource.register(Fasta)
    df = spark.readStream.format("fasta").option("maxFilesPerTrigger", files_per_batch).option("partSize", part_size).load(folder)
    fits = (F.col("number") < 1 << PLACES) & (F.col("part") < 1 << PARTS) & (F.col("file_number") < 1 << 63 - PLACES - PARTS)
    ordinal = F.shiftleft(F.shiftleft(F.col("file_number").cast("long"), PARTS) + F.col("part"), PLACES) + F.col("number")
    return df.select(F.when(fits, ordinal).otherwise(F.raise_error(F.concat(F.lit("too many records in "), "file"))).cast("long").alias("ordinal"), "name", "seq")


def write_fasta(df: DataFrame, folder: str, compression: str = "xz", block_size: int = BLOCK) -> None:
    """A file for each task, in the order of the tasks; xz files have blocks of about ``block_size`` bytes of text."""
    df.sparkSession.dataSource.register(Fasta)
    fasta_columns(df).write.format("fasta").option("compression", compression).option("blockSize", block_size).mode("append").save(folder)


def fasta_columns(df: DataFrame) -> DataFrame:
    return df.select(F.lit("").alias("file"), F.lit(0).alias("file_number"), F.lit(0).alias("part"), F.col("ordinal").cast("long").alias("number"), "name", "seq")


def write_fasta_stream(df: DataFrame, folder: str, checkpoint: str, compression: str = "xz", **trigger):
    """A stream of records (``ordinal, name, seq``) as FASTA files of each batch; by default works off what is there."""
    df.sparkSession.dataSource.register(Fasta)
    stream = fasta_columns(df).writeStream.format("fasta").option("compression", compression).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start(folder)


def fasta_text(df: DataFrame) -> DataFrame:
    """One ``value`` for each record, for the text writer and its codecs."""
    return df.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value"))


def first_record(records: DataFrame) -> tuple[str, str]:
    """Name and sequence of the first record, as for a reference genome; ``ValueError`` if there is none."""
    row = records.orderBy("ordinal").select("name", "seq").first()
    if row is None or not row["seq"]:
        raise ValueError("the reference has no sequence")
    return row["name"], row["seq"]


def read_fasta_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``ordinal, name, seq`` from paths that any Spark file system reads, plain files in splits.

    The same rules as in ``records``: the first ``>`` of a line begins a header, in whatever place.  Files count in the order
    given, those of a folder by name, and splits by their place in the file.  Codecs are Spark's (xz is not among them)."""
    paths = [paths] if isinstance(paths, str) else paths
    raw = None
    for i, path in enumerate(paths):
        part = spark.read.option("lineSep", "\n>").text(path).select("value", F.lit(i).alias("given"), F.input_file_name().alias("file"), F.input_file_block_start().alias("block"))
        raw = part if raw is None else raw.union(part)
    # A chunk goes from one line that begins with > to the next; other lines may hold further headers.
    value = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    chunks = raw.select("given", "file", "block", F.explode(F.split(F.regexp_replace(value, r"\n[^>\n]*>", "\u0001"), "\u0001")).alias("value"))
    lines = F.split("value", "\n")
    seq = F.upper(F.regexp_replace(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.size(lines) - 1)), ""), r"\s", ""))
    found = chunks.select("given", "file", "block", F.trim(F.get(lines, F.lit(0))).alias("name"), seq.alias("seq")).where("seq != ''")
    table = written(found.withColumn("_at", F.monotonically_increasing_id()), "fasta")
    # Records of a split stand together; what is before a split is one number for each.
    splits = table.groupBy("given", "file", "block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    splits = splits.withColumn("_before", F.sum("_n").over(Window.orderBy("given", "file", "block")) - F.col("_n"))
    placed = table.join(F.broadcast(splits.drop("_n")), ["given", "file", "block"])
    return placed.select((F.col("_before") + F.col("_at") - F.col("_first")).cast("long").alias("ordinal"), "name", "seq")
