"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

File format, all numbers little-endian::

    file    = 8 bytes b"TOKREC01", uint32 bytes per id, uint32 0, record*, b"\\n"
    record  = uint64 length, uint32 masked checksum of these 8 bytes,
              payload of that length, uint32 masked checksum of the payload
    payload = int64 doc_id, uint32 1 if doc_id is null, uint32 number of ids, ids

A masked checksum is the CRC-32, rotated right by 15 bits, plus 0xA282EAD8. Spark's own writer
puts down the files, so a lost executor leaves no partial file behind; its text writer ends each
file with one line feed, which readers skip.

Files follow each other by name in ascending doc_id order. Null ids come first, then ties are
ordered by a hash of their text; repeated rows give repeated records. A null text is an empty one
and holds the end id alone. Very long texts are encoded whole: a record may be larger than a file's
usual size. An empty table gives an empty index. Further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mercadia.llm.shared import Tables, prepared
from mercadia.llm.tokens import crc_of_ids, encoder

MAGIC = b"TOKREC01"
HEAD, FRAME, PAYLOAD = "<8sII", "<QI", "<qII"
#: Bytes of records in one file, give or take one record.
FILE_BYTES = 16 << 20

INDEX = (
    "file string, offset long, length long, doc_id long, null_id boolean, n_tokens long, "
    "ids_crc32 long, ids_before long"
)


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def record(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return framed(struct.pack(PAYLOAD, doc_id or 0, doc_id is None, len(ids) // width) + ids)


def parsed(content: bytes) -> Iterator[tuple[int, int, int, bool, np.ndarray]]:
    """Offset, length of the payload, doc_id, null flag and ids of each record; checks them all."""
    magic, width, _ = struct.unpack_from(HEAD, content)
    if magic != MAGIC:
        raise ValueError("not a record file")
    view, at = memoryview(content), struct.calcsize(HEAD)
    while at < len(content) - 1:
        length, check = struct.unpack_from(FRAME, content, at)
        payload = view[at + struct.calcsize(FRAME) : at + struct.calcsize(FRAME) + length]
        (check_payload,) = struct.unpack_from("<I", content, at + struct.calcsize(FRAME) + length)
        if masked(view[at : at + 8]) != check or masked(payload) != check_payload:
            raise ValueError(f"damaged record at byte {at}")
        doc_id, null, n = struct.unpack_from(PAYLOAD, payload)
        yield at, length, doc_id, bool(null), np.frombuffer(payload, f"<u{width}", n, struct.calcsize(PAYLOAD))
        at += struct.calcsize(FRAME) + length + 4


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES) -> None:
    """Encode every whole text and write the files of records."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = int(encode.width[-1])
        end = end_id.to_bytes(width, "little")
        head = struct.pack(HEAD, MAGIC, width, 0)
        parts, size = [head], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.append(record(doc_id, encode.encode(text or "") + end, width))
                size += len(parts[-1])
                if size >= file_bytes:
                    yield pa.record_batch([pa.array([b"".join(parts)], pa.binary())], ["content"])
                    parts, size = [head], 0
        if size:
            yield pa.record_batch([pa.array([b"".join(parts)], pa.binary())], ["content"])

    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
        .select("doc_id", "text")
    )
    (
        ordered.mapInArrow(files, "content binary")
        .select(F.col("content").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .text(folder)
    )


def read_index(docs_folder: DataFrame) -> DataFrame:
    """One row per record of the files read with `record_files`, every checksum verified."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in INDEX.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, before = [], 0
                for offset, length, doc_id, null, ids in parsed(content.as_py()):
                    found.append((path, offset, length, None if null else doc_id, null, len(ids), crc_of_ids(ids), before))
                    before += len(ids)
                if found:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), TYPES)], names)

    return docs_folder.mapInArrow(rows, INDEX)


TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())


def record_files(spark, folder: str) -> DataFrame:
    """The files and their order: the range partition, then the count within the task."""
    files = spark.read.format("binaryFile").load(f"{folder}/part-*").select("path", "content")
    return files.withColumn("path", F.regexp_extract("path", r"[^/]+$", 0))


def file_order(path: Column) -> list[Column]:
    return [
        F.regexp_extract(path, r"part-(\d+)", 1).cast("long"),
        F.regexp_extract(path, r"-c(\d+)\.", 1).cast("long"),
    ]


def encode_to_records(
    docs: DataFrame, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES, destination: str | None = None
) -> tuple[str, DataFrame]:
    """Write records and their index; returns the folder of files and the stored index.

    They go to `records` and `index` in `destination`, a new folder; without one, to the shared folder.

    The index has a row per record: file, byte offset and length of its payload, doc_id, number
    of ids, their CRC-32 as 32-bit integers, and `start`, the ids of all records before it.
    """
    spark = prepared(docs.sparkSession)
    tables = Tables(spark, "records")
    folder = f"{destination}/records" if destination else tables.path()
    write_records(docs, folder, tokenizer, end_id, file_bytes)
    if not spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path").take(1):
        empty = spark.createDataFrame([], INDEX).withColumn("start", F.col("ids_before")).drop("ids_before")
        if destination:
            empty.write.parquet(f"{destination}/index")
        return folder, empty
    found = tables.stored(read_index(record_files(spark, folder)))
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    # A row for each file of many megabytes: the only part in one task.
    before = Window.orderBy(*file_order(F.col("file"))).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("base"))
    index = found.join(bases, "file").withColumn("start", F.col("base") + F.col("ids_before")).drop("base", "ids_before")
    if destination:
        index.write.parquet(f"{destination}/index")
        return folder, spark.read.schema(index.schema).parquet(f"{destination}/index")
    return folder, tables.stored(index)


def shuffled_records(index: DataFrame, folder: str, seed: int) -> DataFrame:
    """Records in an order drawn by the seed, read by their offsets: place, doc_id, ids."""
    spark = index.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.to_pydict()
            for content, spans in zip(data["content"], data["spans"]):
                width = struct.unpack_from(HEAD, content)[1]
                out = []
                for span in spans:
                    at = span["offset"] + struct.calcsize(FRAME)
                    payload = content[at : at + span["length"]]
                    _, _, n = struct.unpack_from(PAYLOAD, payload)
                    ids = np.frombuffer(payload, f"<u{width}", n, struct.calcsize(PAYLOAD))
                    out.append((span["place"], span["doc_id"], ids.astype(np.int64).tolist()))
                places, doc_ids, ids = zip(*out)
                yield pa.record_batch(
                    [pa.array(places, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int64()))],
                    ["place", "doc_id", "ids"],
                )

    place = F.xxhash64(F.lit(seed), "file", "offset").alias("place")
    # Spans of one file: bounded by the size of a file.
    spans = index.groupBy("file").agg(F.collect_list(F.struct("offset", "length", "doc_id", place)).alias("spans"))
    files = record_files(spark, folder).withColumnRenamed("path", "file")
    read = files.join(spans, "file").select("content", "spans")
    return read.mapInArrow(cut, "place long, doc_id long, ids array<long>").sort("place")
