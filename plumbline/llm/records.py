"""Operator 2: token ids as length-delimited binary records with an offset index.

A data file ``part-NNNNN.rec`` starts with ``MAGIC`` and one byte, the width of an id (2
where the vocabulary allows it, else 4).  Each record is

    u64 payload length | u32 masked crc of those 8 bytes | payload | u32 masked crc of payload

(little-endian), and the payload is an i64 document id followed by the ids.  A masked crc is
the crc32 rotated right by 15 bits plus a constant, so that a crc over bytes that themselves
hold crcs stays useful.  Beside it ``part-NNNNN.idx`` has 20 bytes a record: i64 document id,
u64 byte offset, u32 number of ids; it serves shuffled reads (:func:`read_at`).

Files are written by the executors straight to the target folder, through any filesystem
that pyarrow opens.  A task writes under a name of its own attempt and renames both files at
the end, and the same task always gets the same rows in the same order, so a task that is
run again after an executor is lost, or twice by speculation, leaves the same bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenizing import CACHE_PARTS, json_encoder, tokenizer_path

MAGIC = b"PLMREC01"
_MASK = 0xA282EAD8
_HEAD, _CRC, _ID, _INDEX = "<Q", "<I", "<q", "<qQI"

_WRITTEN = "part long, name string, n_docs long, n_tokens long"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    head = struct.pack(_HEAD, len(payload))
    return b"".join((head, struct.pack(_CRC, masked_crc(head)), payload, struct.pack(_CRC, masked_crc(payload))))


def open_folder(uri: str):
    """(filesystem, path) of a folder that this process can read and write."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _payload(f, size: int, offset: int) -> bytes:
    head, crc = f.read(8), f.read(4)
    if len(crc) < 4 or struct.unpack(_CRC, crc)[0] != masked_crc(head):
        raise ValueError(f"damaged length at byte {offset}")
    payload, crc = f.read(n := struct.unpack(_HEAD, head)[0]), f.read(4)
    if len(payload) < n or len(crc) < 4 or struct.unpack(_CRC, crc)[0] != masked_crc(payload):
        raise ValueError(f"damaged record at byte {offset}")
    return payload


def _ids(payload: bytes, width: int) -> tuple[int, np.ndarray]:
    return struct.unpack_from(_ID, payload)[0], np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=8).astype("<u4")


def read_file(uri: str, name: str) -> Iterator[tuple[int, np.ndarray]]:
    """(document id, ids) of each record of a data file, in order, checksums verified."""
    filesystem, folder = open_folder(uri)
    with filesystem.open_input_stream(f"{folder}/{name}.rec", buffer_size=1 << 20) as f:
        if f.read(8) != MAGIC:
            raise ValueError(f"{name} isn't a record file")
        width, size, at = f.read(1)[0], filesystem.get_file_info(f"{folder}/{name}.rec").size, 9
        while at < size:
            payload = _payload(f, size, at)
            at += len(payload) + 16
            yield _ids(payload, width)


def read_index(uri: str, name: str) -> np.ndarray:
    filesystem, folder = open_folder(uri)
    with filesystem.open_input_stream(f"{folder}/{name}.idx") as f:
        return np.frombuffer(f.read(), dtype=[("doc_id", "<i8"), ("offset", "<u8"), ("n_tokens", "<u4")])


def read_at(uri: str, name: str, positions) -> Iterator[tuple[int, np.ndarray]]:
    """The records at ``positions`` of a data file, in any order, by its index."""
    index = read_index(uri, name)
    filesystem, folder = open_folder(uri)
    with filesystem.open_input_file(f"{folder}/{name}.rec") as f:
        f.seek(8)
        width = f.read(1)[0]
        for p in positions:
            f.seek(int(index[p]["offset"]))
            yield _ids(_payload(f, 0, int(index[p]["offset"])), width)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, partitions: int | None = None) -> list[tuple[int, str, int, int]]:
    """Encode ``docs(doc_id, text)``, append ``end_id`` to each document, and write record
    files to ``folder`` in ascending ``doc_id`` (then text) over all files.

    Null texts count as empty.  Rows that repeat a ``doc_id`` are kept, each its own record,
    in the order of their texts; a null ``doc_id`` is refused.  An empty table writes no
    file.  Returns (number, name, documents, tokens) of each file in order: like any commit
    protocol the driver gets one small row for each file, never for each document.
    """
    from pyspark import TaskContext

    common.small_batches(docs.sparkSession)
    n = partitions or common.shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.raise_error(F.lit("doc_id is null")).cast("long")))
    path = tokenizer_path(tokenizer)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = json_encoder(path)
        encoder.limit = CACHE_PARTS
        largest = max(encoder.vocab_size - 1, end_id or 0)
        width = 2 if largest < 1 << 16 else 4
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        name, mine = f"part-{part:05d}", f"_{part:05d}-{uuid.uuid4().hex}"
        filesystem, target = open_folder(folder)
        filesystem.create_dir(target, recursive=True)
        docs_, tokens, at, out, index = 0, 0, 9, None, []
        try:
            for batch in batches:
                if out is None:
                    out = filesystem.open_output_stream(f"{target}/{mine}.rec", buffer_size=1 << 20)
                    out.write(MAGIC + bytes([width]))
                for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                    ids = np.frombuffer(encoder.encode(text) + end, "<u4")
                    record = frame(struct.pack(_ID, doc_id) + (ids.astype("<u2") if width == 2 else ids).tobytes())
                    out.write(record)
                    index.append(struct.pack(_INDEX, doc_id, at, len(ids)))
                    at += len(record)
                    docs_ += 1
                    tokens += len(ids)
        finally:
            if out is not None:
                out.close()
        if docs_:
            with filesystem.open_output_stream(f"{target}/{mine}.idx") as f:
                f.write(b"".join(index))
            for kind in ("idx", "rec"):
                filesystem.move(f"{target}/{mine}.{kind}", f"{target}/{name}.{kind}")
            yield pd.DataFrame({"part": [part], "name": [name], "n_docs": [docs_], "n_tokens": [tokens]})

    # an id that very many rows repeat is cut between texts that begin in another way
    ordered = rows.repartitionByRange(n, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return sorted((r.part, r.name, r.n_docs, r.n_tokens) for r in ordered.mapInPandas(write, _WRITTEN).collect())


def read_records(spark: SparkSession, folder: str, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """Read record files back: (doc_id, start, n_tokens, ids_crc32) of each record, where
    ``start`` is the number of ids in all records before it."""
    if not files:
        return spark.createDataFrame([], _ROWS)
    starts, before = [], 0
    for _, name, _, tokens in files:
        starts.append((name, before))
        before += tokens

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start in zip(batch["name"], batch["start"].tolist()):
                rows: list[tuple] = []
                for doc_id, ids in read_file(folder, name):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = []
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one partition a file: a file is the unit of a sequential read
    listed = spark.createDataFrame(spark.sparkContext.parallelize(starts, len(starts)), "name string, start long")
    return listed.mapInPandas(read, _ROWS)


def op2_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, write record files, and return what they hold."""
    folder = common.scratch_path(spark, "records")
    files = write_records(common.read_table(spark, sf_dir, "documents"), folder, "word_bpe_49k.json", end_id=2)
    return read_records(spark, folder, files)
