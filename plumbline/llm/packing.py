"""Operator 6: bounded-space best-fit packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenizing import CACHE_PARTS, json_encoder, tokenizer_path

#: Bins that a packer keeps open.
OPEN_BINS = 2048
#: Pieces that one packer gets: its last open bins are the only loss against one packer for all.
PIECES_A_PACKER = 200_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Online best fit with at most ``open_bins`` open bins of ``capacity``.

    ``bits`` has bit f set if some open bin has f free; ``bins[f]`` lists those bins.  The
    tightest bin for a piece is the lowest set bit at or above its length.  When a new bin is
    needed and all are open, the fullest one (the lowest set bit) is closed first.
    """

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.bins, self.n_open, self.made = 0, {}, 0, 0

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        b = stack.pop()
        if not stack:
            del self.bins[free]
            self.bits ^= 1 << free
        self.n_open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of ``length``, from 1 to the capacity."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            b = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            b, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.bins.setdefault(left, []).append(b)
            self.bits |= 1 << left
            self.n_open += 1
        return b, self.capacity - free


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, cache: int = CACHE_PARTS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document: its ids and ``end_id``,
    cut into pieces of ``capacity`` only where they are more.  Null texts count as empty, a null or
    repeated doc_id is passed on as it is, and columns of other names take no part.
    ``cache`` is the number of encoded words that a Python worker keeps: memory against time."""
    common.small_batches(docs.sparkSession)
    path = tokenizer_path(tokenizer)
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = json_encoder(path)
        encoder.limit = cache
        for batch in batches:
            rows = []
            for i, text in enumerate(batch["text"].to_pylist()):
                ids = encoder.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            at, *values = zip(*rows) if rows else [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int64())), *map(pa.array, values, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        common.release_memory()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, _PIECES)


def pack(lengths: DataFrame, capacity: int = 4096, open_bins: int = OPEN_BINS, pieces_a_packer: int = PIECES_A_PACKER) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``doc_id``, ``piece`` and ``length``.

    The pieces are dealt by hash over packers of about ``pieces_a_packer`` each, so no key
    is hot, and a packer takes them in the order of that hash: the same pieces go to the same
    places whenever a task is run again.  Only lengths are moved, never ids.  Rows with a
    length outside 1 to ``capacity`` are an error.  An empty table gives an empty one.
    """
    spark = lengths.sparkSession
    packers = max(1, round(lengths.count() / pieces_a_packer))
    schema = lengths.schema.add("sequence_id", "long", False).add("offset", "long", False)
    spread = F.xxhash64("doc_id", "piece", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, packer = TaskContext.get().partitionId() << 40, BestFit(capacity, open_bins)
        for batch in batches:
            lengths_ = batch["length"].to_pylist()
            if lengths_ and not 1 <= min(lengths_) <= max(lengths_) <= capacity:
                raise ValueError(f"piece lengths must be from 1 to {capacity}")
            placed = [packer.place(n) for n in lengths_]
            new = [pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "sequence_id", "offset"])

    dealt = lengths.repartition(packers, spread).sortWithinPartitions(spread, "doc_id", "piece")
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1, cache: int = CACHE_PARTS) -> DataFrame:
    """Tokenize, cut and pack ``docs(doc_id, text)``.  The lengths are written to a table
    first, so that losing an executor never tokenizes again."""
    return pack(common.materialize(pieces(docs, tokenizer, capacity, end_id, cache), "pieces"), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.read_table(spark, sf_dir, "documents"))
