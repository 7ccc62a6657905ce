"""Token ids of a corpus in compact files, in order of document id, and back.

Layout.  A folder with ``blocks`` and ``codes``, both written by Spark as Parquet, so
that a file appears whole or not at all and lost executors are made good.

* ``codes`` has one row: ``limit`` and ``lengths``, a byte per id with its code length.
* ``blocks`` has a row per block of whole documents: ``part`` and ``block`` order the
  blocks by document id; ``offset`` counts the part's ids before it; ``doc_ids`` are little-endian signed 64-bit numbers, ``counts``
  32-bit numbers of ids, ``checkpoints`` the bit offset of every 128th id, ``bits`` the
  canonical Huffman codes, most significant bit first.

Texts are dealt by ranges of the id before they are encoded, so ids are never
shuffled.  Blocks are independent of each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.huffman import canonical_codes, code_lengths, decode_block, decode_table, encode_block
from corpusmill.llm.landing import new_path
from corpusmill.llm.segments import encoder

END_ID = 2
LIMIT = 16
BLOCK_IDS = 1 << 17

_BLOCK = "part int, block int, offset bigint, n_ids bigint, doc_ids binary, known binary, counts binary"


def _encoded(path: str, end_id: int, block_ids: int):
    """Blocks of plain ids from texts in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([end_id], encode.dtype).tobytes()
        number, offset, keys, ids, counts, size, part = 0, 0, [], [], [], 0, None

        def block() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), encode.dtype).astype("<u4" if encode.dtype.itemsize == 4 else "<u2")
            known = np.array([k is not None for k in keys], np.uint8).tobytes()
            doc_ids = np.array([k or 0 for k in keys], "<i8").tobytes()
            values = [part, number, offset, len(flat), doc_ids, known, np.array(counts, "<u4").tobytes(), flat.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=_names("ids"))

        for batch in batches:
            for part, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
                raw = encode.encode(text) + end
                n = len(raw) // encode.dtype.itemsize
                if keys and size + n > block_ids:
                    yield block()
                    number, offset, keys, ids, counts, size = number + 1, offset + size, [], [], [], 0
                keys.append(key)
                ids.append(raw)
                counts.append(n)
                size += n
        if keys:
            yield block()

    return run


def _names(*more: str) -> list[str]:
    return [part.split()[0] for part in _BLOCK.split(", ")] + list(more)


def _id_width(path: str) -> np.dtype:
    return encoder(path).dtype


def _counted(dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                here = np.bincount(np.frombuffer(raw, dtype))
                if len(here) > len(total):
                    here, total = total, here
                total[: len(here)] += here
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return run


def _packed(dtype: np.dtype, lengths: np.ndarray):
    codes = canonical_codes(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [encode_block(np.frombuffer(raw, dtype), codes, lengths) for raw in batch.column(7).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:7], *(pa.array([b[i] for b in blocks], pa.binary()) for i in (0, 1))],
                names=_names("checkpoints", "bits"),
            )

    return run


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, limit: int = LIMIT, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, end it with ``end_id``, and write the ids in order of ``doc_id``.

    Null and empty texts are the end id alone.  Null ids come first; rows of the same
    id are ordered by text.  Two passes: ids are settled in the shared folder to
    count them over all documents, then coded.  The counts that reach the driver are
    one per id of the vocabulary.
    """
    spark = docs.sparkSession
    dealt = (
        docs.select(F.col("doc_id").cast("bigint"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )
    plain = new_path(spark, "ids")
    dealt.mapInArrow(_encoded(tokenizer, end_id, block_ids), f"{_BLOCK}, ids binary").write.option("compression", "zstd").parquet(plain)
    ids = spark.read.parquet(plain)
    dtype = _id_width(tokenizer)
    counts = ids.select("ids").mapInArrow(_counted(dtype), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(max((row.id for row in counts), default=0) + 1, np.int64)
    for row in counts:
        table[row.id] = row.n
    limit = max(limit, int(np.ceil(np.log2(max(2, len(counts))))) + 1)
    lengths = code_lengths(table, limit)
    ids.mapInArrow(_packed(dtype, lengths), f"{_BLOCK}, checkpoints binary, bits binary").write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    spark.createDataFrame([(limit, bytearray(lengths.tobytes()))], "limit int, lengths binary").coalesce(1).write.parquet(f"{folder}/codes")


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document in the files; ``ids`` are little-endian 32-bit numbers."""
    codes = spark.read.parquet(f"{folder}/codes").first()
    limit, lengths = codes.limit, np.frombuffer(bytes(codes.lengths), np.uint8)
    blocks = spark.read.parquet(f"{folder}/blocks")
    # One total per part, which is a task of the writer.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    part_start = dict(zip((row.part for row in totals), np.concatenate(([0], np.cumsum([row.n for row in totals]))), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths, limit)
        for batch in batches:
            for row in batch.to_pylist():
                flat = decode_block(row["n_ids"], row["checkpoints"], row["bits"], table, limit).astype("<u4")
                counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
                known = np.frombuffer(row["known"], np.uint8)
                ends = np.cumsum(counts)
                raws = [flat[e - n : e].tobytes() for n, e in zip(counts, ends, strict=True)]
                columns = [
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=known == 0),
                    pa.array(ends - counts + row["offset"] + part_start[row["part"]]),
                    pa.array(counts),
                    pa.array([zlib.crc32(raw) for raw in raws], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(raws, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    return blocks.mapInArrow(run, schema)
