"""Token ids in files of fixed-width bit-packed blocks.

A folder holds ``blocks`` and ``manifest``, both Parquet. Documents lie in ascending
order of their ids, over files and inside them. A block is a run of whole documents,
closed by the one that brings it to ``block_ids`` ids; its ids follow each other in
``bits`` bits each, the fewest that the vocabulary needs, as one little-endian stream
of bits (64 ids are ``bits`` words of 64 bits). So id ``i`` of a block begins at bit
``i * bits``, any range of ids is unpacked without what stands before it, and ``first``
says how many ids of its file come before a block. The manifest says how many come
before a file. It is written last: a folder without it is not finished.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import released, small_batches
from ledgerloom.llm.packing import text_ids

BLOCK = "part int, block int, first long, n_ids long, bits int, least {id}, most {id}, doc_id array<{id}>, doc_tokens array<long>, data binary"
LANES = 64


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, 1 to 32; the last byte is filled up with zeros."""
    groups = -(-len(ids) // LANES)
    lanes = np.zeros(groups * LANES, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(groups, LANES)
    words = np.zeros((groups, bits), np.uint64)
    for lane in range(LANES):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()[: -(-len(ids) * bits // 8)]


def unpack_bits(data: bytes, bits: int, count: int, start: int = 0) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of :func:`pack_bits`, as little-endian unsigned 32-bit integers; only their groups are read."""
    low, high = start // LANES, -(-(start + count) // LANES)
    part = data[8 * bits * low : 8 * bits * high]
    words = np.zeros((high - low, bits), "<u8")
    words.view(np.uint8).reshape(-1)[: len(part)] = np.frombuffer(part, np.uint8)
    lanes = np.empty((high - low, LANES), np.uint64)
    for lane in range(LANES):
        word, shift = divmod(lane * bits, 64)
        lanes[:, lane] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lanes[:, lane] |= words[:, word + 1] << np.uint64(64 - shift)
    ids = (lanes & np.uint64((1 << bits) - 1)).reshape(-1)
    return ids[start - low * LANES :][:count].astype("<u4")


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, block_ids: int = 65_536, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode ``docs`` and write them under ``path``, which must not exist; returns ``path``.

    Null or empty text gives ``end_id`` alone. A null id comes first. Rows of one id stand
    in the order of their texts' hashes; repeated rows are written each for itself, and
    a group of rows of one id and text may fill a file of its own. Texts of any length
    are encoded whole; a block is as long as ``block_ids`` and its last document together.
    An empty table gives files without blocks. Other columns are not read.

    Texts are dealt once, by ranges of ids, and encoded where they are written.
    ``files`` is the number of files; without it Spark's settings decide, and its
    adaptive planning joins small neighbours.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at, first = text_ids(tokenizer_path, end_id), TaskContext.get().partitionId(), 0, 0
        bits = encode.bits
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32())])

        def block(ids: pa.Array, n: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            head = [pa.array([v], f.type) for v, f in zip((part, at, first, len(values), bits), schema, strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), column) for column in (ids, pa.array(n))]
            ends = [ids.slice(0, 1), ids.slice(len(ids) - 1, 1)]
            data = pa.array([pack_bits(values, bits)], pa.binary())
            return pa.RecordBatch.from_arrays([*head, *ends, *lists, data], names=[*schema.names, "least", "most", "doc_id", "doc_tokens", "data"])

        waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            values, n = encode(batch.column(1))
            waiting.append((batch.column(0), n, values))
            held += len(values)
            if held < block_ids:
                continue
            ids, n, values = pa.concat_arrays([w[0] for w in waiting]), *(np.concatenate([w[k] for w in waiting]) for k in (1, 2))
            ends, low = np.cumsum(n), 0
            while True:
                begun = ends[low - 1] if low else 0
                high = int(np.searchsorted(ends, begun + block_ids)) + 1
                if high > len(n):
                    break
                yield block(ids.slice(low, high - low), n[low:high], values[begun : ends[high - 1]])
                at, first, low = at + 1, first + int(ends[high - 1] - begun), high
            waiting, held = [(ids.slice(low), n[low:], values[begun:])], len(values) - int(begun)
        if waiting and len(waiting[0][1]) + held:
            yield block(pa.concat_arrays([w[0] for w in waiting]), *(np.concatenate([w[k] for w in waiting]) for k in (1, 2)))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.spark_partition_id()]
    rows = rows.withColumns({"mark": order[1], "origin": order[2]})
    rows = rows.repartitionByRange(files, "doc_id", "mark", "origin") if files else rows.repartitionByRange("doc_id", "mark", "origin")
    rows.sortWithinPartitions("doc_id", "mark").select("doc_id", "text").mapInArrow(released(blocks), BLOCK.format(id=kind)).write.parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"), F.sum(F.size("doc_id")).alias("n_docs"))
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes.withColumn("base", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/manifest")
    return path


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ``ids`` (little-endian unsigned 32-bit) of every document written under ``path``.

    ``start`` is the number of ids of all documents before it, ``ids_crc32`` the unsigned
    CRC-32 of ``ids``. One pass over the blocks; only the manifest, a row a file, is joined.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    small_batches(spark)
    kind = blocks.schema["least"].dataType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, first, bits, n_ids = (batch.column(c)[k].as_py() for c in range(4))
                ids, n = batch.column(4)[k].values, np.asarray(batch.column(5)[k].values)
                values = unpack_bits(batch.column(6)[k].as_py(), bits, n_ids).tobytes()
                ends = np.cumsum(n)
                parts = [values[4 * (e - m) : 4 * e] for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                crc = pa.array(np.array([zlib.crc32(p) for p in parts], np.int64))
                columns = [pa.array(np.full(len(n), part, np.int32)), ids, pa.array(first + ends - n), pa.array(n), crc]
                columns += [pa.array(parts, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    shape = f"part int, doc_id {kind}, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    found = blocks.select("part", "first", "bits", "n_ids", "doc_id", "doc_tokens", "data").mapInArrow(released(documents), shape)
    base = spark.read.parquet(f"{path}/manifest").select("part", "base")
    out = found.join(base, "part").withColumn("start", F.col("base") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_range(spark: SparkSession, path: str, start: int, count: int) -> DataFrame:
    """(start, ids): ids ``start`` to ``start + count`` of all that was written, as an array per block that holds some of them.

    Random access: the manifest picks the files and ``first`` the blocks, both before any
    block is read, and only the 64-id groups in the range are unpacked. What lies
    beyond the last id isn't returned.
    """
    stop = start + count
    near = spark.read.parquet(f"{path}/manifest").where((F.col("base") < stop) & (F.col("base") + F.col("n_ids") > start)).select("part", "base")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, n_ids, bits = (batch.column(c)[k].as_py() for c in range(3))
                low, high = max(start - at, 0), min(stop - at, n_ids)
                ids = unpack_bits(batch.column(3)[k].as_py(), bits, high - low, low).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([at + low]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))], names=["start", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks").join(near, "part").withColumn("at", F.col("base") + F.col("first"))
    return blocks.where((F.col("at") < stop) & (F.col("at") + F.col("n_ids") > start)).select("at", "n_ids", "bits", "data").mapInArrow(cut, "start long, ids array<bigint>")
