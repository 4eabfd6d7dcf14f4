"""Token ids in binary files: ids ranked by frequency, stored in one to four bytes with separate control bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.llm.bpe import encoder
from evigraph.llm.shared import shared_folder, texts

BLOCK_TOKENS = 1 << 20
BLOCK = (
    "part int, block int, doc_ids array<bigint>, lengths array<int>, n_tokens bigint, ranks binary, control binary, data binary"
)

# Sizes of the four values that a control byte describes, two bits each from the lowest.
SIZES = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ids by falling frequency, control bytes, data bytes) of one block; equal counts rank by id."""
    counts = np.bincount(ids)  # as long as the largest id, a vocabulary
    used = np.flatnonzero(counts)
    used = used[np.lexsort((used, -counts[used]))]
    rank_of = np.zeros(len(counts), dtype="<u4")
    rank_of[used] = np.arange(len(used))
    values = rank_of[ids]
    extra = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return used.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def unpack(ranks: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids of a block, by table lookups: control byte to sizes, sizes to byte places, rank to id."""
    sizes = SIZES[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(sizes)
    raw = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8)
    starts = ends - sizes
    values = np.zeros(n, dtype=np.uint32)
    for k in range(int(sizes.max(initial=0))):
        values |= np.where(sizes > k, raw[starts + k].astype(np.uint32) << np.uint32(8 * k), np.uint32(0))
    return np.frombuffer(ranks, dtype="<u4")[values]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write them as blocks in ascending id order.

    Every row is one document, repeated ids included (they follow each other, ordered by text). A null or empty text
    has no ids but the end id; an empty table gives no block. A block is closed at BLOCK_TOKENS ids; a longer document
    has a block of its own. Each block carries its own rank table, so tasks share no state and can be repeated.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, block = encoder(tokenizer), TaskContext.get().partitionId(), 0
        names, pieces, size = [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(pieces)
            ranks, control, data = pack(ids)
            row = {
                "part": [part], "block": [block], "doc_ids": [names], "lengths": [[len(x) for x in pieces]], "n_tokens": [len(ids)],
                "ranks": [ranks], "control": [control], "data": [data],
            }
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([
                ("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
                ("n_tokens", pa.int64()), ("ranks", pa.binary()), ("control", pa.binary()), ("data", pa.binary()),
            ]))

        tail = np.array([] if end_id is None else [end_id], dtype="<u4")
        for batch in batches:
            coded = tool.encode_many(text.as_py() for text in batch.column("text"))
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                ids = np.concatenate([own.astype("<u4"), tail])
                if pieces and size + len(ids) > BLOCK_TOKENS:
                    yield close()
                    names, pieces, size, block = [], [], 0, block + 1
                names.append(doc_id)
                pieces.append(ids)
                size += len(ids)
        if pieces:
            yield close()

    ordered = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, BLOCK).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked
    for, ids (little-endian unsigned 32-bit). Places inside a block come from the block, those of blocks from sums."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["ranks"], row["control"], row["data"], row["n_tokens"])
                ends = np.cumsum(row["lengths"], dtype=np.int64)
                each = np.split(ids, ends[:-1])
                columns = {
                    "part": [row["part"]] * len(each), "block": [row["block"]] * len(each), "doc_id": row["doc_ids"],
                    "n_tokens": row["lengths"], "before": (ends - row["lengths"]).tolist(),
                    "ids_crc32": [zlib.crc32(x.tobytes()) for x in each],
                    "ids": [x.tobytes() if with_ids else None for x in each],
                }
                yield pa.RecordBatch.from_pydict(columns, schema=pa.schema([
                    ("part", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                    ("before", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()),
                ]))

    blocks = spark.read.schema(BLOCK).parquet(path)
    heads = blocks.select("part", "block", "n_tokens")
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file part
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = heads.withColumn("block_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("n_tokens")
    starts = starts.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("block_start"))
    decoded = blocks.mapInArrow(decode, "part int, block int, doc_id bigint, n_tokens bigint, before bigint, ids_crc32 bigint, ids binary")
    found = decoded.join(starts, ["part", "block"])
    columns = ["doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"]
    return found.select(*columns, *(["ids"] if with_ids else []))


def token_digest(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Write the documents' ids to a new shared folder and read their places and checksums back from the files."""
    path = shared_folder(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path, with_ids=False)
