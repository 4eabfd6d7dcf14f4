"""Packing token pieces into sequences of fixed length: best fit first, then a local search by swaps."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.bpe import encoder
from evigraph.llm.shared import texts, write_table

SHARD_PIECES = 8_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int | None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each document's ids (and the end id) into pieces of `size`; only the last piece may be shorter.

    Every row is one document; null and empty texts give the end id alone, or no piece without one.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, tail = encoder(tokenizer), np.array([] if end_id is None else [end_id], dtype="<u4")
        for batch in batches:
            rows: list[tuple] = []
            coded = tool.encode_many(text.as_py() for text in batch.column("text"))
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                ids = np.concatenate([own.astype("<u4"), tail])
                for k, at in enumerate(range(0, len(ids), size)):
                    raw = ids[at : at + size].tobytes()
                    rows.append((doc_id, k, at, len(raw) // 4, zlib.crc32(raw), raw if with_ids else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return texts(docs, id_col, text_col).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Longest pieces first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for k in np.lexsort((np.arange(len(lengths)), -lengths)):
        length = int(lengths[k])
        at = bisect_left(free, (length, -1))
        if at == len(free):
            bins.append([])
            left, target = size, len(bins) - 1
        else:
            left, target = free.pop(at)
        bins[target].append(int(k))
        if left > length:
            insort(free, (left - length, target))
    return bins


def swap_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Move pieces between underfull bins while the sum of squared fills grows; emptied bins disappear.

    One step looks at one bin, emptiest first, against all other underfull bins at once: move a piece or two, exchange one for
    a shorter one, or exchange two for one, and takes the change that gains most. It ends where no bin has a change that
    gains, or at the least number of bins that the sum of the lengths allows.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    where = np.empty(len(lengths), dtype=np.int64)
    for k, own in enumerate(bins):
        where[own] = k
    fill = np.bincount(where, lengths, len(bins)).astype(np.int64)
    least = -(-int(lengths.sum()) // size)
    stuck = np.zeros(len(bins), dtype=bool)
    while np.count_nonzero(fill) > least:
        under = (fill > 0) & (fill < size)
        if not (under & ~stuck).any():
            break
        source = int(np.argmin(np.where(under & ~stuck, fill, size)))
        own = np.flatnonzero(where == source)
        # Equal lengths are alike, so there are fewer weights of one or two pieces than tokens in a bin.
        i, j = np.triu_indices(len(own := own[_first_two(lengths[own])]), 1)
        weight = np.concatenate([lengths[own], lengths[own[i]] + lengths[own[j]]])
        given = np.concatenate([np.stack([own, np.full(len(own), -1)], axis=1), np.stack([own[i], own[j]], axis=1)])
        weight, one = np.unique(weight, return_index=True)
        given = given[one]
        best: tuple = (0, None, None, None)
        under[source] = False
        others = np.flatnonzero(under)
        others = others[np.argsort(fill[others], kind="stable")]
        fits = np.searchsorted(fill[others], size - weight, side="right") - 1
        if len(others):
            target = others[np.maximum(fits, 0)]
            gains = np.where(fits >= 0, 2 * weight * (fill[target] - fill[source] + weight), 0)
            if gains[at := int(np.argmax(gains))] > 0:
                best = (gains[at], given[at], int(target[at]), None)
        items = np.flatnonzero(under[where])
        room, lead = size - fill[where[items]], fill[where[items]] - fill[source]
        for at in range(0, len(weight) if len(items) else 0, 64):
            shift = weight[at : at + 64, None] - lengths[items]
            gains = np.where((shift > 0) & (shift <= room), 2 * shift * (lead + shift), 0)
            row, column = np.unravel_index(int(np.argmax(gains)), gains.shape)
            if gains[row, column] > best[0]:
                best = (gains[row, column], given[at + row], int(where[items[column]]), int(items[column]))
        if best[1] is None:
            stuck[source] = True
            continue
        _, moved, target, taken = best
        where[moved[moved >= 0]] = target
        if taken is not None:
            where[taken] = source
        for k in (source, target):
            fill[k] = lengths[where == k].sum()
        stuck[:] = False
    order = np.argsort(where, kind="stable")
    return [part.tolist() for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(part)]


def _first_two(values: np.ndarray) -> np.ndarray:
    """Places of the first two of each value."""
    order = np.argsort(values, kind="stable")
    same = values[order][2:] == values[order][:-2]
    return order[np.concatenate([np.ones(min(2, len(order)), dtype=bool), ~same])]


def _pack_shard(size: int):
    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = shard["length"].to_numpy(np.int64)
        bins = swap_search(best_fit(lengths, size), lengths, size)
        order = np.concatenate(bins)
        local = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        out = shard.iloc[order].copy()
        ends = out["length"].to_numpy().cumsum()
        firsts = np.concatenate([[True], local[1:] != local[:-1]])
        base = np.maximum.accumulate(np.where(firsts, ends - out["length"].to_numpy(), 0))
        out["bin"], out["offset"] = local, ends - out["length"].to_numpy() - base
        out["fill"] = np.bincount(local, out["length"]).astype(np.int64)[local]
        return out

    return pack


def pack_pieces(pieces: DataFrame, size: int) -> DataFrame:
    """Give every piece (doc_id, piece, length and further columns) a sequence_id and a gapless offset.

    Full pieces are sequences of their own. The rest is dealt into shards of about SHARD_PIECES by hash and packed shard by
    shard; the pieces of underfull bins are dealt and packed again until that saves no bin, they have the least number of
    bins, or one shard holds them. Shards are equal in size whatever the data, no shard grows with the input, and every
    piece is placed. An empty input gives no row.
    """
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = pieces.select(*keys)
    row = F.monotonically_increasing_id()
    full = pieces.where(F.col("length") == size).withColumn("offset", F.lit(0).cast("long")).withColumn("sequence_id", row * 2 + 1)
    packed = full.select(*keys, "offset", "sequence_id")
    open_pieces = pieces.where(F.col("length") < size)
    schema = f"{', '.join(f'{n} {t}' for n, t in pieces.dtypes)}, shard bigint, bin bigint, offset bigint, fill bigint"
    rest, known, step = None, math.inf, 0
    while n := open_pieces.count():
        shards = math.ceil(n / SHARD_PIECES)
        dealt = open_pieces.withColumn("shard", F.pmod(F.xxhash64(row, *keys), F.lit(shards)))
        bins = write_table(dealt.groupBy("shard").applyInPandas(_pack_shard(size), schema), "packed")
        number = ((F.shiftleft(F.lit(step).cast("long"), 47) + F.shiftleft("shard", 20) + F.col("bin")) * 2).alias("sequence_id")
        bins = bins.select(*keys, "offset", number, "fill")
        # A bin has one row at offset 0, as no piece is empty.
        under = bins.where(F.col("fill") < size - size // 256)
        count = lambda rows: rows.agg(F.count_if(F.col("offset") == 0).alias("bins"), F.sum("length").alias("tokens")).first()
        if rest is not None and count(bins).bins >= known:
            break
        left = count(under)
        if shards == 1 or left.bins <= math.ceil((left.tokens or 0) / size):
            rest = bins
            break
        packed = packed.unionByName(bins.where(F.col("fill") >= size - size // 256).drop("fill"))
        rest, known, step = under, left.bins, step + 1
        open_pieces = under.select(*keys)
    return packed if rest is None else packed.unionByName(rest.drop("fill"))


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", size: int = 2048, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    pieces = token_pieces(docs, tokenizer, size, end_id, with_ids=False).drop("ids")
    return pack_pieces(write_table(pieces, "pieces"), size)
