"""Near-duplicate join of word-shingle sets: size-banded tiles, hashed bitmaps that bound overlap, exact intersection.

Two sets with Jaccard similarity of at least 3/4 share one of the first |s| - ceil(3|s|/4) + 1 shingles of either, in any
order common to all sets; frequent shingles come last in ours. At the first that two similar sets share, the rest of
either is at least as long as the overlap they need, which bounds its position. Where few sets share a shingle they are
paired at once. The others form tiles of one shingle and one band of sizes, which hold the sets of the band (residents) and
of the next (visitors): similar sets are in the same or in neighbouring bands. In a tile all sets meet three residents
first, the links found there join sets to components, and only then are different components compared, in blocks, by bitmaps.
Candidates that the bitmaps admit are verified on the sorted sets, best first, until no admitted pair joins two components.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.llm.shared import texts, write_table

WORDS = 5
CHUNK = 1 << 20
HOT_LOCAL, HOT_SETS, HOT_KEPT = 3, 64, 200_000
BROADCAST_IDS = 1_000_000
BAND = math.log(1.34)  # a little over 4/3, so that rounding can't move two similar sets two bands apart
LEADERS = 3
FEW = 16
MORE = 64
BLOCK = 512
SALTS = 64
TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACES = re.compile(rb"[\x20\x09-\x0D]")
_random = np.random.default_rng(20240229)
BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
WORD_VALUE = _random.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        tables = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the text with A-Z in lower case, in order."""
    data = text.encode("utf-8", "surrogatepass").translate(TO_LOWER)
    parts, at = [], 0
    while at < len(data):
        cut = SPACES.search(data, at + CHUNK)
        end = cut.start() if cut else len(data)
        raw = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        word = ~IS_SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], word.view(np.int8), [0]])))
        starts, ends = edge[::2], edge[1::2]
        up, down = _power_tables(len(raw))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUE[raw] * up[: len(raw)])])
        parts.append(_mix((sums[ends] - sums[starts]) * down[starts]))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; all words as one if there are fewer; none without words."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    total = np.full(n, min(len(h), words), dtype=np.uint64)
    for k in range(min(words, len(h))):
        total = _mix(total) + h[k : k + n] * WORD_VALUE[k % WORDS] if k else total + h[:n] * WORD_VALUE[0]
    return np.unique(_mix(total))


def node_of(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def bitmap(found: np.ndarray) -> bytes:
    """Two to four bits for each shingle; a power of two, so that longer bitmaps fold to shorter ones."""
    width = max(64, 1 << int(2 * len(found) - 1).bit_length())
    bits = np.zeros(width, dtype=bool)
    bits[(found & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    while len(bits) > width:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (doc_id, n, node, bits), and of shingles with their number of sets in this task (key, uses)."""
    for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
        ids, sizes, nodes, maps, seen, found_here = batch.column("doc_id").to_pylist(), [], [], [], set(), []
        for text in batch.column("text"):
            found = shingles(text.as_py())
            node = node_of(found)
            sizes.append(len(found))
            nodes.append(node)
            maps.append(bitmap(found) if len(found) else b"")
            if node not in seen:
                seen.add(node)
                found_here.append(found)
        key, uses = np.unique(np.concatenate(found_here), return_counts=True) if found_here else (np.empty(0, np.uint64), np.empty(0, np.int64))
        key, uses = key[uses >= HOT_LOCAL].view(np.int64), uses[uses >= HOT_LOCAL]
        n, m = len(ids), len(key)
        yield pa.RecordBatch.from_arrays([
            pa.array([*ids, *[None] * m], pa.int64()), pa.array([*sizes, *[None] * m], pa.int32()), pa.array([*nodes, *[None] * m], pa.binary()),
            pa.array([*maps, *[None] * m], pa.binary()), pa.array([*[None] * n, *key.tolist()], pa.int64()), pa.array([*[None] * n, *uses.tolist()], pa.int64()),
        ], ["doc_id", "n", "node", "bits", "key", "uses"])


PREFIX = "key bigint, salt int, a bigint, b bigint, n int, pos int"


def _prefixes(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """The shingles of the sets' prefixes: key, set (its 16 bytes as a and b), size and position; salt is 0 but for hot keys.

    Equal sets of one task count once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # HOT_KEPT hashes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        frequent = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                keys, salts, nodes, sizes, places = [], [], [], [], []
                for text in batch.column("text").slice(at, 512):
                    found = shingles(text.as_py())
                    node = node_of(found)
                    if not len(found) or node in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(node)
                    size = len(found)
                    take = size - (3 * size + 3) // 4 + 1
                    n_cold = size
                    if len(frequent):
                        is_hot = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found
                        n_cold = size - int(np.count_nonzero(is_hot))
                        found = np.concatenate([found[~is_hot], found[is_hot]])
                    keys.append(found[:take])
                    nodes.append(np.frombuffer(node, dtype=">i8").astype(np.int64).repeat(take).reshape(2, take))
                    sizes.append(np.full(take, size))
                    places.append(np.arange(take))
                    salts.append(np.where(places[-1] < n_cold, 0, 1 + node[0] % SALTS))
                if keys:
                    both = np.concatenate(nodes, axis=1)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(salts), pa.int32()), pa.array(both[0]), pa.array(both[1]),
                        pa.array(np.concatenate(sizes), pa.int32()), pa.array(np.concatenate(places), pa.int32()),
                    ], [x.split()[0] for x in PREFIX.split(", ")])

    return docs.mapInArrow(cut, PREFIX)


def _possible(nx: np.ndarray, ny: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Sizes that can reach 3/4, and positions after which either set still holds the overlap they need."""
    need = (3 * (nx + ny) + 6) // 7
    return (4 * np.minimum(nx, ny) >= 3 * np.maximum(nx, ny)) & (nx - px >= need) & (ny - py >= need)


def _meetings(prefixes: DataFrame) -> DataFrame:
    """Pairs (x, y) of sets that share a rare shingle, and members (key, n, pos, x) of the tiles that have more than FEW.

    The rows of a hot key are spread by salt and pass as members; the rows of any other key come together in order.
    """

    def as_bytes(a: np.ndarray, b: np.ndarray) -> list[bytes]:
        raw = np.stack([a, b], axis=1).astype(">i8").tobytes()
        return [raw[k : k + 16] for k in range(0, len(raw), 16)]

    def members(rows: np.ndarray) -> pa.RecordBatch:
        m = len(rows)
        return pa.RecordBatch.from_arrays([
            pa.array(rows[:, 0]), pa.array(rows[:, 4], pa.int32()), pa.array(rows[:, 5], pa.int32()), pa.array(as_bytes(rows[:, 2], rows[:, 3]), pa.binary()),
            pa.nulls(m, pa.binary()),
        ], ["key", "n", "pos", "x", "y"])

    def pairs(i: np.ndarray, j: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The possible ones of the row pairs i, j as (a, b) of the smaller and of the larger set."""
        x, y = rows[i], rows[j]
        ok = _possible(x[:, 4], y[:, 4], x[:, 5], y[:, 5]) & ((x[:, 2] != y[:, 2]) | (x[:, 3] != y[:, 3]))
        x, y = x[ok][:, 2:4], y[ok][:, 2:4]
        u, v = x.view(np.uint64), y.view(np.uint64)
        swap = (u[:, 0] > v[:, 0]) | ((u[:, 0] == v[:, 0]) & (u[:, 1] > v[:, 1]))
        return np.concatenate([np.where(swap[:, None], y, x), np.where(swap[:, None], x, y)], axis=1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 6), dtype=np.int64)

        def handle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.diff(rows[:, 0])) + 1
            starts = np.concatenate([[0], edge])
            sizes = np.diff(np.concatenate([starts, [len(rows)]]))
            two = starts[sizes == 2]
            found, crowded = [pairs(two, two + 1, rows)], []
            for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                run = rows[at : at + size]
                run = run[np.unique(run[:, 2:4], axis=0, return_index=True)[1]] if size <= 64 else run[np.unique(np.ascontiguousarray(run[:, 2:4]).view("V16"), return_index=True)[1]]
                if len(run) > FEW:
                    crowded.append(run)
                elif len(run) > 1:
                    i, j = np.triu_indices(len(run), 1)
                    found.append(pairs(i, j, run))
            if crowded:
                yield members(np.concatenate(crowded))
            both = np.unique(np.concatenate(found), axis=0)
            if len(both):
                m = len(both)
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.array(as_bytes(both[:, 0], both[:, 1]), pa.binary()),
                    pa.array(as_bytes(both[:, 2], both[:, 3]), pa.binary()),
                ], ["key", "n", "pos", "x", "y"])

        for batch in batches:
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            hot = rows[:, 1] > 0
            if hot.any():
                yield members(rows[hot])
                rows = rows[~hot]
            rest = np.concatenate([rest, rows])
            if len(rest) > 100_000:
                last = int(np.searchsorted(rest[:, 0], rest[-1, 0]))
                if last:
                    yield from handle(rest[:last])
                    rest = rest[last:]
        if len(rest):
            yield from handle(rest)

    dealt = prefixes.repartition("key", "salt").sortWithinPartitions("key")
    return dealt.mapInArrow(meet, "key bigint, n int, pos int, x binary, y binary")


def _tiles(members: DataFrame) -> DataFrame:
    """Each set as a resident of its band's tile and as a visitor of the tile of the band below."""
    band = F.floor(F.log("n") / BAND).cast("int")
    place = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("resident")), F.struct((band - 1).alias("band"), F.lit(False).alias("resident"))))
    return members.select("key", "n", "pos", "node", place.alias("place")).select("key", "place.band", "place.resident", "n", "pos", "node")


def _admit(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y and gain (an upper bound of their similarity) of the pairs whose bitmaps don't rule out 3/4."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gains = []
            for a, b, na, nb in zip(*(batch.column(c).to_pylist() for c in ("bits_x", "bits_y", "n_x", "n_y")), strict=True):
                gains.append(_upper(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), na, nb))
            keep = pa.array([g >= 0.75 for g in gains], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(gains, pa.float64())], ["x", "y", "gain"]).filter(keep)

    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").where("4 * least(n_x, n_y) >= 3 * greatest(n_x, n_y)")
    return both.mapInArrow(bound, "x binary, y binary, gain double")


def _upper(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> float:
    """Each bit of one bitmap that the other lacks is a shingle that the other lacks."""
    width = min(len(a), len(b))
    a, b = fold(a, width), fold(b, width)
    overlap = min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))
    return overlap / (na + nb - overlap)


def _texts_of(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and one text of each set; texts are shorter than their shingles."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                if (node := node_of(shingles(text))) not in seen:
                    seen.add(node)
                    rows.append((node, text))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "text"])

    wanted = write_table(sets.join(nodes, "node").select(F.col("rep").alias("wanted")).distinct(), "wanted")
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    chosen = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["wanted"]), "left_semi")
    return write_table(chosen.mapInArrow(name, "node binary, text string"), "texts")


def _verify(pairs: DataFrame, texts_of: DataFrame) -> DataFrame:
    """x, y and linked: the exact test of each pair on the sorted shingles of both texts."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, last, a = [], None, None
            for x, one, two in zip(*(batch.column(c) for c in ("x", "a", "b")), strict=True):
                if x != last:
                    last, a = x, shingles(one.as_py())
                b = shingles(two.as_py())
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * common >= 75 * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(linked, pa.bool_())], ["x", "y", "linked"])

    side = lambda c, to: texts_of.select(F.col("node").alias(c), F.col("text").alias(to))
    return pairs.join(side("y", "b"), "y").join(side("x", "a"), "x").mapInArrow(test, "x binary, y binary, linked boolean")


def connected(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node reachable) of all nodes of the edges (x, y), by repeated minima and jumps."""
    both = write_table(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = write_table(both.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("comp").alias("near"))
        step = labels.join(near, F.col("node") == F.col("x")).select("node", "comp", F.least("comp", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("further"))
        step = step.join(jump, "new").select("node", F.col("comp").alias("old"), F.least("new", "further").alias("comp"))
        step = write_table(step, "labels")
        labels = step.select("node", "comp")
        if step.where("old <> comp").isEmpty():
            return labels


def _label(rows: DataFrame, labels: DataFrame, node: str, comp: str) -> DataFrame:
    named = labels.select(F.col("node").alias(node), F.col("comp").alias("_comp"))
    return rows.join(named, node, "left").withColumn(comp, F.coalesce("_comp", node)).drop("_comp")


class _Links:
    """Verified links so far, and the components they make."""

    def __init__(self, spark: SparkSession, docs: DataFrame, sets: DataFrame) -> None:
        self.docs, self.sets = docs, sets
        self.tested = spark.createDataFrame([], "x binary, y binary, linked boolean")
        self.labels = spark.createDataFrame([], "node binary, comp binary")

    def crossing(self, pool: DataFrame) -> DataFrame:
        """The untested pairs of two components."""
        rows = _label(_label(pool, self.labels, "x", "comp_x"), self.labels, "y", "comp_y").where("comp_x <> comp_y")
        return rows.join(self.tested.select("x", "y"), ["x", "y"], "left_anti")

    def settle(self, pool: DataFrame) -> bool:
        """Verify the pool until no pair of it crosses components: the best of each component, then
        all. False if nothing was to be done."""
        texts_of, turn = None, 0
        while True:
            cross = write_table(self.crossing(pool), "crossing")
            if cross.isEmpty():
                return turn > 0
            if texts_of is None:
                nodes = cross.select(F.col("x").alias("node")).union(cross.select(F.col("y").alias("node"))).distinct()
                texts_of = _texts_of(self.docs, self.sets, nodes)
            chosen = cross.select("x", "y")
            if turn == 0:
                rank = F.row_number().over(Window.partitionBy("comp").orderBy(F.col("gain").desc(), "x", "y"))
                sides = [cross.select("x", "y", "gain", F.col(f"comp_{s}").alias("comp")).withColumn("rank", rank).where("rank = 1") for s in "xy"]
                chosen = sides[0].select("x", "y").union(sides[1].select("x", "y")).distinct()
            self.tested = self.tested.unionByName(write_table(_verify(chosen, texts_of).distinct(), "tested"))
            links = self.tested.where("linked").select("x", "y")
            if not links.isEmpty():
                self.labels = connected(links)
            turn += 1


def _remaining(tiles: DataFrame, sizes: DataFrame, links: _Links, sets: DataFrame, best: int) -> DataFrame:
    """x, y, gain and more: for any two components of a tile the `best` admitted pairs, block by block.

    `more` tells that a block had further admitted pairs. Tiles whose pairs have all met a leader are left out.
    """
    labelled = _label(tiles.join(sizes.where("open").select("key", "band", "members"), ["key", "band"]), links.labels, "node", "comp")
    tag = F.xxhash64("comp")
    mixed = labelled.groupBy("key", "band").agg(F.min(tag).alias("a"), F.max(tag).alias("b")).where("a <> b").select("key", "band")
    rows = labelled.join(mixed, ["key", "band"]).join(sets.select("node", "bits"), "node")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, own).alias("low"), F.greatest(k, own).alias("high"))))
    dealt = rows.withColumn("pair", pair).withColumn("own", own).select("key", "band", "pair.low", "pair.high", "own", "resident", "n", "pos", "node", "comp", "bits")
    dealt = dealt.repartition("key", "band", "low", "high").sortWithinPartitions("key", "band", "low", "high", "node")

    def compare(run: list[tuple]) -> list[tuple]:
        own, resident, n, pos = (np.array([r[k] for r in run]) for k in (4, 5, 6, 7))
        width = min(len(r[10]) for r in run) // 8
        bits = np.stack([fold(np.frombuffer(r[10], np.uint64), width) for r in run])
        comps = {c: k for k, c in enumerate(dict.fromkeys(r[9] for r in run))}
        comp = np.array([comps[r[9]] for r in run])
        same_block = run[0][2] == run[0][3]
        found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for i in range(len(run) - 1):
            j = np.arange(i + 1, len(run))
            j = j[(comp[j] != comp[i]) & (resident[j] | resident[i]) & (same_block | (own[j] != own[i])) & _possible(n[j], n[i], pos[j], pos[i])]
            if len(j):
                overlap = np.minimum(n[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(axis=1), n[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(axis=1)).astype(np.int64)
                gain = overlap / (n[i] + n[j] - overlap)
                for k in np.flatnonzero(gain >= 0.75):
                    found.setdefault((min(comp[i], comp[j[k]]), max(comp[i], comp[j[k]])), []).append((-gain[k], i, int(j[k])))
        out = []
        for pairs in found.values():
            pairs.sort()
            out += [(run[i][8], run[j][8], -g, len(pairs) > best) for g, i, j in pairs[:best]]
        return out

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.binary(), pa.binary(), pa.float64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["x", "y", "gain", "more"])

        run: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run and run[0][:4] != row[:4]:
                    out += compare(run) if len(run) > 1 else []
                    run = []
                run.append(row)
            yield emit(out)
        if len(run) > 1:
            yield emit(compare(run))

    found = dealt.mapInArrow(stream, "x binary, y binary, gain double, more boolean")
    return found.groupBy("x", "y").agg(F.max("gain").alias("gain"), F.max("more").alias("more"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id (the smallest doc_id reachable by links of at least 3/4).

    Texts without words are linked with nothing, each is a component of its own. Rows that repeat an id count as
    documents; a null id is no smallest id unless a component has none other. No limit holds on partners or
    tiles: what the leaders leave open is compared in blocks until no admitted pair of two components is untested.
    """
    spark = docs.sparkSession
    docs = texts(docs, id_col, text_col)
    scanned = write_table(docs.mapInArrow(_sets, "doc_id bigint, n int, node binary, bits binary, key bigint, uses bigint"), "sets")
    rows = scanned.where("n is not null").select("doc_id", "n", "node")
    hot = scanned.where("n is null").groupBy("key").agg(F.sum("uses").alias("uses")).where(F.col("uses") >= HOT_SETS)
    hot_keys = hot.orderBy(F.col("uses").desc(), "key").limit(HOT_KEPT).select("key").toArrow()["key"].to_numpy()  # order of work, not of results
    reps = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    one_bits = scanned.where("n > 0").select("doc_id", "node", "bits")
    sets = reps.join(one_bits, (reps["rep"].eqNullSafe(one_bits["doc_id"])) & (reps["node"] == one_bits["node"])).select(reps["node"], "rep", "n", "bits").dropDuplicates(["node"])
    sets = write_table(sets, "classes")

    prefixes = _prefixes(docs, np.sort(hot_keys.astype(np.int64).view(np.uint64)))
    met = write_table(_meetings(prefixes), "meetings")
    members = met.where("key is not null").select("key", "n", "pos", F.col("x").alias("node")).distinct()
    tiles = write_table(_tiles(members), "tiles")
    lead = [F.min(F.when(F.col("resident"), F.xxhash64("node", F.lit(k)))).alias(f"lead{k}") for k in range(LEADERS)]
    sizes = tiles.groupBy("key", "band").agg(F.count("*").alias("members"), *lead).where("members > 1 and lead0 is not null")
    sizes = write_table(sizes, "tile-sizes")

    leads = [F.struct(F.lit(k).alias("seed"), F.col(f"lead{k}").alias("lead")) for k in range(LEADERS)]
    stars = tiles.join(sizes.select("key", "band", *(f"lead{k}" for k in range(LEADERS))), ["key", "band"])
    stars = stars.select("node", F.explode(F.array(*leads)).alias("l")).select("node", "l.seed", "l.lead").distinct()
    names = [F.struct(F.lit(k).alias("seed"), F.xxhash64("node", F.lit(k)).alias("lead")) for k in range(LEADERS)]
    names = sets.select(F.col("node").alias("leader"), F.explode(F.array(*names)).alias("l")).select("leader", "l.seed", "l.lead")
    stars = stars.join(names, ["seed", "lead"]).where("leader <> node").select(F.least("leader", "node").alias("x"), F.greatest("leader", "node").alias("y"))
    pairs = met.where("key is null").select("x", "y").unionByName(stars).distinct()
    links = _Links(spark, docs, sets)
    links.settle(write_table(_admit(pairs, sets), "admitted"))

    sizes = sizes.withColumn("open", F.col("members") > 2)  # two members have met
    best = 1
    while True:
        pool = write_table(_remaining(tiles, sizes, links, sets, best), "remaining")
        links.settle(pool.select("x", "y", "gain"))
        # All crossing pairs of the tiles were in the pool and are tested now, unless a block had more of them.
        if pool.where("more").isEmpty():
            break
        best *= MORE
    comp = _label(rows, links.labels, "node", "comp")
    smallest = comp.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    with_words = comp.where("n > 0").join(smallest, "comp").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return with_words.unionByName(rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, without those that have a smaller id in their component."""
    found = near_duplicates(docs, id_col, text_col).where("not doc_id <=> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = write_table(found, "gone")
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["_gone"]), "left_anti")
