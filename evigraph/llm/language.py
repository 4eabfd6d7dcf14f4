"""Language identification by bit-sliced Bloom filters: one lookup returns all languages that contain an n-gram."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.shared import texts, write_table

SLOT_BITS, HASHES, LANGUAGES = 18, 3, 63
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(k).isalpha() for k in range(0x110000)]))
    return _LETTERS[0]


def grams(text: str) -> np.ndarray:
    """The distinct trigrams of a text in lower case: letters, and one blank for each run of anything else."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, dtype=np.uint64)
    codes = np.where(letter, codes, np.uint64(32))[letter | np.concatenate([[False], letter[:-1]])]
    codes = np.concatenate([[np.uint64(32)], codes, np.full(int(codes[-1] != 32), 32, np.uint64)])
    return np.unique(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:])


def slots(gram: np.ndarray) -> np.ndarray:
    """HASHES slot numbers for each n-gram."""
    x = gram * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    step = x >> np.uint64(40) | np.uint64(1)
    return np.stack([(x + np.uint64(k) * step) & np.uint64((1 << SLOT_BITS) - 1) for k in range(HASHES)]).astype(np.int64)


@dataclass(frozen=True)
class LanguageFilters:
    """`names` in code point order; bit k of a slot stands for names[k]. `false_rate` is each filter's chance of a false hit."""

    names: tuple[str, ...]
    masks: np.ndarray
    false_rate: np.ndarray
    fallback: str

    def decide(self, text: str | None) -> tuple[str, float]:
        """(language, share of the text's n-grams that the language contains); equal shares: the first name.

        Without text or letter, or without any learned language: `und` and 0. If no language has any of the n-grams, the
        language with most training documents and 0.
        """
        gram = grams(text) if text else np.empty(0, dtype=np.uint64)
        if not len(gram) or not self.names:
            return UNKNOWN, 0.0
        hit = np.bitwise_and.reduce(self.masks[slots(gram)], axis=0)
        counts = np.array([np.count_nonzero(hit & (1 << k)) for k in range(len(self.names))])
        true = np.clip((counts - len(gram) * self.false_rate) / (1 - self.false_rate), 0, len(gram))
        best = int(np.argmax(true))
        return (self.names[best], float(true[best] / len(gram))) if true[best] > 0 else (self.fallback, 0.0)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_rate: float = 0.002, min_share: float = 0.2) -> LanguageFilters:
    """Filters from all labelled texts of `docs`; rows without text, letter or label teach nothing.

    A language contains an n-gram if at least `min_rate` of its documents have it, and at least `min_share` of the rate
    of the language where it is most usual: foreign lines in a text don't count. Rates follow from counts over all documents.
    What reaches the driver is the filter itself, at most 2^SLOT_BITS slots, and a row for each of at most LANGUAGES labels;
    more labels raise a ValueError.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[np.ndarray]] = {}
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        documents: dict[str, int] = {}
        held = 0

        def fold() -> None:
            for lang, parts in seen.items():
                old_gram, old_n = totals.get(lang, (np.empty(0, np.uint64), np.empty(0, np.int64)))
                gram, inverse = np.unique(np.concatenate([old_gram, *parts]), return_inverse=True)
                weights = np.concatenate([old_n, np.ones(len(inverse) - len(old_n), np.int64)])
                totals[lang] = gram, np.bincount(inverse, weights).astype(np.int64)
            seen.clear()

        def rows() -> Iterator[pa.RecordBatch]:
            fold()
            for lang, (gram, n) in totals.items():
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * (len(gram) + 1)), pa.array(np.append(gram.astype(np.int64), -1)), pa.array(np.append(n, documents[lang])),
                ], ["lang", "gram", "n"])
            totals.clear()
            documents.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if len(gram := grams(text.as_py())):
                    seen.setdefault(lang, []).append(gram)
                    documents[lang] = documents.get(lang, 0) + 1
                    held += len(gram)
            if held > 4_000_000:
                fold()
                held = sum(len(g) for g, _ in totals.values())
                if held > 3_000_000:
                    yield from rows()
                    held = 0
        yield from rows()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = slots(batch.column("gram").to_numpy().astype(np.uint64))
            mask = np.tile(batch.column("mask").to_numpy(), HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(where.reshape(-1)), pa.array(mask)], ["slot", "mask"])

    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counted = labelled.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = write_table(counted, "language-counts")
    sizes = {r.lang: r.n for r in counted.where("gram = -1").limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    names = tuple(sorted(sizes))
    masks = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    if not names:
        return LanguageFilters((), masks, np.zeros(0), UNKNOWN)
    size = F.create_map(*[F.lit(x) for k in names for x in (k, float(sizes[k]))])
    bit = F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, 1 << k)])[F.col("lang")].cast("long")
    rated = counted.where("gram >= 0").select("gram", bit.alias("bit"), (F.col("n") / size[F.col("lang")]).alias("rate"))
    usual = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("bit", "rate")).alias("each"))
    has = F.filter("each", lambda x: (x["rate"] >= min_rate) & (x["rate"] >= min_share * F.col("top")))
    mask = F.aggregate(has, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x["bit"]))
    grams_of = usual.select("gram", mask.alias("mask")).where("mask <> 0")
    found = grams_of.mapInArrow(spread, "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks[found["slot"].to_numpy()] = found["mask"].to_numpy()
    fill = np.array([np.count_nonzero(masks & (1 << k)) / len(masks) for k in range(len(names))])
    return LanguageFilters(names, masks, fill**HASHES, max(names, key=lambda k: (sizes[k], k)))


def predict(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row, repeated ids included; see LanguageFilters.decide for odd texts."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2^SLOT_BITS slots of 8 bytes

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.decide(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64()),
            ], ["doc_id", "lang_pred", "score"])

    return texts(docs, id_col, text_col).mapInArrow(decide, "doc_id bigint, lang_pred string, score double")


def keep_identified(docs: DataFrame, filters: LanguageFilters, min_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose language is known with at least `min_score`; all columns stay as they are, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.decide(t.as_py()) for t in batch.column(text_col)]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents that are not held out and predict all: doc_id, held_out, lang_pred, score."""
    filters = fit(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs, filters)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
