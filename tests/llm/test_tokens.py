"""Token files and packing beside the tokenizers library itself."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evigraph.llm import packing, token_files
from evigraph.llm.bpe import Encoder
from evigraph.llm.queries import QUERIES

DOCS = "doc_id long, text string, source string, start string, part string"
ODD = [
    "", " ", "\n\n  a", "it's they'll 'tis I'M", "a\t\n b \x1c c\x0b", "tab\t\tword \n", "éÉ ÀÖ ×÷ ª µ 12 345", "日本語 text 　x", "é ñ",
    "<|endoftext|> <|startoftext|>", "x" * 5000, "a.b,c!!  ?? -- ", " line\u0085next", "ßẞ İI", "1234567 ½ Ⅷ",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    mine = Encoder(name)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "日", "'s", "'", "1", "23", ".", "!?", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\u3000", "\u0301", "ß", "Σ", "\x85", "\xa0", "The", "<|", "|>", "½", "İ"]
    mixed = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(4000)]
    megabyte = "".join(rng.choices(["word ", "Éa ", "x1", ", ", "\n", "longer-words "], k=200_000))
    for text in [*ODD, " ".join(ODD), *mixed, megabyte, f"{megabyte}<|endoftext|>end"]:
        assert mine.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_pack_and_unpack_round_trip():
    rng = np.random.default_rng(1)
    for n, top in [(1, 5), (4, 3), (1001, 70_000), (5, 1)]:
        ids = rng.integers(0, top, n).astype("<u4")
        assert token_files.unpack(*token_files.pack(ids), n).tolist() == ids.tolist()
    assert len(token_files.unpack(*token_files.pack(np.array([], dtype="<u4")), 0)) == 0


def rows(spark):
    data = [(i * 7 % 15, t, "s", "x", "y") for i, t in enumerate(ODD)] + [(3, None, None, None, None), (3, "twin", "s", "x", "y"), (3, "twin", "s", "x", "y"), (None, "no id", "s", "x", "y")]
    return spark.createDataFrame(data, DOCS).repartition(3)


def test_token_digest_beside_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    frame = rows(spark)
    data = sorted(((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in frame.collect()))
    want, start = [], 0
    for doc_id, text in data:
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        want.append((None if doc_id < 0 else doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.token_digest(frame).orderBy("start").collect()]
    assert got == want
    assert token_files.token_digest(frame.limit(0)).collect() == []


def check_packing(got, size):
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences), sum(r.length for r in got)


def test_packing_of_odd_texts(spark):
    frame = rows(spark)
    got = packing.pack_documents(frame, size=64).collect()
    count, total = check_packing(got, 64)
    assert count <= -(-total // 64) + 1
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in frame.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], dtype="<u4")
            want.append((r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    key = lambda x: (x[0] is None, *map(str, x))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    assert packing.pack_documents(frame.limit(0)).collect() == []


def test_swaps_empty_a_bin():
    lengths = np.array([6, 3, 5, 4, 2])  # best is two bins of ten
    bins = packing.swap_search([[0, 1], [2, 3], [4]], lengths, 10)
    assert len(bins) == 2 and sorted(sum(bins, [])) == [0, 1, 2, 3, 4]
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(1, 40, 60)
        bins = packing.swap_search(packing.best_fit(lengths, 64), lengths, 64)
        assert sorted(sum(bins, [])) == list(range(60)) and max(lengths[b].sum() for b in bins) <= 64


def test_swaps_end_where_nothing_gains():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = rng.integers(1, 30, 40)
        bins = packing.swap_search([[k] for k in range(40)], lengths, 64)
        fill = [int(lengths[b].sum()) for b in bins]
        if len(bins) == -(-int(lengths.sum()) // 64):
            continue
        for a, b in itertools.permutations(range(len(bins)), 2):  # one or two pieces of a for none or one of b
            for given in [c for k in (1, 2) for c in itertools.combinations(bins[a], k)]:
                for taken in [(), *((i,) for i in bins[b])]:
                    shift = int(lengths[list(given)].sum() - lengths[list(taken)].sum())
                    new = fill[a] - shift, fill[b] + shift
                    if fill[a] < 64 and fill[b] < 64 and shift > 0 and new[1] <= 64:
                        assert new[0] ** 2 + new[1] ** 2 <= fill[a] ** 2 + fill[b] ** 2
    # 300 single pieces are more than 200 steps: a bin that has 20 pieces has 190 pairs.
    assert len(packing.swap_search([[k] for k in range(600)], np.full(600, 7), 70)) == 60
    lengths = np.array([*range(100, 120), 41, 159])
    assert len(packing.swap_search([list(range(20)), [20], [21]], lengths, 2400)) == 1


def test_packing_goes_on_while_bins_are_saved(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 12)
    rng = np.random.default_rng(7)
    table = [(k, 0, 0, int(n), k) for k, n in enumerate(rng.integers(300, 1400, 1500))]
    pieces = spark.createDataFrame(table, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    got = packing.pack_pieces(pieces, 2048).collect()
    assert sorted(r.doc_id for r in got) == list(range(1500))
    count, _ = check_packing(got, 2048)
    assert count <= 700  # three rounds: 703


def test_packing_fill(spark, sf_dir):
    got = QUERIES["op9_best_fit_packing"](spark, sf_dir).collect()
    count, total = check_packing(got, 2048)
    assert count <= 1.02 * -(-total // 2048) + 1


def test_token_files_cover_all_documents(spark, sf_dir):
    got = QUERIES["op6_token_files"](spark, sf_dir).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids) and len(ids) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert [r.start for r in got][1:] == list(np.cumsum([r.n_tokens for r in got])[:-1])
