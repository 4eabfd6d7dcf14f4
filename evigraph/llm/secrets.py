"""Secrets: fixed formats always, and token runs that a linear-chain conditional random field tags begin/inside/outside.

The field reads every token of a text. Only where its weights prove that the best path is outside is no path computed.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.pii import Cover
from evigraph.llm.shared import texts, write_table

KINDS = ("assign", "access", "hex", "tagged")
SAMPLE_SEQUENCES = 4_000
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
BUCKETS = 1 << 12
#: Tokens of a training sequence, and of a block that is scored at once; neighbours are seen across both.
LENGTH, BLOCK = 64, 8192

# The formats of the base spans.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_WORD = re.compile("|".join(ASSIGN_WORDS))
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

TOKEN = re.compile(r"[A-Za-z0-9_+/=.-]+|[^\sA-Za-z0-9_+/=.-]")
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed formats, by start, then kind as listed; code points, end exclusive.

    Only a word that is named in the pattern can start `assign`, so texts without any of them are not scanned for it.
    """
    spans: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


KINDS_OF = str.maketrans({**dict.fromkeys("0123456789", "9"), **{c: "A" if c < "a" else "a" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}})
REPEAT = re.compile(r"(.)\1+")


def shape(token: str) -> str:
    if not token.isascii():  # a single character
        return "A" if token.isupper() else "a" if token.islower() else token
    return REPEAT.sub(r"\1+", token[:64].translate(KINDS_OF))[:8]


def letter_counts(token: str) -> tuple[int, ...]:
    return tuple(sorted([token.count(c) for c in set(token)]))


def entropy(token: str) -> float:
    counts = letter_counts(token)
    return -sum(n / len(token) * math.log2(n / len(token)) for n in counts) if len(counts) < len(token) else math.log2(len(token))


def named(low: str) -> str:
    """The first of the words that name secrets that the token holds."""
    return next(w for w in ASSIGN_WORDS if w in low) if ASSIGN_WORD.search(low) else ""


def brief(token: str) -> tuple:
    """What `describe` depends on for ASCII tokens of up to 64 characters: tokens of one brief look alike."""
    low = token.lower()
    return token.translate(KINDS_OF), letter_counts(token), not low.strip("0123456789abcdef"), (word := named(low)), bool(word) and len(word) == len(token), token[:4] if len(token) >= 16 else ""


def describe(token: str) -> tuple[str, ...]:
    """What one token looks like: shape, length, alphabet, letters' surprise, and the words that name secrets."""
    low, n = token.lower(), len(token)
    hexlike, word = n >= 8 and not low.strip("0123456789abcdef"), named(low)
    return (
        f"s:{shape(token)}", f"n:{min(n, 48) // 4}", f"h:{hexlike}:{min(n, 48) // 8}", f"e:{int(2 * entropy(token))}:{n >= 16}",
        f"w:{word}:{n == len(word)}", f"d:{sum(c.isdigit() for c in token) * 4 // n}", f"p:{token[:4] if n >= 16 else ''}",
    )


class Coder:
    """Feature buckets, tokens x features: the token itself, two neighbours to either side, and the file.

    Tokens that look alike are one class, whose buckets are computed once; the tables are emptied when they grow large.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.briefs: dict[tuple, int] = {}
        self.classes: dict[tuple[str, ...], int] = {}
        self.own, self.near, self.shapes = np.zeros((256, 8), np.uint16), np.zeros((256, 4, 3), np.uint16), []
        self.marks: dict[str, np.ndarray] = {}
        #: Weights summed by class (`Field.scores`): under the file's marks for the token itself, under None for its four neighbours.
        self.tables: dict[tuple[str, ...] | None, np.ndarray] = {}
        self.add(("none",) * 7)

    def add(self, looks: tuple[str, ...]) -> int:
        k = self.classes[looks] = len(self.classes)
        if k == len(self.own):
            self.own, self.near = np.concatenate([self.own, self.own]), np.concatenate([self.near, self.near])
        self.own[k] = [bucket(x) for x in (*looks, looks[0] + looks[1])]
        self.near[k] = [[bucket(d + looks[j]) for j in (0, 1, 4)] for d in "abcd"]
        self.shapes.append(looks[0])
        return k

    def ids(self, tokens: list[str]) -> np.ndarray:
        """The classes of a text's tokens, two empty neighbours at either end."""
        if len(self.known) > 400_000 or len(self.classes) > 50_000:
            self.clear()
        out = list(map(self.known.get, tokens))
        if None in out:
            out = [self.class_of(token) if k is None else k for token, k in zip(tokens, out, strict=True)]
        return np.array([0, 0, *out, 0, 0], dtype=np.int64)

    def class_of(self, token: str) -> int:
        key = brief(token) if token.isascii() and len(token) <= 64 else None
        k = self.briefs.get(key)
        if k is None:
            looks = describe(token)
            k = self.classes.get(looks)
            k = self.add(looks) if k is None else k
            if key is not None:
                self.briefs[key] = k
        self.known[token] = k
        return k

    def blocks(self, tokens: list[str], marks: tuple[str, ...]) -> Iterator[np.ndarray]:
        ids = self.ids(tokens)
        for f in marks:
            done = self.marks.get(f, np.empty(0, np.uint16))
            if len(done) < len(self.shapes):
                self.marks[f] = np.concatenate([done, np.array([bucket(f + x) for x in self.shapes[len(done) :]], np.uint16)])
        for at in range(2, len(ids) - 2, BLOCK):
            end = min(at + BLOCK, len(ids) - 2)
            mine = ids[at:end]
            near = [self.near[ids[at + d : end + d], k] for k, d in enumerate((-2, -1, 1, 2))]
            yield np.hstack([self.own[mine], *near, *(self.marks[f][mine][:, None] for f in marks)])


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def file_marks(text: str) -> tuple[str, ...]:
    """Features of the whole file: its share of digits and of marks that code uses."""
    n = max(1, len(text))
    return f"fd{min(4, 40 * sum(map(text.count, '0123456789')) // n)}", f"fc{min(4, 40 * sum(map(text.count, '=;{}()')) // n)}"


@dataclass(frozen=True)
class Field:
    """Weights of the field: BUCKETS x 3 for features, 3 x 3 for neighbouring tags. None: nothing was learned."""

    emit: np.ndarray | None = None
    move: np.ndarray | None = None

    @cached_property
    def coder(self) -> Coder:
        return Coder()

    def __getstate__(self) -> dict:
        return {"emit": self.emit, "move": self.move}

    def scores(self, tokens: list[str], marks: tuple[str, ...]) -> np.ndarray:
        """Tokens x tags: the weights of all features that `Coder.blocks` names, summed for each class once."""
        coder = self.coder
        ids = coder.ids(tokens)
        tables, size = coder.tables, len(coder.shapes)
        near = tables.get(None, np.zeros((4, 0, 3)))
        if (done := near.shape[1]) < size:
            more = self.emit[coder.near[done:size]].sum(axis=2).transpose(1, 0, 2)
            near = tables[None] = np.concatenate([near, more], axis=1)
        own = tables.get(marks, np.zeros((0, 3)))
        if (done := len(own)) < size:
            more = self.emit[coder.own[done:size]].sum(axis=1)
            for f in marks:
                more = more + self.emit[[bucket(f + x) for x in coder.shapes[done:]]]
            own = tables[marks] = np.concatenate([own, more])
        score = np.empty((len(tokens), 3))
        for at in range(0, len(tokens), BLOCK):
            end = min(at + BLOCK, len(tokens))
            part = own.take(ids[at + 2 : end + 2], axis=0)
            for k, d in enumerate((0, 1, 3, 4)):
                part += near[k].take(ids[at + d : end + d], axis=0)
            score[at:end] = part
        return score

    def tags(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of a whole text."""
        return self.path(self.emit[x].sum(axis=1))

    def path(self, score: np.ndarray) -> np.ndarray:
        """The best tag sequence for scores of tokens x tags, by Viterbi between tokens that are surely outside."""
        path = np.full(len(score), OUTSIDE)
        alive = np.flatnonzero(self.open(score))
        for part in np.split(alive, np.flatnonzero(np.diff(alive) > 1) + 1) if len(alive) else []:
            start, end = part[0], part[-1] + 1
            path[start:end] = self.viterbi(score[start:end], start == 0, end == len(score))
        return path

    def open(self, score: np.ndarray) -> np.ndarray:
        """Where a best path may leave outside.

        A run that is not outside gains, over the same tokens outside, at most the sum of its tokens' gains, each with the
        dearest move, and one move more. Where no run through a token gains anything, every best path is outside.
        """
        step = np.delete(self.move.ravel(), [OUTSIDE * 3 + OUTSIDE, OUTSIDE * 3 + INSIDE]).max() - self.move[OUTSIDE, OUTSIDE]
        gain = np.maximum(score[:, BEGIN], score[:, INSIDE]) - score[:, OUTSIDE] + step
        until = lambda g: (total := np.cumsum(g)) - np.minimum.accumulate(np.append(0.0, total[:-1]))
        return until(gain) + until(gain[::-1])[::-1] - gain + abs(step) > -1e-6

    def viterbi(self, score: np.ndarray, first: bool, last: bool) -> list[int]:
        """Viterbi over part of a text, outside before and after it, but at the ends of the text."""
        move = self.move.tolist()
        rows = score.tolist()
        best = [rows[0][k] + (0 if first else move[OUTSIDE][k]) for k in range(3)]
        if first:
            best[INSIDE] = -1e9
        back = []
        for row in rows[1:]:
            from_ = [max((0, 1, 2), key=lambda j, k=k: best[j] + move[j][k]) for k in range(3)]
            best = [best[j] + move[j][k] + row[k] for k, j in enumerate(from_)]
            back.append(from_)
        tag = max((0, 1, 2), key=lambda k: best[k] + (0 if last else move[k][OUTSIDE]))
        path = [tag]
        for from_ in reversed(back):
            path.append(tag := from_[tag])
        return path[::-1]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Tagged runs that meet no base span, as spans of the kind `tagged`."""
        if self.emit is None or not (tokens := TOKEN.findall(text)):
            return []
        path = self.path(self.scores(tokens, file_marks(text)))
        if not path.any():
            return []
        found: list[Span] = []
        for m, tag in zip(TOKEN.finditer(text), path.tolist(), strict=True):
            if tag == BEGIN:
                found.append(("tagged", *m.span()))
            elif tag == INSIDE:
                found[-1] = ("tagged", found[-1][1], m.end())
        cover = Cover(base)
        return [span for span in found if not cover.meets(*span[1:])]


def train(sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.2, decay: float = 1e-4, weights: np.ndarray | None = None) -> Field:
    """Maximum conditional likelihood by Adagrad over batches of padded sequences, in a fixed order; means are weighted."""
    weights = np.ones(len(sequences)) if weights is None else weights
    emit, move = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    move[OUTSIDE, INSIDE] = -1e4  # inside follows begin or inside only
    fixed = move < -1e3
    past_emit, past_move = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    order = sorted(range(len(sequences)), key=lambda k: (len(sequences[k][0]), k))
    batches = [order[k : k + 32] for k in range(0, len(order), 32)]
    for epoch in range(epochs):
        for k in range(len(batches)):
            batch = [sequences[i] for i in batches[(k * 7919 + epoch) % len(batches)]]
            part = weights[batches[(k * 7919 + epoch) % len(batches)]]
            part = part / part.sum()
            n, width = max(len(x) for x, _ in batch), batch[0][0].shape[1]
            x, y, real = np.zeros((len(batch), n, width), np.int64), np.zeros((len(batch), n), np.int64), np.zeros((len(batch), n), bool)
            for i, (features, tags) in enumerate(batch):
                x[i, : len(tags)], y[i, : len(tags)], real[i, : len(tags)] = features, tags, True
            score = emit[x].sum(axis=2)
            score[:, 0, INSIDE] = -1e4
            lift = lambda a: np.log(np.exp(a - (m := a.max(axis=1, keepdims=True))).sum(axis=1)) + m[:, 0]
            ahead, behind = np.zeros((n, len(batch), 3)), np.zeros((n, len(batch), 3))
            ahead[0] = score[:, 0]
            for t in range(1, n):
                ahead[t] = np.where(real[:, t, None], lift(ahead[t - 1][:, :, None] + move) + score[:, t], ahead[t - 1])
            for t in range(n - 2, -1, -1):
                follow = lift((behind[t + 1] + score[:, t + 1])[:, :, None] + move.T)
                behind[t] = np.where(real[:, t + 1, None], follow, 0)
            whole = lift(ahead[-1][:, :, None])[:, 0]
            here = np.exp(ahead + behind - whole[:, None]).transpose(1, 0, 2) * real[:, :, None]
            gold = np.eye(3)[y] * real[:, :, None]
            slope = np.zeros_like(emit)
            np.add.at(slope, x[real], ((gold - here) * part[:, None, None])[real][:, None, :])
            pair = np.zeros((3, 3))
            for t in range(1, n):
                both = np.exp(ahead[t - 1][:, :, None] + move + (behind[t] + score[:, t])[:, None, :] - whole[:, None, None])
                pair += ((np.einsum("bi,bj->bij", gold[:, t - 1], gold[:, t]) - both) * part[:, None, None])[real[:, t]].sum(axis=0)
            slope = slope - decay * emit
            pair = np.where(fixed, 0, pair)
            past_emit += slope**2
            past_move += pair**2
            emit += rate * slope / np.sqrt(past_emit)
            move += rate * pair / np.sqrt(past_move)
    return Field(emit, move)


def sequences_of(coder: Coder, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, tags) of all tokens of a text, LENGTH tokens each; tokens in base spans' values are begin and inside."""
    if not (tokens := TOKEN.findall(text)):
        return
    tags = np.full(len(tokens), OUTSIDE, np.uint8)
    if spans := base_spans(text):
        values = sorted(ASSIGN.match(text, s).span(1) if kind == "assign" else (s, e) for kind, s, e in spans)
        at, open_until = 0, -1
        for k, m in enumerate(TOKEN.finditer(text)):
            while at < len(values) and values[at][1] <= m.start():
                at += 1
            if at < len(values) and values[at][0] < m.end():
                tags[k] = INSIDE if m.start() < open_until else BEGIN
                open_until = max(open_until, values[at][1])
    at = 0
    for x in coder.blocks(tokens, file_marks(text)):
        for k in range(0, len(x), LENGTH):
            y = tags[at + k : at + min(k + LENGTH, len(x))].copy()
            y[0] = BEGIN if y[0] == INSIDE else y[0]
            yield x[k : k + LENGTH], y
        at += len(x)


def key_of(x: np.ndarray, y: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(x.tobytes() + y.tobytes(), digest_size=8).digest(), "little", signed=True)


def sampled(docs: DataFrame, sample: int = SAMPLE_SEQUENCES, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(features, tags, n): at most `sample` distinct sequences by hash and how often each occurs; half of them hold a secret."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            found: dict[int, list] = {}
            for text, at in zip(batch.column("text"), batch.column("at").to_pylist(), strict=True):
                for x, y in sequences_of(coder, text.as_py()):
                    row = found.setdefault(key_of(x, y), [bool(y.any()), 0, at])
                    row[1] += 1
                    row[2] = min(row[2], at)
            columns = list(zip(*((k, *row) for k, row in found.items()), strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "secret", "n", "at"])

    placed = texts(docs, id_col, text_col).select("text", F.xxhash64("text").alias("at"))
    distinct = placed.mapInArrow(count, "key long, secret boolean, n long, at long").groupBy("key", "secret").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    distinct = write_table(distinct, "sequences")  # read once for each half
    half = sample // 2
    chosen = {r.key: r for part in ("secret", "not secret") for r in distinct.where(part).orderBy("key").limit(half).collect()}
    if not chosen:
        return []
    keys = set(chosen)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            rows = {}
            for text in batch.column("text"):
                rows |= {k: (k, x.tobytes(), y.tobytes()) for x, y in sequences_of(coder, text.as_py()) if (k := key_of(x, y)) in keys}
            columns = list(zip(*rows.values(), strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["key", "x", "y"])

    # One text for each chosen sequence; copies of a text are read once.
    places = docs.sparkSession.createDataFrame([(a,) for a in sorted({r.at for r in chosen.values()})], "at long")
    once = placed.join(F.broadcast(places), "at", "left_semi").groupBy("at").agg(F.first("text").alias("text"))
    taken = {r["key"]: r for r in once.select("text").mapInArrow(take, "key long, x binary, y binary").toArrow().to_pylist()}
    out = []
    for key in sorted(taken):
        y = np.frombuffer(taken[key]["y"], dtype=np.uint8).astype(np.int64)
        out.append((np.frombuffer(taken[key]["x"], dtype=np.uint16).reshape(len(y), -1), y, chosen[key].n))
    return out


def fit(docs: DataFrame, sample: int = SAMPLE_SEQUENCES, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field from at most `sample` distinct token sequences of whole texts, chosen by hash; half of them hold a secret.

    Tokens inside base spans' values are labelled begin and inside, all others outside. Equal sequences are one that
    counts as often as it occurs. Without any labelled secret nothing is learned, and only base spans count.
    """
    chosen = sampled(docs, sample, id_col, text_col)
    if not any(y.any() for _, y, _ in chosen):
        return Field()
    return train([(x, y) for x, y, _ in chosen], weights=np.array([n for _, _, n in chosen], dtype=float))


def written(spans: list[Span]) -> str:
    """kind:start:end, by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex (base spans), base (written), spans (base and tagged, written).

    Null and empty texts have no spans; repeated rows and null ids give a row each.
    """
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string"
    shared = docs.sparkSession.sparkContext.broadcast(field)  # BUCKETS x 3 weights

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every, counts = [], [], []
            for text in batch.column("text"):
                own = base_spans(body := text.as_py())
                base.append(written(own))
                every.append(written(own + shared.value.added(body, own)))
                counts.append([sum(k == kind for k, _, _ in own) for kind in KINDS[:3]])
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(base, pa.string()), pa.array(every, pa.string())], names)

    return texts(docs, id_col, text_col).mapInArrow(scan, schema)


def secret_spans(docs: DataFrame) -> DataFrame:
    """The digest of the whole table: counts and checksum of the base spans, and all spans."""
    found = find(docs, fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
