"""Personal data: fixed formats always, and look-alike spans that boosted trees with calibrated thresholds select."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.shared import texts, write_table

KINDS = ("email", "ip", "card", "phone")
#: Training rows of a task, and the levels a threshold may have.
ROWS_A_TASK = 20_000
LEVELS = np.arange(10_001) / 10_000
#: A kind with fewer distinct rows of a label than this has too few to hold some out; their copies are split instead.
FEW = 30

# The formats of the base spans. Possessive repeats give the same matches as plain ones, in linear time.
DIGIT = re.compile("[0-9]")
LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# What the generators propose beside the base formats; spans may overlap.
LOOSE = {
    "email": re.compile(r"[\w.%+-]{1,64}+\s?(?:@|\(at\)|\[at\]|\{at\})\s?[\w-]{1,63}+(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[\w-]{1,63}+){1,8}"),
    "ip": re.compile(r"(?<![\w.:])(?:[0-9]{1,4}+(?:\.[0-9]{1,4}+){2,5}|[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){3,7})(?![\w:])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,22}+"),
    "phone": re.compile(r"(?<![0-9])(?:\+\s?|00)?(?:\(0?[0-9]{1,5}\)|[0-9]{1,5}+)(?:[\x20./-]{1,2}\(?[0-9]{2,5}+\)?){1,5}"),
}
WORDS = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "account"), "phone": ("phone", "tel", "call", "fax", "mobile"),
}
PLAIN_PHONE = re.compile(r"(?:1[ .-])?\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}")
HIDDEN_MAIL = re.compile(r"\s?[(\[{](?:at|dot)[)\]}]\s?")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the run before it reaches back to the end of the match before at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL_PART.match(text[start - 1]):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


class Cover:
    """Union of spans, with a logarithmic test for overlap."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted((s, e) for _, s, e in spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return (k > 0 and self.ends[k - 1] > start) or (k < len(self.starts) and self.starts[k] < end)

    def add(self, start: int, end: int) -> None:
        """A span that meets none."""
        k = bisect_right(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed formats, by kind as listed, then start; code points, end exclusive."""
    spans: list[Span] = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return spans
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(digits_of(m[0])) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def proposals(text: str) -> list[Span]:
    """High-recall candidates of all kinds, with the base spans among them."""
    found = dict.fromkeys(base_spans(text))
    number = DIGIT.search(text)
    for kind in KINDS:
        if number if kind != "email" else "@" in text or HIDDEN_MAIL.search(text):
            found |= dict.fromkeys((kind, *m.span()) for m in LOOSE[kind].finditer(text))
    return list(found)


def sure(kind: str, text: str) -> bool:
    """The labelling rule for a candidate that no base span covers: other strict formats of the same kinds."""
    if kind == "card":
        return 13 <= len(d := digits_of(text)) <= 19 and d[0] in "3456" and luhn(d)
    if kind == "phone":
        return bool(PLAIN_PHONE.fullmatch(text))
    if kind == "email":
        return bool(HIDDEN_MAIL.search(text)) and next(emails(HIDDEN_MAIL.sub(lambda m: "@" if "at" in m[0] else ".", text)), None) is not None
    parts = text.split(":")
    return kind == "ip" and len(parts) == 8 and all(parts)


FEATURES = 22


def features(text: str, span: Span, crowd: int) -> list[float]:
    """Format and context of a candidate; no validity check is among them."""
    kind, start, end = span
    body = text[start:end]
    groups = [len(g) for g in re.findall(r"[0-9]+", body)] or [0]
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    near = re.split(r"\W+", before)[-4:] + re.split(r"\W+", after)[:2]
    return [
        *(float(kind == k) for k in KINDS), float(len(body)), float(sum(groups)), float(len(groups)), float(max(groups)), float(min(groups)),
        float(groups[0]), float(groups[-1]), float(body[0] == "+"), float("(" in body), float(body.count(".")), float(body.count("-")),
        float(body.count(" ")), float(body.count(":")), float(sum(c.isalpha() for c in body)), float(any(w in near for w in WORDS[kind])),
        float(start > 0 and (text[start - 1].isalnum() or text[start - 1] in "#$=_/.-")), float(end < len(text) and (text[end].isalnum() or text[end] in "_/%")),
        float(min(crowd, 50)),
    ]


@dataclass(frozen=True)
class Selector:
    """Boosted trees as node tables (feature, threshold, left, right, value), and a threshold for each kind."""

    trees: tuple[tuple[float, np.ndarray], ...] = ()
    thresholds: tuple[float, ...] = (2.0,) * len(KINDS)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for weight, nodes in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := nodes[at, 0] >= 0).any():
                feature = np.where(inner, nodes[at, 0], 0).astype(np.int64)
                left = x[np.arange(len(x)), feature] <= nodes[at, 1]
                at = np.where(inner, np.where(left, nodes[at, 2], nodes[at, 3]).astype(np.int64), at)
            margin += weight * nodes[at, 4]
        return 1 / (1 + np.exp(-2 * margin))

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, spans added): the added ones reach their kind's threshold, best first, and overlap no span taken."""
        base = base_spans(text)
        if not self.trees:
            return base, []
        every = proposals(text)
        own = set(base)
        rest = [s for s in every if s not in own]
        taken, added = Cover(base), []
        if rest:
            p = self.score(np.array([features(text, s, len(every)) for s in rest]))
            for k in np.lexsort(([s[1] for s in rest], -p)):
                kind, start, end = rest[k]
                if p[k] >= self.thresholds[KINDS.index(kind)] and not taken.meets(start, end):
                    taken.add(start, end)
                    added.append(rest[k])
        return base, added


def _node_table(tree) -> np.ndarray:
    rows: list[list[float]] = []

    def add(node) -> int:
        at = len(rows)
        rows.append([-1.0, 0.0, 0.0, 0.0, node.prediction()])
        if node.subtreeDepth():
            split = node.split()
            left, right = add(node.leftChild()), add(node.rightChild())
            rows[at] = [split.featureIndex(), split.threshold(), left, right, 0.0]
        return at

    add(tree._java_obj.rootNode())
    return np.array(rows, dtype=float)


def distinct_candidates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """kind, x, label, n: the candidates of all documents, equal ones as one row with their number."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column("text").to_pylist():
                base = set(base_spans(text))
                every, cover = proposals(text), Cover(list(base))
                for span in every:
                    if span in base or not cover.meets(*span[1:]):
                        label = float(span in base or sure(span[0], text[span[1] : span[2]]))
                        found[(KINDS.index(span[0]), tuple(features(text, span, len(every))), label)] += 1
            kinds, x, y = zip(*found, strict=True) if found else ((), (), ())
            columns = [pa.array(kinds, pa.int32()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64()), pa.array(found.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "x", "label", "n"])

    found = texts(docs, id_col, text_col).mapInArrow(candidates, "kind int, x array<double>, label double, n long")
    return found.groupBy("kind", "x", "label").agg(F.sum("n").alias("n"))


def _sided(distinct: DataFrame) -> DataFrame:
    """All rows with `held`, a hash of x alone, so equal rows are on one side."""
    return distinct.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "x"), F.lit(3)) == 2)


def sampled(distinct: DataFrame, sample: int) -> pa.Table:
    """kind, x, label, n, held, weight: at most `sample` distinct rows by hash, as many for each kind and label.

    A weight is the number of candidates a row stands for: its copies times the distinct rows per row chosen.
    """
    distinct = write_table(distinct, "candidates")  # read once for each kind and label
    groups = distinct.groupBy("kind", "label").agg(F.count("*").alias("rows")).collect()
    most = max(1, sample // (2 * len(KINDS)))
    parts = []
    for g in sorted(groups):
        mine = distinct.where((F.col("kind") == g.kind) & (F.col("label") == g.label)).orderBy(F.xxhash64("x", "label"), "x").limit(most)
        weight = F.col("n") * F.lit(g.rows / min(g.rows, most))
        parts.append(_sided(mine).withColumn("weight", weight).toArrow())
    schema = pa.schema([("kind", pa.int32()), ("x", pa.list_(pa.float64())), ("label", pa.float64()), ("n", pa.int64()), ("held", pa.bool_()), ("weight", pa.float64())])
    return pa.concat_tables([t.cast(schema) for t in parts]) if parts else schema.empty_table()


def _cells(rows: DataFrame, selector: Selector) -> DataFrame:
    """kind, cell (of LEVELS that the score reaches), and the held-out weight, its share with label 1 and the number of candidates."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, FEATURES)
            cell = np.searchsorted(LEVELS, selector.score(x), side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(cell, pa.int32()), *(batch.column(c) for c in ("label", "weight", "held", "n"))], ["kind", "cell", "label", "weight", "held", "n"])

    scored = rows.where("held > 0").select("kind", "x", "label", "weight", "held", "n").mapInArrow(score, "kind int, cell int, label double, weight double, held double, n long")
    counted = F.col("weight") * F.col("held")
    return scored.groupBy("kind", "cell").agg(F.sum(counted).alias("all"), F.sum(counted * F.col("label")).alias("right"), F.sum(F.col("n") * F.col("held")).alias("n"))


def fit(docs: DataFrame, sample: int | None = None, precision: float = 0.98, text_col: str = "text", id_col: str = "doc_id") -> Selector:
    """Boosted trees on all distinct candidates of all documents, labelled by strict formats; with `sample` on so many, chosen by hash.

    Labels come from the base formats and `sure`; the trees see only format and context, so their scores carry over to
    candidates that no rule knows. Equal candidates are one row that counts as often as it occurs. Two thirds of the distinct
    rows fit the trees; on the rest each kind gets the smallest threshold (of LEVELS) from which at least `precision` of the
    candidates are labelled 1. Only where a kind has fewer than FEW distinct rows of a label, their copies are split in the
    same shares. A kind with fewer than 50 candidates over its threshold there adds nothing; with fewer than 20 candidates of
    either label no trees are fitted and only base spans count. The rows stay distributed; the driver sees sums by kind and
    label, and by kind and level.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    distinct = distinct_candidates(docs, text_col, id_col)
    if sample is None:
        rows = _sided(write_table(distinct, "candidates")).withColumn("weight", F.col("n").cast("double"))
    else:
        rows = docs.sparkSession.createDataFrame(sampled(distinct, sample))
    groups = rows.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()
    if min(sum(g.n for g in groups if g.label == label) for label in (0, 1)) < 20:
        return Selector()
    split = [(F.col("kind") == g.kind) & (F.col("label") == g.label) for g in groups if g.rows < FEW]
    rows = rows.withColumn("held", F.when(reduce(lambda a, b: a | b, split, F.lit(False)), F.lit(1 / 3)).otherwise(F.col("held").cast("double")))
    share = F.col("weight") * (1 - F.col("held"))
    fitted = rows.where("held < 1")
    total = fitted.agg(F.sum(share).alias("weight"), F.count(F.lit(1)).alias("rows")).first()
    parts = math.ceil(total.rows / ROWS_A_TASK)
    table = fitted.coalesce(parts).sortWithinPartitions("kind", "label", "x")
    table = table.select(array_to_vector("x").alias("features"), "label", (share * F.lit(total.rows / total.weight)).alias("weight"))
    # As many bins as small numbers need: a row of many copies would take all of a few.
    model = GBTClassifier(maxIter=12, maxDepth=4, seed=1, maxBins=256, weightCol="weight").fit(table)
    selector = Selector(tuple((float(w), _node_table(t)) for w, t in zip(model.treeWeights, model.trees, strict=True)))
    cells, limits = _cells(rows, selector).collect(), []  # at most len(LEVELS) rows a kind
    for k in range(len(KINDS)):
        mine = sorted((c for c in cells if c.kind == k), key=lambda c: -c.cell)
        every, right, n = (np.cumsum([c[name] for c in mine]) for name in ("all", "right", "n"))
        good = np.flatnonzero((right >= precision * every - 1e-9) & (n >= 50 - 1e-6))
        limits.append(float(LEVELS[mine[good[-1]].cell]) if len(good) else 2.0)
    return Selector(selector.trees, tuple(limits))


def written(spans: list[Span]) -> str:
    """kind:start:end, by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find(docs: DataFrame, selector: Selector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base (written), spans (base and added, written).

    Null and empty texts have no spans; repeated rows and null ids give a row each.
    """
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every, counts = [], [], []
            for text in batch.column("text"):
                own, added = selector.spans(text.as_py())
                base.append(written(own))
                every.append(written(own + added))
                counts.append([sum(k == kind for k, _, _ in own) for kind in KINDS])
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(base, pa.string()), pa.array(every, pa.string())], names)

    return texts(docs, id_col, text_col).mapInArrow(scan, schema)


def redact(docs: DataFrame, selector: Selector, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The same rows with every span replaced by its kind in angle brackets; of overlapping spans the first to start
    (then the longest) gives the mark and the union is replaced. Null texts stay null; all other columns stay, but
    `length_col`, if named, becomes the new number of code points."""

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        own, added = selector.spans(text)
        parts, at = [], 0
        for kind, start, end in sorted(own + added, key=lambda x: (x[1], -x[2])):
            if start >= at:
                parts += [text[at:start], f"<{kind.upper()}>"]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            new = [clean(t.as_py()) for t in batch.column(k)]
            batch = batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))
            if length_col:
                n = batch.schema.get_field_index(length_col)
                lengths = [old if t is None else len(t) for t, old in zip(new, batch.column(n).to_pylist(), strict=True)]
                batch = batch.set_column(n, batch.schema.field(n), pa.array(lengths, batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(scan, docs.schema)


def personal_data(docs: DataFrame) -> DataFrame:
    """The digest of the whole table: counts and checksum of the base spans, and all spans."""
    found = find(docs, fit(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
