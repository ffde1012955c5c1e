"""Personal data: rules, and spans that boosted trees add to them.

The rules find e-mail addresses, IP addresses, card and phone numbers. Beside them, generators of high
recall propose spans that look like one of these in disguise ("name [at] host dot org", other
separators, missing signs), which may overlap. Gradient-boosted trees score a proposal by its format,
read after common disguises are undone, and by its surroundings. They learn from proposals of all
documents: those that the rules accept against those that they reject, a bounded number of each kind
and label, drawn by hash. For each kind the threshold is the least score at which the proposals of all
documents, counted by score, have the wanted precision. Of
overlapping proposals the best one is taken; what the rules found always stays.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellwise.llm.base import settled, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Different proposals of a kind and label that the trees learn from, about; drawn by hash from all documents.
TRAIN_EXAMPLES = 2_000
#: Scores are counted in so many bins between 0 and 1.
BINS = 10_000
PRECISION = 0.99
TREES, DEPTH = 12, 3
#: So many endings of addresses are taken from the corpus, by frequency.
ENDINGS = 1_000

Span = tuple[int, int]

# ------------------------------------------------------------------ rules

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin with a number's first digit: from a later one the same follows.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[Span]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
        at = text.find("@", max(free, at + 1))
    return found


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> dict[str, list[Span]]:
    """What the rules find: leftmost, not overlapping within a kind."""
    cards = [(m.span(), _digits(m[0])) for m in _CARD.finditer(text)]
    phones = [(m.span(), len(_DIGIT.findall(m[0]))) for m in _PHONE.finditer(text)] if "+" in text else []
    return {
        "email": _emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split("."))],
        "card": [span for span, digits in cards if 12 <= len(digits) <= 19 and luhn(digits)],
        "phone": [span for span, n in phones if 9 <= n <= 15],
    }


# ------------------------------------------------------------------ proposals

_AT, _DOT = r"(?:@|[(\[{<]\s?at\s?[)\]}>]|\sat\s)", r"(?:\.|[(\[{<]\s?(?:dot|\.)\s?[)\]}>]|\sdot\s)"
_SIGN, _POINT = r"(?:@|[(\[{<]\s?at\s?[)\]}>])", r"(?:\.|[(\[{<]\s?(?:dot|\.)\s?[)\]}>])"
_LIKE_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?{_SIGN}\s?[A-Za-z0-9-]++(?:\s?{_POINT}\s?[A-Za-z0-9-]++)+", re.IGNORECASE)
#: Spelt out. As the words alone mean little, the ending must be one that addresses have.
_SPELT_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)*? dot ([A-Za-z]{2,24})(?![A-Za-z0-9-])(?! dot )", re.IGNORECASE)
#: Endings of addresses that are known without a corpus.
COMMON = frozenset(("com", "org", "net", "edu"))
_LIKE_IP = re.compile(rf"(?<![0-9])[0-9]{{1,4}}+(?:\s?(?:{_DOT}|,)\s?[0-9]{{1,4}}+){{3}}(?![0-9])", re.IGNORECASE)
_LIKE_NUMBER = re.compile(r"(?<![A-Za-z0-9])[+(]{0,2}[0-9](?:[ ().\-/·_]{0,3}[0-9])++(?![A-Za-z0-9])")
_HINT = re.compile(r"(?:mail|contact|write|reach|ip|host|server|address|card|visa|pay|credit|tel|phone|call|mobile|fax)\W*$", re.IGNORECASE)


def proposals(text: str, endings: frozenset[str] = COMMON) -> Iterator[tuple[str, int, int]]:
    """Spans that may be personal data, with their likely kind; they may overlap. endings: those of
    addresses that are spelt out."""
    lower = text.lower()
    if "@" in text or "dot" in lower or ("at" in lower and re.search(r"[(\[{<]\s?at\s?[)\]}>]", lower)):
        yield from (("email", *m.span()) for m in _LIKE_EMAIL.finditer(text))
        yield from (("email", *m.span()) for m in _SPELT_EMAIL.finditer(text) if m[1].lower() in endings)
    if _DIGIT.search(text):
        yield from (("ip", *m.span()) for m in _LIKE_IP.finditer(text))
        for m in _LIKE_NUMBER.finditer(text):
            n = len(_DIGIT.findall(m[0]))
            if 12 <= n <= 19:
                yield "card", *m.span()
            if 7 <= n <= 15:
                yield "phone", *m.span()


FEATURES = 22


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format of a proposal, disguises undone, and its surroundings."""
    raw = text[start:end]
    form = re.sub(rf"\s?{_DOT}\s?", ".", re.sub(rf"\s?{_AT}\s?", "@", raw, flags=re.IGNORECASE), flags=re.IGNORECASE)
    digits = _digits(form)
    parts = re.split(r"[^0-9]+", form.strip("+()"))
    host = form.partition("@")[2].split(".")
    before, after = text[max(0, start - 1):start], text[end:end + 1]
    octets = [int(x) for x in parts if x.isdigit() and len(x) < 6]
    return [float(x) for x in (
        *(kind == k for k in KINDS), len(form), len(digits), len(digits) / max(1, len(form)), form.count("@"), form.count("."),
        form.count("-") + form.count(" "), form.startswith("+"), "(" in form, len(parts), max(map(len, parts)), min(map(len, parts)),
        luhn(digits) if 12 <= len(digits) <= 19 else False, max(octets, default=0) <= 255, len(host), host[-1].isalpha() and len(host[-1]) >= 2,
        before.isalnum(), after.isalnum(), bool(_HINT.search(text[max(0, start - 24):start])))]


# ------------------------------------------------------------------ trees


@dataclass(frozen=True)
class Trees:
    """Boosted trees as plain tuples, a threshold for each kind, and endings of addresses."""

    weights: tuple[float, ...]
    roots: tuple
    thresholds: dict[str, float]
    endings: frozenset[str] = COMMON

    def score(self, values: list[float]) -> float:
        """The probability of personal data."""
        total = 0.0
        for weight, node in zip(self.weights, self.roots, strict=True):
            while len(node) > 1:
                at, limit, left, right = node
                node = left if values[at] <= limit else right
            total += weight * node[0]
        return float(1 / (1 + np.exp(-2 * total)))


def _plain(node) -> tuple:
    if node.subtreeDepth() == 0:
        return (node.prediction(),)
    return node.split().featureIndex(), node.split().threshold(), _plain(node.leftChild()), _plain(node.rightChild())


_DRAWN = "kind string, label double, hash long, values array<double>"
_BITS = 20


def _labelled(text: str, endings: frozenset[str]) -> Iterator[tuple[str, float, int, int]]:
    base = {(kind, *span) for kind, spans in base_spans(text).items() for span in spans}
    for kind, start, end in proposals(text, endings):
        yield kind, float((kind, start, end) in base), start, end


def _examples(most: int, endings: frozenset[str]):
    """Of each kind and label of a task, the proposals with the least hashes."""
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[tuple, list] = {}
        held: dict[tuple, set] = {}
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for kind, label, start, end in _labelled(text, endings):
                    heap, own = heaps.setdefault((kind, label), []), held.setdefault((kind, label), set())
                    hashed = xxhash.xxh3_64_intdigest(f"{doc_id} {kind} {start} {text[start:end]}") >> 1
                    if hashed in own or (len(heap) >= most and hashed > -heap[0][0]):
                        continue
                    own.add(hashed)
                    entry = (-hashed, features(kind, text, start, end))
                    if len(heap) < most:
                        heapq.heappush(heap, entry)
                    else:
                        own.discard(-heapq.heappushpop(heap, entry)[0])
        rows = [(kind, label, -hashed, values) for (kind, label), heap in heaps.items() for hashed, values in heap]
        yield pd.DataFrame(rows, columns=["kind", "label", "hash", "values"])
    return draw


def _endings(rows: DataFrame) -> frozenset[str]:
    """Endings of the addresses that the rules find in rows (doc_id, text), the most frequent ones."""
    found = F.regexp_extract_all("text", F.lit(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*?\.([A-Za-z]{2,24})(?![A-Za-z0-9-]|\.[A-Za-z0-9-])"), 1)
    each = rows.where(F.col("text").contains("@")).select(F.explode(found).alias("ending"))
    counted = each.groupBy(F.lower("ending").alias("ending")).count()
    return COMMON | {r["ending"] for r in counted.orderBy(F.desc("count"), "ending").limit(ENDINGS).collect()}


def _drawn(rows: DataFrame, most: int, endings: frozenset[str]) -> DataFrame:
    """About `most` different proposals of each kind and label of rows (doc_id, text): those with the
    least hashes of all."""
    found = settled(rows.mapInPandas(_examples(most, endings), _DRAWN))
    # No group's rows meet in one task: the limits come from counts of the hashes' leading bits.
    cells = found.select("kind", "label", "hash").distinct().groupBy("kind", "label", F.shiftright("hash", 63 - _BITS).alias("cell")).count()
    reached: Counter = Counter()
    last = {}
    for r in cells.orderBy("kind", "label", "cell").toLocalIterator():
        group = r["kind"], r["label"]
        if reached[group] < most:
            reached[group] += r["count"]
            last[group] = r["cell"]
    wanted = F.lit(False)
    for (kind, label), cell in sorted(last.items()):
        wanted = wanted | ((F.col("kind") == kind) & (F.col("label") == label) & (F.shiftright("hash", 63 - _BITS) <= cell))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.where(wanted).dropDuplicates(["kind", "label", "hash"]).repartition(partitions, "hash").sortWithinPartitions("hash", "kind", "label")


def _bins(trees):
    """How many proposals of a kind, positive or not, score in a bin."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                for kind, label, start, end in _labelled(text, trees.value.endings):
                    total[kind, label, int(trees.value.score(features(kind, text, start, end)) * BINS)] += 1
        yield pd.DataFrame([(*key, n) for key, n in total.items()], columns=["kind", "label", "bin", "n"])
    return count


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_examples: int = TRAIN_EXAMPLES,
        precision: float = PRECISION) -> Trees | None:
    """Trees learned from about train_examples proposals of each kind and label, drawn from all
    documents, with thresholds from all their proposals; None if these show only one class."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    endings = _endings(rows)
    examples = settled(_drawn(rows, train_examples, endings).withColumn("features", array_to_vector("values")))
    if examples.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=32, seed=1).fit(examples.select("label", "features"))
    trees = Trees(tuple(model.treeWeights), tuple(_plain(t._call_java("rootNode")) for t in model.trees), {}, endings)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    counted = rows.select("text").mapInPandas(_bins(shared), "kind string, label double, bin int, n long").groupBy("kind", "label", "bin").agg(F.sum("n").alias("n"))
    # At most BINS + 1 rows of each kind and label, whatever the input's size.
    counts: dict[str, dict[int, list[int]]] = {kind: {} for kind in KINDS}
    for r in counted.collect():
        counts[r["kind"]].setdefault(r["bin"], [0, 0])[int(r["label"])] += r["n"]
    return Trees(trees.weights, trees.roots, {kind: _threshold(counts[kind], precision) for kind in KINDS}, endings)


def _threshold(counts: dict[int, list[int]], precision: float) -> float:
    """The least score from which on at least `precision` of all proposals (numbers of negative and
    positive ones by bin) are positive; never under one half, and out of reach without positives."""
    best, wrong, right = 2.0, 0, 0
    for place in sorted(counts, reverse=True):
        wrong, right = wrong + counts[place][0], right + counts[place][1]
        if right and place >= BINS // 2 and right >= precision * (wrong + right):
            best = place / BINS
    return best


class _Taken:
    """Spans, as disjoint intervals in order."""

    def __init__(self, spans) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)  # of those that start before the end, the last one ends last
        return at > 0 and self.ends[at - 1] > start

    def add(self, start: int, end: int) -> None:
        """A span that meets none."""
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def added_spans(text: str, base: dict[str, list[Span]], trees: Trees | None) -> list[tuple[str, int, int]]:
    """Proposals that pass their threshold, best first, without overlap with what was taken."""
    if trees is None:
        return []
    taken = _Taken(span for spans in base.values() for span in spans)
    known = {(kind, *span) for kind, spans in base.items() for span in spans}
    scored = []
    for kind, start, end in proposals(text, trees.endings):
        if (kind, start, end) not in known and not taken.meets(start, end):
            score = trees.score(features(kind, text, start, end))
            if score >= trees.thresholds[kind]:
                scored.append((-score, start, -end, kind))
    out = []
    for _, start, end, kind in sorted(scored):
        if not taken.meets(start, -end):
            taken.add(start, -end)
            out.append((kind, start, -end))
    return out


# ------------------------------------------------------------------ operator

_SPAN = "array<struct<kind: string, start: int, end: int>>"


def _finder(trees):
    def ordered(spans):
        return [{"kind": k, "start": s, "end": e} for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base, spans = [], []
            for text in batch["text"]:
                rules = base_spans(text)
                certain = [(kind, *span) for kind, found in rules.items() for span in found]
                base.append(ordered(certain))
                spans.append(ordered(certain + added_spans(text, rules, trees.value)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "base": base, "spans": spans})
    return find


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_examples: int = TRAIN_EXAMPLES,
                  precision: float = PRECISION) -> DataFrame:
    """One row per row of docs: doc_id, base (spans of the rules), spans (these and the added ones);
    a span has kind, start, end in code points, ordered by start and kind.

    A null text counts as empty. Rows that repeat get a row each. Other columns are not read.
    """
    trees = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, train_examples, precision))
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = rows.mapInPandas(_finder(trees), f"doc_id string, base {_SPAN}, spans {_SPAN}")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
