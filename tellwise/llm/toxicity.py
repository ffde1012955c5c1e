"""Toxicity through a noisy channel.

A writer who hides a word replaces letters by look-alikes, puts blanks or dots between letters, or
repeats letters. Every token that holds a look-alike or a doubled letter becomes a lattice, with and
without the signs around it: each character may stand for several letters, for a word's end, or for
nothing, each at a price. Viterbi's algorithm finds the cheapest reading under the prices and a
character trigram model, and the score counts the words of the text as written and as restored. A
token is read once in a task and remembered.

The trigram model is counted over all documents. The classifier (logistic regression over words and
word beginnings that tell toxic from other texts) is fitted on at most about `TRAIN_ROWS` labelled
rows. Labels are the only thing it learns from; language, source and id are no features.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellwise.llm.base import settled, text_or_empty

#: The labelled rows that the classifier is fitted on: about so many, chosen by hash.
TRAIN_ROWS = 40_000
#: Features of the classifier: so many at most, the most telling ones.
FEATURES = 2_000
BEGINNINGS = (4, 5, 6, 7)
#: A beginning counts once, and again from so many different words on.
STEPS = (2, 3)
#: Words and parts whose readings a task remembers.
REMEMBERED = 200_000

# ------------------------------------------------------------------ letters

#: The euro sign's code in a plain text: the currency sign, which becomes "?" itself.
EURO = "\xa4"
#: Characters that pass for letters.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", EURO: "e", "£": "l", "¡": "i",
}
#: Letters of other scripts that look like Latin ones, for words that mix both.
_TWINS = str.maketrans("абеорсухікѕјһмтнвдгпοαεικρτυνχγ", "abeopcyxiksjhmthbdrnoaeikptuvxy")
_EDGE = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()) + EURO + "£¡"
_BASE = {}
for _c in range(0xC0, 0x250):
    if (_letter := unicodedata.normalize("NFKD", chr(_c))[0].lower()).isascii() and _letter.isalpha():
        _BASE[_c] = _letter
_BASE |= {ord("ß"): "s", ord("æ"): "a", ord("œ"): "o", ord("ø"): "o", ord("ł"): "l", ord("đ"): "d"}
_LATIN1 = bytes(c if c < 0x80 or chr(c) in "£¡" else ord(_BASE.get(c, "?")) for c in range(256))
SYMBOLS = 28  # word end, a to z, anything else


class _Plain(dict):
    """What plain() makes of a character's code."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if code < 256:
            out = chr(_LATIN1[code])
        elif char == "€":
            out = EURO
        elif code in _BASE:
            out = _BASE[code]
        elif unicodedata.combining(char) and code < 0x370:
            out = ""
        else:
            first = unicodedata.normalize("NFKD", char)[0].lower()
            kind = unicodedata.category(char)[0]
            out = first if first.isascii() and first.isalnum() else " " if char.isspace() else char if kind in "LM" else "?"
        self[code] = out
        return out


_PLAIN = _Plain()


def plain(text: str) -> str:
    """Lower case, Latin letters without their accents. Letters of other scripts stay, the euro sign
    becomes `EURO`, pound and inverted exclamation mark stay; other characters beyond ASCII become "?"."""
    text = text.lower()
    if text.isascii():
        return text
    try:
        return text.encode("latin-1").translate(_LATIN1).decode("latin-1")
    except UnicodeEncodeError:
        return text.translate(_PLAIN)


_CODE = np.full(256, SYMBOLS - 1, np.int64)
_CODE[[0x20, *range(0x09, 0x0E)]] = 0
_CODE[ord("a"):ord("z") + 1] = np.arange(1, 27)


def _trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(SYMBOLS ** 3, np.int64)
    for batch in batches:
        for text in batch["text"]:
            codes = _CODE[np.frombuffer(f"  {plain(text)} ".encode("latin-1", "replace"), np.uint8)]
            total += np.bincount((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:], minlength=SYMBOLS ** 3)
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"trigram": seen, "n": total[seen]})


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-probabilities of a symbol after two others, from the trigrams of all docs. A null text
    counts as empty. The result has 28 cubed numbers whatever the input's size."""
    counted = (docs.select(text_or_empty(text_col).alias("text")).mapInPandas(_trigrams, "trigram int, n long")
               .groupBy("trigram").agg(F.sum("n").alias("n")))
    counts = np.zeros(SYMBOLS ** 3)
    for row in counted.toLocalIterator():
        counts[row["trigram"]] = row["n"]
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    shorter = counts.sum(0) + 0.5
    shorter /= shorter.sum(1, keepdims=True)
    return np.log((counts + 20 * shorter) / (counts.sum(2, keepdims=True) + 20))


# ------------------------------------------------------------------ channel

_JOINED, _ENDED, _DOUBLED, _REPEATED, _NOISE = np.log([0.65, 0.35, 0.1, 0.5, 1e-5])
_TRIPLES = tuple(3 * chr(c) for c in range(ord("a"), ord("z") + 1))
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]{1,3}\S){2,}(?!\S)")
_WORDS = re.compile("[a-z\u0100-\U0010ffff]+")
_LATIN = re.compile("[a-z]")
_SHAPE = bytes(0x20 if c == 0x20 or 0x09 <= c <= 0x0D else 0x78 for c in range(256))
_APART = (b" x x x ", b" x  x  x ", b" x   x   x ")


def _readings(char: str, run: int) -> list[tuple[str, float]]:
    """What a character may stand for, with log-probabilities. run: how long the run of the same
    character is, negative at its first one."""
    again = [("", _REPEATED if run > 2 else _DOUBLED)] if run > 1 else []
    if "a" <= char <= "z" or char > "\xff":
        return [(char, 0.0), *again]
    if char in LOOKALIKES:
        share = -np.log(len(LOOKALIKES[char]))
        return [(x, share) for x in LOOKALIKES[char]] + (again or [("", _NOISE)]) + [(" ", _NOISE)]
    return [("", _JOINED), (" ", _ENDED)]


def _runs(text: str) -> list[int]:
    lengths = []
    for same in re.finditer(r"(.)\1*", text, re.DOTALL):
        n = len(same[0])
        lengths += [-n] + [n] * (n - 1)
    return lengths


def restore(observed: str, model: np.ndarray | list[float]) -> str:
    """The likeliest text behind an observed one (lower case, no accents); model may be flat."""
    flat = model if isinstance(model, list) else model.ravel().tolist()
    best = {(0, 0): (0.0, "")}
    for char, run in zip(observed, _runs(observed), strict=True):
        new: dict = {}
        for (a, b), (score, text) in best.items():
            for out, price in _readings(char, run):
                if out:
                    code = 0 if out == " " else min(ord(out) - 96, SYMBOLS - 1)
                    state, value = (b, code), score + price + flat[(a * SYMBOLS + b) * SYMBOLS + code]
                else:
                    state, value = (a, b), score + price
                if state not in new or value > new[state][0]:
                    new[state] = (value, text + out)
        best = new
    return max((score + flat[(a * SYMBOLS + b) * SYMBOLS], text) for (a, b), (score, text) in best.items())[1]


def undoubled(word: str, flat: list[float]) -> str:
    """restore() for a word of a to z without a run of three: the signs after the next one are the same
    on both paths, so each doubled letter is decided alone."""
    codes = [0, *(ord(c) - 96 for c in word), 0]
    out, last = [], 0
    for same in _DOUBLE.finditer(word):
        at = same.start()
        before, own, after = codes[at], codes[at + 1], codes[at + 3]
        base = (before * SYMBOLS + own) * SYMBOLS
        if flat[base + own] + flat[(own * SYMBOLS + own) * SYMBOLS + after] < _DOUBLED + flat[base + after]:
            out.append(word[last:at + 1])
            last = at + 2
    return "".join(out) + word[last:]


#: Signs around a word that are rarely a letter of it; the others may well stand for its first one.
_OUTER = "".join(c for c in _EDGE if c not in "$@!|")
#: Signs that never stand for a letter.
_NEVER = "".join(c for c in _EDGE if c not in LOOKALIKES)
_DOUBLE = re.compile(r"([a-z])\1")
_TRIPLE = re.compile(r"([a-z])\1\1")
_LOOK = re.compile("[" + re.escape("".join(LOOKALIKES)) + "]")
_LETTER_OR_SIGN = re.compile("[a-z" + re.escape("".join(c for c in LOOKALIKES if not c.isdigit())) + "]")


def _cores(token: str) -> list[str]:
    """A token without signs around it, and, if signs that pass for letters begin it, with these."""
    core = token.strip(_EDGE)
    whole = token.lstrip(_OUTER).rstrip(_EDGE)
    return [core] if core == whole else [core, whole]


def doubtful_parts(token: str) -> list[str]:
    """What a token may be if its outer signs, each side's, are letters or are not, where that holds
    a look-alike or a doubled letter. Numbers, without a letter or a sign, are numbers."""
    left, right = token.lstrip(_EDGE), token.lstrip(_NEVER)
    forms = dict.fromkeys(x.rstrip(signs) for x in (left, right) for signs in (_EDGE, _NEVER))
    return [x for x in forms if len(x) > 2 and (_DOUBLE.search(x) or _LOOK.search(x) and _LETTER_OR_SIGN.search(x))]


def hidden_parts(text: str) -> list[str]:
    """Parts of a plain text that show clear signs of hiding: signs or digits inside a word, before it
    or digits after it, tripled letters, all letters doubled, letters set apart."""
    tokens = set(text.split())
    odd = [token for token in tokens if not token.isalpha() and len(token) > 2]
    parts = [core for token in odd for core in _cores(token) if len(core) > 2 and not core.isalpha() and _WORDS.search(core)]
    if any(triple in text for triple in _TRIPLES):
        parts += [token for token in tokens if token.isalpha() and any(triple in token for triple in _TRIPLES)]
    parts += [token[::2] for token in tokens if token[:1] == token[1:2] and len(token) > 5 and token[::2] == token[1::2]]
    return parts + spaced_parts(text)


def spaced_parts(text: str) -> list[str]:
    """Letters set apart by blanks."""
    shape = b" %b " % text.encode("latin-1", "replace").translate(_SHAPE)
    return _SPACED.findall(text) if any(apart in shape for apart in _APART) else []


class Reader:
    """Words of a text, as written and as restored; those of a token or part are remembered for a while.

    With `wanted` features only words that may have one of them are told: wanted whole words, and those
    that begin like a wanted beginning. The others have no part in any wanted feature, and as most
    tokens have no other words, these are remembered as a set, which a text's tokens are freed of at once."""

    def __init__(self, model: np.ndarray, wanted: Iterable[str] | None = None) -> None:
        self.flat = model.ravel().tolist()
        self.known: dict[str, tuple[str, ...]] = {}
        self.silent: set[str] = set()
        self.whole = None if wanted is None else frozenset(x for x in wanted if "-" not in x)
        self.first = None if wanted is None else frozenset(x[:BEGINNINGS[0]] for x in wanted if "-" in x)

    def _read(self, token: str) -> Iterable[str]:
        core = token.strip(_NEVER)
        if core.isascii() and core.isalpha():  # most tokens
            if not _DOUBLE.search(core):
                return (core,)
            if not _TRIPLE.search(core):
                words = {core, undoubled(core, self.flat)}
                if len(core) > 5 and core[::2] == core[1::2]:
                    words.update(restore(core[::2], self.flat).split())
                return words
        latin = token if token.isascii() or not _LATIN.search(token) else token.translate(_TWINS)
        words = {*_WORDS.findall(token), *_WORDS.findall(latin)}
        for part in {*hidden_parts(latin), *doubtful_parts(latin)}:
            words.update(restore(part, self.flat).split())
        return words

    def _remember(self, token: str) -> tuple[str, ...]:
        found = tuple(self._read(token))
        if self.whole is not None:
            found = tuple([w for w in found if w in self.whole or w[:BEGINNINGS[0]] in self.first])
        if len(self.known) + len(self.silent) >= REMEMBERED:
            self.known.clear()
            self.silent.clear()
        if found:
            self.known[token] = found
        else:
            self.silent.add(token)
        return found

    def words(self, text: str) -> set[str]:
        text = plain(text)
        known, words = self.known, set()
        for token in {*text.split(), *spaced_parts(text)} - self.silent:
            found = known.get(token)
            words.update(self._remember(token) if found is None else found)
        return words


def _beginnings(words: set[str]) -> Iterator[str]:
    for n in BEGINNINGS:
        yield from [word[:n] for word in words if len(word) > n]


def features(words: set[str]) -> set[str]:
    """Whole words; beginnings of longer ones (marked by a hyphen); beginnings that several words
    of the text share (with the number of words)."""
    found = set(words)
    for start, n in Counter(_beginnings(words)).items():
        found.add(f"{start}-")
        found.update(f"{start}-{step}" for step in STEPS if n >= step)
    return found


# ------------------------------------------------------------------ classifier


@dataclass
class Classifier:
    bias: float
    weights: dict[str, float]
    #: The beginnings with a weight, of words met so far.
    begun: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def score(self, words: set[str]) -> float:
        weights = self.weights
        found = [word for word in words if word in weights]
        begun = self.begun
        if len(begun) > REMEMBERED:
            begun.clear()
        for word in [word for word in words if word not in begun]:
            begun[word] = tuple(filter(self.starts.__contains__, _beginnings({word})))
        for start, n in Counter(start for word in words for start in begun[word]).items():
            found += [f"{start}-"] + [f"{start}-{step}" for step in STEPS if n >= step]
        total = self.bias + sum(weights.get(feature, 0.0) for feature in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))

    @cached_property
    def starts(self) -> frozenset[str]:
        return frozenset(x.partition("-")[0] for x in self.weights if "-" in x)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def _feature_counter(model, names=None):
    """Counts in how many texts a feature is; with names, only these."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, total = Reader(model.value, names and names.value), Counter()
        for batch in batches:
            for text in batch["text"]:
                own = features(reader.words(text))
                total.update(own if names is None else own & names.value)
                if len(total) > 300_000:
                    yield pd.DataFrame({"feature": pd.Series(list(total), dtype=object), "n": list(total.values())})
                    total.clear()
        yield pd.DataFrame({"feature": pd.Series(list(total), dtype=object), "n": list(total.values())})
    return count


def _found_features(model, names):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, known = Reader(model.value, names.value), names.value
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "found": [sorted(known[x] for x in features(reader.words(text)) if x in known) for text in batch["text"]]})
    return find


def _fitted(rows: list[tuple[int, list[int]]], names: list[str], ridge: float = 0.1, rounds: int = 400) -> Classifier:
    """Logistic regression with a ridge penalty, by Adam's steps."""
    label = np.array([r[0] for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    column = np.array([x for r in rows for x in r[1]], np.int64)
    bias, weights = float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1))), np.zeros(len(names))
    first, second = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, rounds + 1):
        margin = bias + np.bincount(row, weights[column], len(label))
        error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - label
        slope = np.concatenate(([error.sum()], np.bincount(column, error[row], len(names)) + ridge * weights)) / max(1, len(label))
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope ** 2
        move = 0.1 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-9)
        bias, weights = bias - move[0], weights - move[1:]
    return Classifier(float(bias), {name: float(w) for name, w in zip(names, weights, strict=True) if abs(w) > 1e-3})


def fit(docs: DataFrame, labels: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Classifier:
    """A classifier from labels (doc_id, toxic) of docs that aren't held out.

    model is the broadcast language model. Labels that are null, not 0 or 1, or without a document
    are not used. Without labelled rows every score is one half. About train_rows labels are used,
    drawn by a hash of their ids.
    """
    context = docs.sparkSession.sparkContext
    known = (labels.where("toxic in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("label"))
             .where(F.col("_id").isNotNull() & ~held_out(F.col("_id"))))
    share = min(1.0, train_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text"))
    # The drawn labels are about train_rows pairs of numbers, whatever the input's size.
    sample = settled(rows.join(F.broadcast(drawn), "_id").select("text", "label"))
    totals = dict(sample.groupBy("label").count().collect())
    n_clean, n_toxic = totals.get(0, 0) + 1.0, totals.get(1, 0) + 1.0

    def counted(label: int, names=None) -> DataFrame:
        return (sample.where(F.col("label") == label).select("text").mapInPandas(_feature_counter(model, names), "feature string, n long")
                .groupBy("feature").agg(F.sum("n").alias("n")))

    # All features of a bounded number of texts are a bounded number, too.
    toxic = dict(counted(1).where("n >= 4").collect())
    clean = dict(counted(0, context.broadcast(frozenset(toxic))).collect())
    rate = n_toxic / (n_clean + n_toxic)

    def telling(feature: str) -> float:
        both = toxic[feature] + clean.get(feature, 0)
        return (toxic[feature] - both * rate) / math.sqrt(both * rate * (1 - rate))

    ranked = sorted(((telling(feature), feature) for feature in toxic), reverse=True)
    names = sorted(feature for value, feature in ranked[:FEATURES] if value >= 5)
    index = context.broadcast({name: i for i, name in enumerate(names)})
    # Labels and a few feature numbers of a bounded sample come to the driver.
    found = sample.mapInPandas(_found_features(model, index), "label int, found array<int>").collect()
    return _fitted([(r["label"], r["found"]) for r in found], names)


def _scorer(model, classifier):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, fitted = Reader(model.value, classifier.value.weights), classifier.value
        for batch in batches:
            yield batch.drop(columns="text").assign(score=[fitted.score(reader.words(text)) for text in batch["text"]])
    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    A null text counts as empty; an empty text gets the score of one without telling words. Rows
    that repeat get a row each. Other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    model = context.broadcast(language_model(docs, text_col))
    classifier = context.broadcast(fit(docs, labels, model, id_col, text_col, train_rows))
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    scored = rows.mapInPandas(_scorer(model, classifier), "doc_id string, score double")
    doc_id = F.col("doc_id").cast(docs.schema[id_col].dataType)
    return scored.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **how) -> DataFrame:
    """docs, all columns, without those whose score reaches the threshold. A null text counts as empty;
    rows that repeat stay or go together; columns may have any names; no rows give no rows. Without
    labels every score is one half, so the default threshold drops all and one above it none."""
    context = docs.sparkSession.sparkContext
    model = context.broadcast(language_model(docs, text_col))
    classifier = context.broadcast(fit(docs, labels, model, id_col, text_col, **how))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        reader, fitted = Reader(model.value, classifier.value.weights), classifier.value
        return texts.map(lambda text: fitted.score(reader.words(text)))

    return docs.where(score(text_or_empty(text_col)) < threshold)
