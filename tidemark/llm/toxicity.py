"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding, with exception phrases.

Folding lower-cases, turns look-alike letters into the ones they look like and digits that stand for letters into
those, and parts words by single spaces. A term is the beginning of a word, or a whole one if it ends with a
space, or the beginning of a longer word if it ends with a plus. The weights of hits, one for a word and none inside an exception phrase, are
summed and normalised by length; a logistic curve makes a score of that. Terms, weights and curve are learned from labels.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import crc_fold, dropped, small_batches, staged

#: Labelled documents to learn from and terms at most.
FIT_DOCS, TERMS = 20_000, 1000
#: Candidates that the second step looks at; documents, in as many contexts, that a term must add; how many times as often a toxic document must have
#: it as another, and by which log likelihood ratio; terms that a toxic document should have.
CANDIDATES, GAIN, RATIO, SURE, COVER = 1000, 5, 4.0, 30.0, 8
#: Lengths of beginnings of words.
SHORTEST, LONGEST = 4, 9
#: Entries of a counter of terms before it is handed on.
FLUSH = 100_000

#: Look-alikes of Cyrillic, Greek and other alphabets.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
#: Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clown school", "pond scum", "disgusting taste of medicine")

_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_BETWEEN = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Words with single spaces around; a null text has none."""
    return " " + _BETWEEN.sub(" ", (text or "").lower().translate(_FOLD)).strip() + " "


def _of_word(w: str) -> list[str]:
    """The terms that a word has: itself, its beginnings, and those as beginnings of a longer word."""
    starts = [w[:n] for n in range(SHORTEST, min(LONGEST, len(w)) + 1)]
    return ([w + " "] if len(w) >= SHORTEST else []) + starts + [s + "+" for s in starts if len(s) < len(w)]


def _terms(text: str | None) -> set[str]:
    return {t for w in set(fold(text).split()) for t in _of_word(w)}


def _contexts(text: str | None, place: dict[str, int]) -> dict[int, int]:
    """For each known term of a text a hash of the word before its first place."""
    out: dict[int, int] = {}
    before = ""
    for w in fold(text).split():
        for t in _of_word(w):
            if t in place:
                out.setdefault(place[t], zlib.crc32(before.encode()))
        before = w
    return out


def _sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(y, text) of FIT_DOCS ids at most; of rows that share an id the one whose text has the smallest hash."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    own = own.where(crc_fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id")
    one = both.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    return staged(one.select("y", "text"), "sample")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()

    def rows() -> pd.DataFrame:
        out = pd.DataFrame([(t[1:], c if t[0] == "1" else 0, c if t[0] == "0" else 0) for t, c in seen.items()], columns=["term", "pos", "neg"])
        seen.clear()
        return out

    for batch in batches:
        for y, text in zip(batch.y, batch.text, strict=True):
            seen.update([("1" if y else "0") + t for t in _terms(text)])
            if len(seen) >= FLUSH:
                yield rows()
    yield rows()


class Lexicon:
    """Terms with weights, exceptions and the curve."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, curve: tuple[float, float, float] = (-3.0, 3.0, 0.25)):
        self.weights, self.exceptions, self.curve, self._tree = weights, exceptions, curve, None

    def __getstate__(self) -> tuple:
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state: tuple) -> None:
        (self.weights, self.exceptions, self.curve), self._tree = state, None

    def tree(self):
        if self._tree is None:
            import ahocorasick

            self._tree = ahocorasick.Automaton()
            found: dict[str, list[tuple[bool, float | None]]] = {}
            for t, w in self.weights.items():
                found.setdefault(" " + t.rstrip("+"), []).append((t[-1] == "+", w))
            for e in self.exceptions:
                found.setdefault(f" {' '.join(fold(e).split())} ", []).append((False, None))
            for phrase, own in found.items():
                self._tree.add_word(phrase, (len(phrase), sorted(own, key=lambda x: x[0])))
            self._tree.make_automaton()
        return self._tree

    def hits(self, text: str | None) -> tuple[float, int]:
        """Sum of the weights and number of words."""
        folded = fold(text)
        words = 0 if folded.isspace() else folded.count(" ") - 1
        if not self.weights or words < 1:
            return 0.0, 0
        best: dict[int, tuple[int, float]] = {}
        spared = bytearray(len(folded))
        for end, (size, own) in self.tree().iter(folded):
            start = end - size + 1
            for longer, weight in own:  # of one length, what asks for a longer word comes last
                if weight is None:
                    spared[start:end] = b"\1" * (end - start)
                elif size >= best.get(start, (0, 0.0))[0] and not (longer and folded[end + 1] == " "):
                    best[start] = size, weight
        return sum(w for at, (_, w) in best.items() if not spared[at]), words

    def score(self, text: str | None) -> float:
        total, words = self.hits(text)
        return _curve(self.curve, np.array([total]), np.array([words]))[0]


def _curve(curve: tuple[float, float, float], total: np.ndarray, words: np.ndarray) -> np.ndarray:
    a, b, power = curve
    return 1 / (1 + np.exp(-np.clip(a + b * _normal(total, words, power), -30, 30)))


def _normal(total: np.ndarray, words: np.ndarray, power: float) -> np.ndarray:
    """The sum of weights over a power of the length in hundreds of words, as a logarithm."""
    return np.log1p(total / (1 + words / 100) ** power)


def learned(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Lexicon:
    """A lexicon from labelled rows whose crc32(doc_id as text) mod 5 is not 0, FIT_DOCS of them at most.

    Terms that toxic documents have RATIO times as often as others, beyond chance, are candidates; of these one after the other
    is taken that adds the most, counted by the different words before it, to toxic documents with fewer
    than COVER terms. Copies of a document count as one, so neither they nor chance add terms. The driver sees CANDIDATES terms and, for each toxic
    document of the sample, which of them it has, 8 bytes a pair: 160 MB at the very most.
    """
    small_batches(docs.sparkSession)
    sample = _sample(docs, labels, label)
    counts = sample.mapInPandas(_counted, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    size = sample.agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")).first()
    found, known = [], {}
    if size.pos and size.neg:
        share = size.pos / (size.pos + size.neg)
        sure = f"2 * (pos * ln(pos / ((pos + neg) * {share!r})) + if(neg > 0, neg * ln(neg / ((pos + neg) * {1 - share!r})), 0))"
        few = counts.where(f"pos >= {GAIN} and pos * {float(size.neg)!r} >= {RATIO} * neg * {float(size.pos)!r}").withColumn("sure", F.expr(sure)).where(F.col("sure") >= SURE)
        found = few.orderBy(F.desc(F.round("sure", 6)), F.length("term"), "term").limit(CANDIDATES).collect()
        known = {r.term: (r.pos, r.neg) for r in found}
    place = {t: i for i, t in enumerate(known)}

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_contexts(x, place) for x in batch.text]
            yield pd.DataFrame({"has": [list(x) for x in found], "after": [[v - (1 << 31) for v in x.values()] for x in found]})

    weights: dict[str, float] = {}
    if known:
        bags = sample.where("y = 1").mapInPandas(own, "has array<int>, after array<int>").toArrow()
        weights = _chosen(known, bags, size.pos, size.neg)
    lexicon = Lexicon(weights)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [lexicon.hits(t) for t in batch.text]
            yield pd.DataFrame({"y": batch.y.astype("float64"), "total": [float(x[0]) for x in both], "words": [float(x[1]) for x in both]})

    seen = sample.mapInPandas(features, "y double, total double, words double").toPandas().sort_values(["y", "total", "words"]) if weights else pd.DataFrame()
    if len(seen):
        lexicon.curve = min((_fitted(seen, p) for p in (0.0, 0.25, 0.5)), key=lambda x: x[0])[1]
    dropped(sample)
    return lexicon


def _chosen(known: dict[str, tuple[int, int]], bags: pa.Table, toxic: int, other: int) -> dict[str, float]:
    """Weights of the terms that are taken, in that order, from what each toxic document ``has`` of the known ones and the words ``after`` which it does.

    A document without the label that has a term takes as much from it as it gives, in shares of all such documents, twice over. A weight is the log of how many times as often toxic
    documents have the term.
    """
    has, after = (bags.column(c).combine_chunks() for c in ("has", "after"))
    doc = np.repeat(np.arange(len(has), dtype=np.int32), np.diff(np.asarray(has.offsets)))
    term, context = has.flatten().to_numpy(zero_copy_only=False), after.flatten().to_numpy(zero_copy_only=False)
    by_doc, edge = term.copy(), np.asarray(has.offsets) - has.offsets[0].as_py()
    order = np.argsort(term, kind="stable")
    doc, term, context = doc[order], term[order], context[order]
    first = np.searchsorted(term, np.arange(len(known) + 1))
    full, covered = np.zeros(len(has), bool), np.zeros(len(has), np.int32)

    def gained(t: int) -> int:
        rows = slice(first[t], first[t + 1])
        return len(np.unique(context[rows][~full[doc[rows]]]))

    terms, size, weights = list(known), np.diff(first), {}
    stem = [t.rstrip(" +") for t in terms]
    gain = {t: n for t in range(len(terms)) if size[t] >= GAIN and (n := gained(t)) >= GAIN}
    while gain and len(weights) < TERMS:
        t = max(gain, key=lambda t: (gain[t] - 2 * known[terms[t]][1] * toxic / other, -len(stem[t]), terms[t]))
        # of longer beginnings in nearly all the same documents the longest says it best
        t = max((u for u in gain if stem[u].startswith(stem[t]) and terms[u][-1] != " " and size[u] >= 0.97 * size[t]), key=lambda u: (len(stem[u]), terms[u]), default=t)
        pos, neg = known[terms[t]]
        weights[terms[t]] = float(np.log((pos + 0.5) / toxic) - np.log((neg + 0.5) / other))
        del gain[t]
        own = doc[first[t] : first[t + 1]]
        covered[own] += 1
        # a longer term of the same words says no more
        gain = {u: n for u, n in gain.items() if not stem[u].startswith(stem[t]) and not stem[t].startswith(stem[u])}
        done = own[(covered[own] >= COVER) & ~full[own]]
        if len(done):
            full[done] = True
            for u in np.unique(np.concatenate([by_doc[edge[d] : edge[d + 1]] for d in done.tolist()])).tolist():
                if u in gain:
                    gain[u] = gained(u)
                    if gain[u] < GAIN:
                        del gain[u]
    return weights


def _fitted(seen: pd.DataFrame, power: float) -> tuple[float, tuple[float, float, float]]:
    """Loss and curve of a logistic regression on the normalised sum, by Newton's steps with a small penalty."""
    x, y, p = _normal(seen.total.to_numpy(), seen.words.to_numpy(), power), seen.y.to_numpy(), np.zeros(2)
    x = np.stack([np.ones_like(x), x], 1)
    for _ in range(30):
        s = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        h = x.T @ (x * (s * (1 - s))[:, None]) + np.diag([1e-3, 1e-1])
        p = p + np.linalg.solve(h, x.T @ (y - s) - np.array([1e-3, 1e-1]) * p)
    s = np.clip(1 / (1 + np.exp(-np.clip(x @ p, -30, 30))), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()), (float(p[0]), float(p[1]), power)


def scorer(spark: SparkSession, lexicon: Lexicon):
    """The score of a text column as an expression; a null text scores as an empty one."""
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            both = [own.hits(t) for t in texts]
            yield pd.Series(_curve(own.curve, np.array([x[0] for x in both]), np.array([x[1] for x in both])))

    return F.pandas_udf(run, "double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    A null or empty text, or one without words, has no hits and the score of none. Whole texts are scored, in a time
    in proportion to their length. Equal texts have equal scores, rows that repeat stay as many as they are. Without
    any label no document is toxic. No rows give no rows; other columns are not looked at.
    """
    lexicon = learned(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(docs.sparkSession, lexicon)("text").alias("score"))
    return rows.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
