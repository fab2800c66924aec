"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w . x - t_k) with one vector of weights for all thresholds t_1 < t_2 < ...; the expected
severity is the sum of these probabilities. Features of a text are the words it has and their beginnings (so that an
inflected form counts as well), each 0 or 1, and one number, the share of words that are cues.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)


def word_features(word: str) -> list[str]:
    return [word, *[f"{word[:k]}*" for k in PREFIXES if len(word) > k]]


def text_features(words: Iterable[str], known: Callable[[str], Iterable[str]] = word_features) -> set[str]:
    """Features of distinct words: each word, each beginning, and with a second star those that two words have."""
    seen: set[str] = set()
    for w in words:
        for f in known(w):
            seen.add(f"{f}*" if f in seen and f[-1] == "*" else f)
    return seen


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Model:
    """Weights by feature, that of the share of cues, thresholds in rising order."""

    weights: dict[str, float] = field(default_factory=dict)
    share: float = 0.0
    thresholds: list[float] = field(default_factory=list)
    cues: dict[str, float] = field(default_factory=dict)
    _known: dict[str, tuple[float, float, tuple[str, ...]]] = field(default_factory=dict, repr=False)

    def _look(self, word: str) -> tuple[str, ...]:
        got = self._known.get(word)
        if got is None:
            if len(self._known) > 500_000:
                self._known.clear()
            got = self._known[word] = tuple(f for f in word_features(word) if f in self.cues or f"{f}*" in self.cues)
        return got

    def severity(self, text: str | None) -> float:
        counts = Counter(words_of(text))
        seen = text_features(counts, self._look)
        cues = cue_words(counts, seen, self.cues, self._look)
        n = sum(counts.values())
        z = sum(self.weights.get(f, 0.0) for f in sorted(seen)) + self.share * share_value(cues, n)
        return float(sum(1.0 / (1.0 + np.exp(min(50.0, max(-50.0, t - z)))) for t in self.thresholds))


def cue_words(counts: Counter, seen: set[str], cues: dict[str, float], known: Callable[[str], Iterable[str]] = word_features) -> int:
    """How many words of a text are cues, or begin as a cue does."""
    return sum(m for w, m in counts.items() if any(f in cues or (f[-1] == "*" and f"{f}*" in cues and f"{f}*" in seen) for f in known(w)))


def share_value(cues: int, words: int) -> float:
    return float(np.log1p(100.0 * cues / words)) if words else 0.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, grades: np.ndarray, n_features: int, l1: float = 2e-4, steps: int = 250, rate: float = 0.3) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, weight of the dense column, thresholds: proximal Adagrad on the likelihood of grades 0..K.

    Thresholds are a first one and positive gaps, so they stay in order. Rows weigh alike: a text without cues is as likely toxic as in the sample.
    """
    n, top = len(grades), int(grades.max(initial=0))
    w, v, first, gaps = np.zeros(n_features), 0.0, 0.0, np.zeros(max(0, top - 1))
    held = [np.full(n_features, 1e-8), 1e-8, 1e-8, np.full(len(gaps), 1e-8)]
    weight = np.full(n, 1.0 / max(1, n))
    for _ in range(steps):
        z = np.bincount(rows, w[cols], n) + v * dense
        t = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])[:top]
        above = _sigmoid(z[:, None] - t)  # P(grade > k)
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        p = np.maximum(edge[np.arange(n), grades] - edge[np.arange(n), grades + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
        hi, lo = slope[np.arange(n), grades], slope[np.arange(n), grades + 1]
        gz = -weight * (hi - lo) / p
        gt = np.zeros(top)
        np.add.at(gt, np.maximum(grades - 1, 0), np.where(grades > 0, weight * hi / p, 0.0))
        np.add.at(gt, np.minimum(grades, top - 1), np.where(grades < top, -weight * lo / p, 0.0))
        grads = [np.bincount(cols, gz[rows], n_features), float(gz @ dense), float(gt.sum()), np.cumsum(gt[::-1])[::-1][1:] * np.exp(gaps)]
        held = [h + g * g for h, g in zip(held, grads, strict=True)]
        step = rate / np.sqrt(held[0])
        w = w - step * grads[0]
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0.0)
        v = max(0.0, v - rate / np.sqrt(held[1]) * grads[1])
        first -= rate / np.sqrt(held[2]) * grads[2]
        gaps = np.clip(gaps - rate / np.sqrt(held[3]) * grads[3], -6, 4)
    return w, v, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])[:top]


def _sketch(words: Iterable[str]) -> tuple[int, ...]:
    """Three minima of hashes of the words: near copies mostly have the same."""
    return tuple(min((zlib.crc32(w.encode(), seed) for w in words), default=0) for seed in (1, 2, 3))


def _surprise(a: float, n: float, b: float, m: float) -> float:
    """Likelihood ratio statistic of a hits in n rows against b in m."""
    rate = (a + b) / (n + m)
    return 2.0 * sum(x * np.log(x / e) for x, e in ((a, n * rate), (n - a, n * (1 - rate)), (b, m * rate), (m - b, m * (1 - rate))) if x > 0 and e > 0)


def train(texts: Iterable[str | None], grades: Iterable[int], ratio: float = 20.0, max_features: int = 20_000, levels: int = 1) -> Model:
    """Fits texts with grades 0, 1, ...

    Features are those that stand `ratio` times as often in texts above grade 0 as in others, by more than chance
    gives the most striking of so many; near copies of one grade count once here. They are the cues. With `levels`
    above 1 and grades that are only 0 and 1, grade 1 is split by the share of words that are cues, into that many
    grades with as many rows each. One grade only, no rows or no cues: severity 0.
    """
    texts = list(texts)
    y = np.array(list(grades), np.int64)
    if len(y) == 0 or y.max() == 0:
        return Model()
    memo: dict[str, list[str]] = {}

    def known(word: str) -> list[str]:
        if len(memo) > 10_000:
            memo.clear()
        return memo.get(word) or memo.setdefault(word, word_features(word))

    # Texts are read twice, and the features of one text are held at a time: a set of all would take too much memory.
    low, high, n0, n1 = Counter(), Counter(), 0, 0
    once: set[tuple] = set()
    for t, g in zip(texts, y, strict=True):
        words = set(words_of(t))
        mark = (min(g, 1), *_sketch(words))
        if mark in once:
            continue
        once.add(mark)
        (high if g else low).update(text_features(sorted(words), known))
        n0, n1 = n0 + (g == 0), n1 + (g > 0)
    limit = 2.0 * np.log(max(2, len(high))) + 1.0
    lift = {f: _surprise(c, n1, low[f], n0) for f, c in high.items() if c * max(1, n0) >= ratio * (low[f] + 0.5) * n1}
    names = [f for f in sorted(lift, key=lambda f: (-lift[f], f)) if lift[f] > limit][:max_features]
    if not names:
        return Model()
    index, cues = {f: k for k, f in enumerate(names)}, dict.fromkeys(names, 1.0)
    del low, high
    own, rates = [], np.zeros(len(y))
    for i, t in enumerate(texts):
        c = Counter(words_of(t))
        seen = text_features(c, known)
        own.append(sorted(index[f] for f in seen if f in index))
        rates[i] = share_value(cue_words(c, seen, cues, known), sum(c.values()))
    rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
    cols = np.array([k for x in own for k in x], np.int64)
    if levels > 1 and y.max() == 1:
        hit = np.flatnonzero((y == 1) & (rates > 0))
        y = y.copy()
        if len(hit):
            y[hit] = 1 + np.searchsorted(np.quantile(rates[hit], np.arange(1, levels) / levels), rates[hit], "right")
        y = np.unique(y, return_inverse=True)[1].astype(np.int64)
    w, v, t = fit_ordinal(rows, cols, rates, y, len(names))
    return Model({names[k]: float(w[k]) for k in np.flatnonzero(np.abs(w) > 1e-3)}, float(v), [float(x) for x in t], cues)


def sample(docs: DataFrame, labels: DataFrame, grade: Column, per_grade: int, grades: int) -> DataFrame:
    """Up to `per_grade` labelled rows of each grade, the same ones on every run: those with the least hashes."""
    rows = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__d"), grade.alias("__g")).where("__g IS NOT NULL").groupBy("__d").agg(F.max("__g").alias("__g"))
    taken = None
    for g in range(grades):
        own = rows.where(F.col("__g") == g).orderBy(F.xxhash64("__d"), "__d").limit(per_grade)
        taken = own if taken is None else taken.unionByName(own)
    return docs.select("doc_id", "text").join(F.broadcast(taken), F.col("doc_id") == F.col("__d")).select("text", F.col("__g").alias("grade"), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, per_grade: int = 3000, levels: int = 3) -> Model:
    """The model for labels toxic 0, 1, ..., from at most `per_grade` labelled documents of each: the bound of the fit.

    One task fits these rows, so their texts and features take no memory of the driver, which gets the model only.
    Labels that are null or below 0, name no document or name one twice: left out, left out, the higher counts.
    Labels above `levels` count as that grade; if none is above 1, grade 1 is split into `levels` grades (`train`).
    """
    rows = sample(docs, labels, F.least(F.col("toxic").cast("int"), F.lit(levels)), per_grade, levels + 1)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [row for batch in source for row in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
        got.sort(key=lambda r: (r[2], r[0] or ""))
        if got:
            model = train([r[0] for r in got], [r[1] for r in got], levels=levels)
            yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    fitted = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(fitted[0].model)) if fitted else Model()


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Documents with severity, and toxic: whether it is at least the threshold. Null and empty texts have no words."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in source:
            at = batch.num_columns - 1
            s = np.array([model.severity(t) for t in batch.column(at).to_pylist()], np.float64)
            yield pa.record_batch([*batch.columns[:at], pa.array(s), pa.array(s >= threshold)], [*batch.schema.names[:at], "__severity", "__toxic"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("text").alias("__text"))
    return rows.mapInArrow(run, f"{shape}, __severity double, __toxic boolean")


def severity_report(docs: DataFrame, labels: DataFrame, per_grade: int = 3000, levels: int = 3, threshold: float = 0.5) -> DataFrame:
    """doc_id, severity, toxic for every row of documents.

    Null, empty and blank texts have no words and severity 0; whole texts count, however long. Repeated rows and ids,
    null ones too, come back as often as they stand, each by its own text; columns beyond doc_id and text are left
    out. Empty or all-null labels, or labels of one grade, leave no model: severity 0. No documents: no rows.
    """
    model = fit(docs, labels, per_grade, levels)
    out = score(docs.select("doc_id", "text"), model, threshold)
    return out.select("doc_id", F.col("__severity").alias("severity"), F.col("__toxic").alias("toxic"))


def reject_toxic(docs: DataFrame, labels: DataFrame, per_grade: int = 3000, levels: int = 3, threshold: float = 0.5) -> DataFrame:
    """Documents below the threshold, with all their columns, whatever these are named.

    Cases are those of `severity_report`: texts without words stay, repeated rows and ids are judged by their own
    texts, and without a model all documents stay.
    """
    return score(docs, fit(docs, labels, per_grade, levels), threshold).where("NOT __toxic").drop("__severity", "__toxic")
