"""Toxicity by multiple-instance learning.

A document is a bag of sentences (cut at . ! ? and line ends).  A sentence's score is a logistic function of its words'
weights; the document's score is the noisy-or of its sentences, 1 - prod(1 - p).  Only document labels train it: the
gradient of the document likelihood reaches each sentence in proportion to its own score, so weight gathers on the
sentences that explain the label.  A fifth of the sample, kept aside, calibrates the scores (Platt scaling of their
log-odds).  The same sentence scores, calibrated alike, locate the offending sentences.

A word (letters, digits, underscores; lower case) has four hashed features: itself and its first 4, 5 and 6 characters.
Training takes at most ``max_docs`` labelled documents (half of them, at most, of each class), chosen by hash; a hash
also says which are kept aside, so the same rows give the same model however they are partitioned.  Scoring
covers every sentence of every text; a word's weight is looked up in a bounded cache in each worker.

Nulls and texts without words score 0.  Labels that are null are not learned from.  With no labels of both classes the
score is 0 throughout.  Repeated documents get equal scores; an empty table gives no rows.  Of several labels of a
document the greatest counts.  Columns of other names are ignored; a very long text is held by one task.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize

BUCKETS = 1 << 18
CACHE = 300_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def word_features(word: str) -> list[int]:
    w = word.encode()
    return [zlib.crc32(b"w" + w) % BUCKETS, *(zlib.crc32(b"%d" % n + word[:n].encode()) % BUCKETS for n in (4, 5, 6) if len(word) >= n)]


def sentences(text: str | None) -> list[list[str]]:
    return [w for s in _SENTENCE.split((text or "").lower()) if (w := _WORD.findall(s))]


class Bags:
    """Bags of sentences end to end: all features, how many each sentence has, how many sentences each document."""

    def __init__(self, features: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> None:
        self.features, self.sizes, self.counts = features, sizes, counts

    @classmethod
    def of(cls, bags: list[list[list[int]]]) -> Bags:
        lists = [np.asarray(s, np.int32) for b in bags for s in b]
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        return cls(flat, np.array([len(x) for x in lists], np.int64), np.array([len(b) for b in bags], np.int64))

    def blocks(self, most: int = 1 << 20) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Runs of sentences of ``most`` features, or one sentence: (the run, its features, each one's sentence in the run)."""
        ends, first = np.cumsum(self.sizes), 0
        while first < len(ends):
            start = ends[first] - self.sizes[first]
            last = max(first + 1, int(np.searchsorted(ends, start + most, "right")))
            yield slice(first, last), self.features[start : ends[last - 1]], np.repeat(np.arange(last - first, dtype=np.int32), self.sizes[first:last])
            first = last

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Each sentence's sum of its features' weights."""
        z = np.zeros(len(self.sizes))
        for run, features, sent in self.blocks():
            z[run] = np.bincount(sent, weights[features], run.stop - run.start)
        return z

    def documents_with(self) -> np.ndarray:
        """How many documents each feature occurs in."""
        held = np.zeros(BUCKETS, np.int32)
        sentence_ends = np.concatenate([[0], np.cumsum(self.sizes)])
        ends = sentence_ends[np.concatenate([[0], np.cumsum(self.counts)])]
        for a, b in zip(ends, ends[1:]):
            held[np.unique(self.features[a:b])] += 1
        return held

    def narrowed(self, place: np.ndarray) -> Bags:
        """Features renumbered by ``place``; those with a negative number are left out."""
        parts, sizes = [np.zeros(0, np.int32)], np.zeros_like(self.sizes)
        for run, features, sent in self.blocks():
            new = place[features]
            parts.append(new[new >= 0])
            sizes[run] = np.bincount(sent[new >= 0], minlength=run.stop - run.start)
        return Bags(np.concatenate(parts), sizes, self.counts)


class NoisyOr:
    """Sentence weights, and the calibration (slope, shift of log-odds) of the scores."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0) -> None:
        self.weights, self.bias, self.slope, self.shift, self.known = weights, bias, slope, shift, {}

    @classmethod
    def fit(cls, bags: Bags | list, labels: np.ndarray, rounds: int = 120, rate: float = 0.05, shrink: float = 1.0, least: int = 3) -> NoisyOr:
        """bags: ``Bags``, or each document's sentences' feature lists; features of fewer than ``least`` documents are left out.

        Gradient steps with momentum, each feature's scaled by a bound of its curvature, so that a rare feature does not
        learn one document by heart.  Besides the features, four bytes each, only one block of them is expanded at a time.
        """
        bags = bags if isinstance(bags, Bags) else Bags.of(bags)
        y, n = labels.astype(float), len(bags.counts)
        doc = np.repeat(np.arange(n), bags.counts)
        used = np.flatnonzero(bags.documents_with() >= least)
        place = np.full(BUCKETS, -1, np.int32)
        place[used] = np.arange(len(used))
        bags = bags.narrowed(place)
        w, v, bias, vb = np.zeros(len(used)), np.zeros(len(used)), -5.0, 0.0
        for _ in range(rounds):
            z = bags.sums(w) + bias
            p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-12, 1 - 1e-9)
            whole = np.clip(-np.expm1(np.bincount(doc, np.log1p(-p), n)), 1e-9, 1.0)
            g = p * (1 - y[doc] / whole[doc])
            slope, curve = shrink * w, np.full(len(used), shrink)
            for run, features, sent in bags.blocks():
                slope += np.bincount(features, g[run][sent], len(used))
                curve += np.bincount(features, p[run][sent] + 0.02, len(used))
            v = 0.8 * v + slope / curve
            w -= rate * np.clip(v, -3, 3)
            vb = 0.8 * vb + g.sum() / (p.sum() + 1)
            bias -= rate * vb
        weights = np.zeros(BUCKETS, np.float32)
        weights[used] = w
        return cls(weights, bias)

    def calibrate(self, bags: Bags, labels: np.ndarray) -> NoisyOr:
        """Platt scaling of the documents' log-odds on bags that were not fitted."""
        p = np.minimum(1 / (1 + np.exp(-np.clip(bags.sums(self.weights) + self.bias, -700, 700))), 1 - 1e-12)
        whole = -np.expm1(np.bincount(np.repeat(np.arange(len(bags.counts)), bags.counts), np.log1p(-p), len(bags.counts)))
        z = np.array([_log_odds(x) for x in whole])
        a, c = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
            d, k = p - labels, p * (1 - p)
            grad = np.array([(d * z).sum() + 4 * (a - 1), d.sum()])
            hess = np.array([[(k * z * z).sum() + 4, (k * z).sum()], [(k * z).sum(), k.sum() + 1e-3]])
            a, c = (float(x) for x in np.array([a, c]) - np.clip(np.linalg.solve(hess, grad), -2, 2))
        if a > 0:
            self.slope, self.shift = a, c
        return self

    @staticmethod
    def _whole(sentence_scores: list[float]) -> float:
        return -math.expm1(sum(math.log1p(-min(p, 1 - 1e-12)) for p in sentence_scores))

    def _scaled(self, p: float) -> float:
        if p <= 0:
            return 0.0
        return 1 / (1 + math.exp(-min(700.0, max(-700.0, self.slope * _log_odds(p) + self.shift))))

    def word(self, w: str) -> float:
        x = float(sum(self.weights[i] for i in word_features(w)))
        if len(self.known) > CACHE:
            self.known.clear()
        self.known[w] = x
        return x

    def sentence(self, words: list[str]) -> float:
        get, z = self.known.get, self.bias
        for w in words:
            x = get(w)
            z += self.word(w) if x is None else x
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def score(self, text: str | None, at_least: float = 0.5) -> tuple[float, list[dict]]:
        """The noisy-or of the sentences, and those whose own score is ``at_least``: number, score, text."""
        scores, found = [], []
        for i, s in enumerate(_SENTENCE.split((text or "").lower())):
            words = _WORD.findall(s)
            if words:
                scores.append(self.sentence(words))
                own = self._scaled(scores[-1])
                if own >= at_least:
                    found.append({"sentence": i, "score": own, "text": s.strip()})
        return self._scaled(self._whole(scores)), found


def _log_odds(p: float) -> float:
    p = min(max(p, 1e-12), 1 - 1e-12)
    return math.log(p / (1 - p))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_docs: int = 8000) -> NoisyOr:
    """Fit on a sample of ``docs`` that ``labels`` marks: about ``max_docs`` different (id, text), never over twice as many.

    Repeated rows count once, before the draw.
    """
    # The chosen keys are bounded by max_docs: they are broadcast, so texts stay where they are.
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    known = marks.join(rows.select("doc_id", "h").distinct(), "doc_id").groupBy("h").agg(F.max("y").alias("y"))
    share = {r["y"]: min(1.0, max_docs / 2 / r["n"]) for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("draw"), "h"), F.lit(1_000_003)) / 1_000_003.0
    chosen = known.where(F.expr("false") if len(share) < 2 else draw < F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    chosen = materialize(chosen.orderBy(draw, "h").limit(2 * max_docs), "chosen")
    sample = rows.join(F.broadcast(chosen), "h").select("y", "h", "text").dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [[sorted({f for w in s for f in word_features(w)}) for s in sentences(t)] for t in batch.column(2).to_pylist()]
            features, sizes = [[f for s in b for f in s] for b in bags], [[len(s) for s in b] for b in bags]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], names=["y", "h", "features", "sizes"])

    got = sample.mapInArrow(run, "y int, h long, features array<int>, sizes array<int>").toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    y = got.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return NoisyOr(np.zeros(BUCKETS, np.float32), -800.0)
    aside = got.column("h").to_numpy() // 1_000_003 % 5 == 0
    fitted, kept = _bags(got.filter(pa.array(~aside))), _bags(got.filter(pa.array(aside)))
    del got
    model = NoisyOr.fit(fitted, y[~aside]).calibrate(kept, y[aside])
    model.shift += math.log(share[0] / share[1])  # from the sample's shares of the classes back to the labels' own
    return model


def _bags(rows: pa.Table) -> Bags:
    sizes = rows.column("sizes")
    return Bags(pc.list_flatten(rows.column("features")).to_numpy(), pc.list_flatten(sizes).to_numpy().astype(np.int64), pc.list_value_length(sizes).to_numpy().astype(np.int64))


def score(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score, offending array<struct<sentence, score, text>>)."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.slope, model.shift))
    place = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NoisyOr(*shared.value)
        for batch in batches:
            got = [own.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.float64()), pa.array([x for _, x in got], place)], names=["doc_id", "score", "offending"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, offending array<struct<sentence: int, score: double, text: string>>")


def held_out(fold: int, of: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == fold, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(0, 5)), load(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"), F.expr("transform(offending, x -> x.sentence)").alias("offending_sentences"))
