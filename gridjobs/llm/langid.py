"""Language identification by error-correcting output codes.

Every language has a codeword of bits, chosen to lie far apart; each bit is a binary linear classifier on hashed
character n-grams (1 to 4, with word ends) of the text's words.  A text's bit scores are compared with all codewords by
their logistic losses, each bit weighted by its accuracy on training data that did not fit it; the codeword with the
least loss wins.  The loss gap to the runner-up flags ambiguous texts, the softmax of the losses is the score.

Training takes a hash-chosen sample of about ``per_lang`` whole texts of each language, in all ``max_texts`` or one a
language, whichever is more; every language value is learned.  Which rows fit and which are kept aside goes by a hash
too, so the same rows give the same model however they are partitioned.  Scoring reads whole texts.  A word's bit scores
are kept in a bounded cache per worker.

Letters are what Python's ``str.isalpha`` calls letters.  Null texts and texts without one are ``und`` with score 0.  Null
languages are not learned.  Equal losses go to the alphabetically first language.  Columns of other names are ignored;
a very long text is held by one task.  With one language
known every text with letters gets it; with none, ``und``.  Repeated rows get equal results; an empty table, no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

BUCKETS = 1 << 14
CACHE = 500_000
_WORD = re.compile(r"[^\W\d_]+")


_ASCII = re.compile("[A-Za-z]")


def codewords(n: int, bits: int, seed: int = 5) -> np.ndarray:
    """n rows of +-1: the best of many random codes by least distance, without constant or repeated columns."""
    rng, best = np.random.default_rng(seed), None
    bits = min(bits, 2 ** (n - 1) - 1) if n < 12 else bits
    for _ in range(400):
        if n <= 4 and bits == 2 ** (n - 1) - 1:  # all columns there are
            code = np.array([[1 if c >> r & 1 else -1 for c in range(1, 2**n - 1, 1) if c & 1] for r in range(n)])
            return code
        code = rng.choice([-1, 1], (n, bits))
        cols = {tuple(c * c[0]) for c in code.T}
        if len(cols) < bits or any(abs(c.sum()) == n for c in code.T):
            if n > 4 and best is not None:
                continue
        far = min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) if n > 1 else bits
        if best is None or far > best[0]:
            best = (far, code)
    return best[1]


def word_grams(word: str) -> list[int]:
    w = f"^{word}$"
    return [zlib.crc32(w[i : i + n].encode()) % BUCKETS for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]


class OutputCode:
    """weights: (BUCKETS, bits); a text's bit scores are the mean of its words' scores, scaled, plus the bias."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray) -> None:
        self.langs, self.code, self.weights, self.bias, self.trust = langs, code, weights, bias, trust
        self.index: dict[str, int] = {}
        self.rows = np.zeros((4096, code.shape[1]), np.float32)

    def text_vector(self, words: list[str]) -> np.ndarray:
        if len(self.index) > CACHE:
            self.index, self.rows = {}, np.zeros((4096, self.rows.shape[1]), np.float32)
        get, index = self.index.get, self.index
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        for i in np.flatnonzero(at < 0).tolist():
            w = words[i]
            k = get(w)
            if k is None:
                k = index[w] = len(index)
                if k >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[k] = self.weights[word_grams(w)].mean(0)
            at[i] = k
        return self.rows[at].mean(0)

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)"""
        text = text or ""
        if not self.langs or not (text.isascii() and _ASCII.search(text) or any(map(str.isalpha, text))):
            return "und", 0.0, False
        words = _WORD.findall(text.lower())
        f = self.text_vector(words) + self.bias
        loss = (np.logaddexp(0.0, -self.code * f) * self.trust).sum(1)
        order = np.argsort(loss, kind="stable")
        share = np.exp(loss[order[0]] - loss)
        gap = loss[order[1]] - loss[order[0]] if len(order) > 1 else np.inf
        return self.langs[order[0]], float(1 / share.sum()), bool(gap < 0.7)


_loaded: dict[str, OutputCode] = {}


def _held(token: str, parts: tuple) -> OutputCode:
    """The model that a worker process holds, with its cache of words, from task to task."""
    if token not in _loaded:
        _loaded.clear()
        _loaded[token] = OutputCode(*parts)
    return _loaded[token]


def _fit_bits(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.5, shrink: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """One logistic regression (targets +-1) for each column of y, all by AdaGrad; x: (texts, features), y: (texts, bits)."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1])
    g2, gb2 = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(rounds):
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(y)
        gw = x.T @ g.astype(np.float32) + shrink * w
        g2 += gw * gw
        w -= rate * 10 * gw / np.sqrt(g2)
        gb2 += g.sum(0) ** 2
        b -= rate * g.sum(0) / np.sqrt(gb2)
    return w, b


def _matrix(rows: pa.Table) -> np.ndarray:
    """The texts' vectors, from (bucket, value) lists."""
    x, n = np.zeros((len(rows), BUCKETS), np.float32), pc.list_value_length(rows.column("at")).to_numpy()
    x[np.repeat(np.arange(len(rows)), n), pc.list_flatten(rows.column("at")).to_numpy()] = pc.list_flatten(rows.column("v")).to_numpy()
    return x


def learn(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_lang: int = 400, max_texts: int = 4000, bits: int = 15) -> OutputCode:
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit("draw"), F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    known = {r["lang"]: r["n"] for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(known)
    if not langs:
        return OutputCode([], np.zeros((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1), np.ones(1))
    bits = max(bits, 4 * (len(langs) - 1).bit_length())
    per_lang = max(1, min(per_lang, max_texts // len(langs)))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, per_lang / n)) for k, n in known.items()], "lang string, share double")
    sample = rows.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 < F.col("share")).select("lang", "text", "h").dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, values = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = Counter(_WORD.findall(text.lower()))
                if words:
                    v, n = np.zeros(BUCKETS), words.total()
                    for w, times in words.items():
                        own = word_grams(w)
                        np.add.at(v, own, times / len(own) / n)
                    texts.append(i)
                    at.append(np.flatnonzero(v))
                    values.append(v[at[-1]])
            own = pa.array(texts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(2).take(own), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["lang", "h", "at", "v"])

    got = sample.mapInArrow(run, "lang string, h long, at array<int>, v array<float>").toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    label = np.array([langs.index(x) for x in got.column("lang").to_pylist()], np.int64)
    if len(langs) == 1 or not len(label):
        return OutputCode(langs[:1], np.ones((1, 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1), np.ones(1))
    code = codewords(len(langs), bits)
    y = code[label].astype(np.float32)
    fold = got.column("h").to_numpy() // 1_000_003 % 4 == 0
    weights, bias = _fit_bits(_matrix(got.filter(pa.array(~fold))), y[~fold])
    right = ((_matrix(got.filter(pa.array(fold))) @ weights + bias) * y[fold] > 0).mean(0) if fold.any() else np.ones(len(bias))
    return OutputCode(langs, code, weights, bias, np.maximum(0.05, 2 * right - 1))


def identify(docs: DataFrame, model: OutputCode, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score, ambiguous)."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.code, model.weights, model.bias, model.trust))
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _held(token, shared.value)
        for batch in batches:
            got = [own.decide(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*got) if got else [[]] * 3, (pa.string(), pa.float64(), pa.bool_())))], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identify(docs, learn(docs.where(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
