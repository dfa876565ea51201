"""Quality classification by co-training of two views.

The text view sees a text's content: its distinct words, hashed, and counts of its form (shares of character classes,
of repeated words and lines, lengths) in bins.  The metadata view sees the page's record: source and language, hashed,
and the recorded length in bins.  Both are logistic models.  Starting from labelled documents, in each round each view
scores every unlabelled document, and the ones it is surest of (``per_round`` of each class, above ``sure``) go with its
labels into the other view's training set.  A quarter of the labelled sample is kept aside throughout; on it each view's
log-odds are calibrated (Platt scaling), and the combined log-odds are the calibrated ones' sum less the prior.

Learning takes at most ``max_labelled`` labelled documents, chosen by hash (the bound of the sample); the unlabelled pool
is every document without a label.  Features of all are written once, and the rounds read those.  Only keys and log-odds
are shuffled to leave the labelled out; ``per_round`` keys of each class and view, and their features, reach the driver.
Rows of one id and text share a key and count once among the surest.

Nulls: a null text counts as empty, null metadata is a value of its own; a null id is scored, and is never labelled.
Labels other than 0 and 1 are ignored; of several labels of one document the greatest counts.  Ties in sureness go by a
hash of the row, so the same rows give the same model however they are partitioned.  Without labels of both classes
every score is 0.5.  Repeated rows get equal scores; an empty table gives no rows.  Clashing column names in ``keep`` are
kept apart by a prefix inside.  A very long text is split into words by one task; its features are as many as its
distinct words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, load, materialize

BINS, WORDS, VALUES = 12, 1 << 16, 1 << 12
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"-()?", b"!", b"|", b"#$%&*@+=<>[]{}~^_/\\`", b" ", b"\n"]
_CLASS = np.zeros((256, len(_CLASSES) + 1))
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c), _i] = 1
_CLASS[128:, len(_CLASSES)] = 1


def text_features(text: bytes | None) -> tuple[list[float], np.ndarray]:
    """(counts of form, hashed distinct words)"""
    text = text or b""
    n = len(text)
    shares = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS / n).tolist() if n else [0.0] * (len(_CLASSES) + 1)
    words = text.lower().split()
    lines = [x for x in text.split(b"\n") if x]
    k = len(words)
    once = set(words)
    form = [
        *shares,
        math.log1p(k),
        n / max(1, k),
        len(once) / max(1, k),
        len(once) / max(1.0, k**0.8),
        len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        sum(1 for w in once if len(w) > 20) / max(1, len(once)),
        sum(map(bytes.__eq__, words, words[1:])) / max(1, k),
    ]
    return form, np.unique(np.fromiter(map(zlib.crc32, once), np.int64, len(once)) % WORDS).astype(np.int32)


FORMS = len(text_features(b"")[0])


class Rows:
    """Sparse rows: features ``idx`` with values ``val``, ``stop`` their ends."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.n = len(rows)
        self.size = np.array([len(i) for i, _ in rows], np.int64)
        self.idx = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.val = np.concatenate([v for _, v in rows]).astype(np.float32) if rows else np.zeros(0, np.float32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), self.size)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.idx] * self.val, self.n)


class View:
    """A logistic model on sparse rows, fitted by AdaGrad; a later fit starts from the earlier weights."""

    def __init__(self, size: int) -> None:
        self.w, self.b, self.slope, self.shift = np.zeros(size, np.float32), 0.0, 1.0, 0.0

    def odds(self, x: Rows) -> np.ndarray:
        return x.dot(self.w) + self.b

    def fit(self, x: Rows, y: np.ndarray, rounds: int = 100, rate: float = 0.3, shrink: float = 1e-4) -> None:
        w, b, g2, gb2 = self.w, self.b, np.full(len(self.w), 1e-8, np.float32), 1e-8
        for _ in range(rounds):
            g = ((1 / (1 + np.exp(-np.clip(x.dot(w) + b, -30, 30))) - y) / len(y)).astype(np.float32)
            gw = np.bincount(x.idx, g[x.row] * x.val, len(w)).astype(np.float32) + np.float32(shrink) * w
            g2 += gw * gw
            w = w - np.float32(rate) * gw / np.sqrt(g2)
            gb2 += float(g.sum()) ** 2
            b -= rate * float(g.sum()) / math.sqrt(gb2)
        self.w, self.b = w, b

    def calibrate(self, x: Rows, y: np.ndarray) -> None:
        """Platt scaling by Newton steps, slightly shrunk towards slope 1."""
        z, a, c = self.odds(x), 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
            d, v = p - y, p * (1 - p)
            grad = np.array([(d * z).sum() + (a - 1), d.sum()])
            hess = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
            step = np.clip(np.linalg.solve(hess, grad), -2, 2)
            a, c = a - step[0], c - step[1]
        self.slope, self.shift = max(a, 0.0), c


class CoTrained:
    """Both views with their encodings: bin edges from the labelled sample, hashed values."""

    def __init__(self, form: np.ndarray, chars: np.ndarray) -> None:
        cuts = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = np.quantile(form, cuts, axis=0) if len(form) else np.zeros((BINS - 1, FORMS))
        self.char_edges = np.quantile(chars, cuts) if len(chars) else np.zeros(BINS - 1)
        self.views = (View(WORDS + FORMS * BINS), View(2 * VALUES + BINS + 1))
        self.prior = 0.0

    def text_row(self, form: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = (form[None, :] >= self.edges).sum(0) + np.arange(FORMS) * BINS + WORDS
        return np.concatenate([words, bins]), np.concatenate([np.full(len(words), 4 / math.sqrt(max(1, len(words)))), np.ones(FORMS)])

    def meta_row(self, source: str | None, lang: str | None, chars: float | None) -> tuple[np.ndarray, np.ndarray]:
        at = [k * VALUES + (zlib.crc32(v.encode()) % (VALUES - 1) + 1 if v is not None else 0) for k, v in enumerate((source, lang))]
        place = BINS if chars is None or chars != chars else int(np.searchsorted(self.char_edges, chars, "right"))
        return np.array([*at, 2 * VALUES + place]), np.ones(3)

    def rows(self, batch: dict[str, list]) -> tuple[Rows, Rows]:
        """Sparse rows of both views of columns form, words, source, lang, chars."""
        text = Rows([self.text_row(np.asarray(f, float), np.asarray(w)) for f, w in zip(batch["form"], batch["words"])])
        return text, Rows([self.meta_row(*m) for m in zip(batch["source"], batch["lang"], batch["chars"])])

    def scores(self, rows: tuple[Rows, Rows]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (v.slope * v.odds(x) + v.shift for v, x in zip(self.views, rows))
        squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return squash(a + b - self.prior), squash(a), squash(b)


_FEATURES = "key long, y int, source string, lang string, chars double, form array<double>, words array<int>"
_NAMES = [x.split()[0] for x in _FEATURES.split(", ")]


def _view(docs: DataFrame, id_col: str, text_col: str, keep: list[str] = ()) -> DataFrame:
    own = [F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("double").alias("chars")]
    return docs.select(*own, *(F.col(c).alias(f"kept_{c}") for c in keep))


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at, at[1:])]


def _columns(batch: pa.RecordBatch | pa.Table) -> dict[str, list]:
    if isinstance(batch, pa.Table):
        batch = batch.combine_chunks().to_batches()[0] if len(batch) else pa.RecordBatch.from_pylist([], batch.schema)
    plain = {c: batch.column(c).to_pylist() for c in ("key", "y", "source", "lang", "chars")}
    return plain | {"form": _lists(batch.column("form")), "words": _lists(batch.column("words"))}


def features(rows: DataFrame) -> DataFrame:
    """Features of rows (key, y, source, lang, chars, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(t.as_py()) for t in batch.column(5)]
            form, words = pa.array([f for f, _ in found], pa.list_(pa.float64())), pa.array([w for _, w in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), form, words], names=_NAMES)

    return rows.select("key", "y", "source", "lang", "chars", "text").mapInArrow(run, _FEATURES)


def _confident(rows: DataFrame, model: CoTrained, least: float) -> DataFrame:
    """Rows (key, odds0, odds1) of those of which a view's log-odds are beyond ``least`` either way."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                a, b = (view.odds(x) for view, x in zip(own.views, own.rows(_columns(pa.Table.from_batches([part])))))
                far = np.flatnonzero((np.abs(a) > least) | (np.abs(b) > least))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(far)), pa.array(a[far], pa.float64()), pa.array(b[far], pa.float64())], names=["key", "odds0", "odds1"])

    return rows.mapInArrow(run, "key long, odds0 double, odds1 double")


def _surest(found: DataFrame, marked: DataFrame, model: CoTrained, taught: tuple[set, set], per_round: int, sure: float) -> list[tuple[int, int, int]]:
    """(view, side, key): the ``per_round`` surest unlabelled keys of each view and class that the other view was not taught."""
    least = math.log(sure / (1 - sure))
    # Marks meet keys and odds, so features stay where they are.
    odds = _confident(found, model, least).join(marked.select("key"), "key", "left_anti")
    odds = odds.groupBy("key").agg(*(f(f"odds{v}").alias(f"{n}{v}") for v in (0, 1) for n, f in (("low", F.min), ("high", F.max))))
    odds, picked = materialize(odds, "odds"), []
    for v in (0, 1):
        new = odds.where(~F.col("key").isin(list(taught[1 - v]))) if taught[1 - v] else odds
        for side, toward in ((0, -F.col(f"low{v}")), (1, F.col(f"high{v}"))):
            best = new.select("key", toward.alias("odds")).where(F.col("odds") > least).orderBy(F.desc("odds"), "key").limit(per_round)
            picked += [(v, side, r["key"]) for r in best.collect()]
    drop_table(odds)
    return picked


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 6000, rounds: int = 3, per_round: int = 200, sure: float = 0.97) -> CoTrained | None:
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    rows = _view(docs, id_col, text_col).withColumn("key", F.xxhash64("doc_id", "text"))
    key_of = materialize(rows.where("doc_id IS NOT NULL").select("doc_id", "key").distinct().join(marks, "doc_id").groupBy("key").agg(F.max("y").alias("mark")), "marks")
    counts = {r["mark"]: r["n"] for r in key_of.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    if not (counts.get(0) and counts.get(1)):
        return None
    few = min(max_labelled / 2, counts[0], counts[1])
    share = {y: min(1.0, (few if counts[y] <= counts[1 - y] else max_labelled - few) / counts[y]) for y in (0, 1)}
    draw = F.pmod(F.xxhash64(F.lit("draw"), "key"), F.lit(1_000_003)) / 1_000_003.0
    # Labels meet features, not texts: a row's features are a fraction of its text.
    found = materialize(features(rows.withColumn("y", F.lit(None).cast("int"))), "features")
    chosen = key_of.where(draw < F.when(F.col("mark") == 1, share[1]).otherwise(share[0])).orderBy(draw, "key").limit(2 * max_labelled)
    sample = found.join(F.broadcast(chosen), "key").withColumn("y", F.col("mark")).select(*_NAMES).dropDuplicates(["key"]).toArrow().sort_by("key")
    cols = _columns(sample)
    y = np.array(cols["y"], np.int64)
    if not ((y == 0).any() and (y == 1).any()):
        return None
    model = CoTrained(np.array(cols["form"], float).reshape(-1, FORMS), np.array([c for c in cols["chars"] if c is not None and c == c]))
    aside = np.array([zlib.crc32(b"%d" % k) % 4 == 0 for k in cols["key"]], bool)
    own = {c: [v for v, a in zip(x, aside) if not a] for c, x in cols.items()}
    kept = {c: [v for v, a in zip(x, aside) if a] for c, x in cols.items()}
    sets, taught = [{c: list(x) for c, x in own.items()} for _ in (0, 1)], (set(), set())
    for turn in range(rounds + 1):
        for v in (0, 1):
            model.views[v].fit(model.rows(sets[v])[v], np.array(sets[v]["y"], float), 100 if turn == 0 else 40)
        if turn == rounds:
            break
        picked = _surest(found, key_of, model, taught, per_round, sure)
        if not picked:
            continue
        keys = F.broadcast(docs.sparkSession.createDataFrame(sorted({(k,) for _, _, k in picked}), "key long"))
        got = found.join(keys, "key").groupBy("key").agg(F.min(F.struct(*_NAMES)).alias("row")).select("row.*").toArrow()
        cols = _columns(got)
        place = {k: i for i, k in enumerate(cols["key"])}
        for v, side, key in picked:
            taught[1 - v].add(key)
            for c, values in cols.items():
                sets[1 - v][c].append(side if c == "y" else values[place[key]])
    for t in (found, key_of):
        drop_table(t)
    if aside.any():
        for v, x in enumerate(model.rows(kept)):
            model.views[v].calibrate(x, np.array(kept["y"], float))
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.prior = math.log(mean / (1 - mean))
    return model


def score(docs: DataFrame, model: CoTrained | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """Rows (doc_id, score, text_score, meta_score); with ``keep`` the named columns of ``docs`` in place of doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = _view(docs, id_col, text_col, keep)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                if own is None:
                    cols = [np.full(part.num_rows, 0.5)] * 3
                else:
                    form, words = zip(*(text_features(t.as_py()) for t in part.column(1)))
                    cols = own.scores(own.rows({"form": form, "words": words, **{c: part.column(i).to_pylist() for c, i in (("source", 2), ("lang", 3), ("chars", 4))}}))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in cols), *(part.column(i) for i in range(5, part.num_columns))], names=["doc_id", "score", "text_score", "meta_score", *part.schema.names[5:]])

    schema = f"doc_id {kinds['doc_id']}, score double, text_score double, meta_score double" + "".join(f", `kept_{c}` {kinds[f'kept_{c}']}" for c in keep)
    out = rows.mapInArrow(run, schema)
    return out.select("score", "text_score", "meta_score", *(F.col(f"kept_{c}").alias(c) for c in keep)) if keep else out


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = score(docs, learn(docs.where(~held), load(spark, sf_dir, "labels")))
    return found.select("doc_id", held.alias("held_out"), "score", "text_score", "meta_score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
