"""Subword-lattice language model: a text's probability summed over all segmentations.

The pieces are those of an existing subword vocabulary file; no tokenizer is trained.  A piece's weight in a class of
documents (a language; the rarest beyond ``MOST_CLASSES`` and rows without one share a class) is its expected count over all
training tokens, smoothed by the vocabulary's own scores.  Expectations go over all segmentations of a word, by forward and
backward recursions (the E-step of EM): a few rounds over the most frequent words, from the vocabulary's scores, give the
weights under which one pass over all words counts.  A word's probability is the sum over all its segmentations, by
a forward recursion in log space; characters that no piece covers are spelled in byte pieces.  A text's ``score`` is
the lattice's alone: the sum over classes of the class's share times the product of its tokens' marginals, the class
being unknown to it.

``mixed_score`` is another model beside it: a token's probability there is the lattice's mixed with the token's relative
frequency in the class and in the corpus (fixed shares ``MIX``).  Each component is a distribution over tokens.

Counting covers all training texts: partial counts for each task, then one shuffle by word.  The ``FREQUENT`` most
frequent words (fewer with many classes: ``TABLE`` numbers at most) are sent to the scoring tasks with their probabilities; all other words travel as
(document, word, count) rows and join the full count table, with partial sums for each document.

Null texts are empty: one end token.  Null ids are kept and never held out.  Repeated rows are scored (and, if they are
training rows, counted) each.  Without training rows, or with an empty table, the counts are zero and the pieces have
their vocabulary's scores.  Columns of other names are ignored.  A very long text is split into words by one task; a word
takes memory by its length times the longest piece.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, load, materialize, release

FREQUENT, TABLE = 1 << 16, 1 << 20
#: Classes with weights of their own; rounds of EM, over so many of the most frequent words, before the pass over all.
MOST_CLASSES, ROUNDS, START_WORDS = 64, 3, 1 << 16
#: Shares of the class's frequencies, the corpus's frequencies and the lattice in a token's probability.
MIX = (0.8, 0.1, 0.1)
END = ""  # no word is empty, so this stands for the end token


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


class Lattice:
    """Piece weights by class; ``log10(words)`` gives an array (words, classes)."""

    def __init__(self, path: str, counts: np.ndarray, ends: np.ndarray, pull: float = 200.0) -> None:
        """counts: (pieces, classes); ends: end tokens by class; ``pull``: the weight of the vocabulary's scores."""
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        real = np.array([not (sp.is_control(i) or sp.is_unknown(i)) for i in range(len(pieces))])
        byte = np.array([sp.is_byte(i) for i in range(len(pieces))])
        score = np.array([max(sp.get_score(i), -1e6) for i in range(len(pieces))])
        prior = np.where(real, np.where(byte, 1e-6, 1 / (10 - np.minimum(score, 0))), 0)
        prior /= prior.sum() + 0.01
        with np.errstate(divide="ignore"):
            share = (counts * real[:, None] + pull * prior[:, None]) / (counts.sum(0) + ends + pull)
            self.rows = np.concatenate([np.full((1, counts.shape[1]), -np.inf), np.log(share)])
        end = 1 - share.sum(0)
        inside = share[np.array([not p.startswith("▁") for p in pieces])].sum(0)
        self.end = np.log10(end / (1 - inside))
        self.index = {p: i + 1 for i, p in enumerate(pieces) if real[i] and not byte[i]}
        for p in list(self.index):  # prefixes that are no pieces have row 0, impossible
            for m in range(1, len(p)):
                self.index.setdefault(p[:m], 0)
        self.bytes = {int(pieces[i][3:5], 16): i + 1 for i in np.flatnonzero(byte)}
        self.longest, self.pieces, self.spelled = max(map(len, self.index)), len(pieces), {}

    def _spelled(self, char: str) -> int:
        row = self.rows[[self.bytes[b] for b in char.encode()]].sum(0)
        self.rows = np.concatenate([self.rows, row[None]])
        self.index[char] = len(self.rows) - 1
        self.spelled[len(self.rows) - 1] = char
        return len(self.rows) - 1

    @staticmethod
    def _groups(words: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(characters with the word mark, places) of words of one length, not too many at once."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(i)
        for n, own in by_length.items():
            per = max(1, 1 << 15 >> max(0, n.bit_length() - 1))
            for at in range(0, len(own), per):
                yield n, own[at : at + per]

    def log10(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.rows.shape[1]))
        for n, some in self._groups(words):
            ids = self._edges([words[i] for i in some], n)
            out[some] = self._forward(ids)[n]
        return out / math.log(10)

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """(pieces, classes): expected counts of the pieces in ``words``, each as often as ``counts`` (words, classes) says.

        Segmentations are weighted by the first class of this lattice.
        """
        total = np.zeros((len(self.rows), counts.shape[1]))
        for n, some in self._groups(words):
            ids = self._edges([words[i] for i in some], n)
            weight, alpha = self.rows[:, 0], self._forward(ids, 1)[:, :, 0]
            used, beta = ids.any(2), np.full((n + 1, len(some)), -np.inf)
            beta[n] = 0
            at, share = [], []
            for s in range(n - 1, -1, -1):
                for m in range(min(len(ids), n - s)):
                    if used[m, s]:
                        through = weight[ids[m, s]] + beta[s + m + 1]
                        beta[s] = np.logaddexp(beta[s], through)
                        at.append(ids[m, s])
                        share.append(np.exp(alpha[s] + through - alpha[n]))
            at, share, own = np.concatenate(at), np.stack(share), counts[some]
            if len(self.rows) > len(total):
                total = np.concatenate([total, np.zeros((len(self.rows) - len(total), total.shape[1]))])
            for k in range(total.shape[1]):
                total[:, k] += np.bincount(at, (share * own[:, k]).ravel(), len(total))
        for row, char in self.spelled.items():
            for b in char.encode():
                total[self.bytes[b]] += total[row]
        return total[1 : self.pieces + 1]

    def _edges(self, words: list[str], n: int) -> np.ndarray:
        """Rows of the pieces by [length - 1, start, word], 0 where there is none."""
        longest, get = min(self.longest, n), self.index.get
        ids = np.zeros((longest, n, len(words)), np.int32)  # [length - 1, start, word]
        for k, w in enumerate(words):
            u = "▁" + w
            for i in range(n):
                if not get(u[i]):
                    self._spelled(u[i])
                for m in range(1, min(longest, n - i) + 1):
                    j = get(u[i : i + m])
                    if j is None:
                        break
                    ids[m - 1, i, k] = j
        return ids

    def _forward(self, ids: np.ndarray, classes: int | None = None) -> np.ndarray:
        """Log-probabilities of all segmentations of the first e characters, by [e, word, class]."""
        longest, n, words = ids.shape
        used, rows = ids.any(2), self.rows[:, :classes]
        alpha = np.full((n + 1, words, rows.shape[1]), -np.inf)
        alpha[0] = 0
        for e in range(1, n + 1):
            for m in range(1, min(longest, e) + 1):
                if used[m - 1, e - m]:
                    alpha[e] = np.logaddexp(alpha[e], alpha[e - m] + rows[ids[m - 1, e - m]])
        return alpha


def fit_frequent(path: str, words: list[str], counts: np.ndarray, ends: float, rounds: int = ROUNDS) -> np.ndarray:
    """(pieces, 1): weights by ``rounds`` of EM over these words, from the vocabulary's scores; the end token is left out."""
    own = [i for i, w in enumerate(words) if w != END]
    words, counts = [words[i] for i in own], counts[own].reshape(-1, 1).astype(float)
    lattice = Lattice(path, np.zeros((1, 1)), np.zeros(1))
    pieces = np.zeros((lattice.pieces, 1))
    for _ in range(rounds if words else 0):
        pieces = lattice.expected(words, counts)
        lattice = Lattice(path, pieces, np.array([float(ends)]))
    return pieces


def _classes(train: DataFrame) -> list[str]:
    found = train.where("class IS NOT NULL").groupBy("class").count().orderBy(F.desc("count"), "class").limit(MOST_CLASSES)
    return sorted(r["class"] for r in found.collect())


def word_counts(train: DataFrame, classes: list[str]) -> DataFrame:
    """Rows (word, c0, c1, ...): counts by class, the last one for all other documents; the end token is the empty word."""
    place, last = {c: i for i, c in enumerate(classes)}, len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for k, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in c], pa.string()), pa.array(np.full(len(c), k, np.int32)), pa.array(np.fromiter(c.values(), np.int64, len(c)))], names=["word", "k", "n"])
            held.clear()

        for batch in batches:
            kinds = batch.column(0).to_pylist()
            for i, text in enumerate(batch.column(1)):
                own = held.setdefault(place.get(kinds[i], last), Counter())
                own.update(split(text.as_py()))
                own[b""] += 1
                if i % 64 == 0 and sum(map(len, held.values())) > 300_000:
                    yield from flush()
            if sum(map(len, held.values())) > 300_000:
                yield from flush()
        yield from flush()

    found = train.select("class", "text").mapInArrow(run, "word string, k int, n long")
    return found.groupBy("word").agg(*(F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(last + 1)))


def piece_counts(counts: DataFrame, path: str, n: int, start: np.ndarray, ends: float) -> np.ndarray:
    """Expected counts by piece and class under the weights ``start``, over all words; in the last row the words' own.

    Not more rows than the vocabulary has reach the driver.
    """
    shared = counts.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, shared.value, np.array([ends]))
        total = np.zeros((lattice.pieces + 1, n))
        for batch in batches:
            c = np.stack([batch.column(1 + k).to_numpy() for k in range(n)], 1).astype(float)
            total[:-1] += lattice.expected(batch.column(0).to_pylist(), c)
            total[-1] += c.sum(0)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(n))], names=["piece", *(f"c{k}" for k in range(n))])

    from sentencepiece import SentencePieceProcessor

    out = np.zeros((SentencePieceProcessor(model_file=path).get_piece_size() + 1, n))
    found = counts.where(F.col("word") != END).mapInArrow(run, "piece long, " + ", ".join(f"c{k} double" for k in range(n)))
    got = found.groupBy("piece").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(n))).toArrow()
    at = got.column("piece").to_numpy()
    for k in range(n):
        out[at, k] = got.column(f"c{k}").to_numpy()
    return out


class TokenModel:
    """Probabilities of tokens by class, and the plain base score."""

    def __init__(self, path: str, pieces: np.ndarray, ends: np.ndarray, sizes: np.ndarray, kinds: int) -> None:
        self.lattice, self.sizes, self.n, self.v = Lattice(path, pieces, ends), sizes, float(sizes.sum()), kinds
        self.floor = math.log10(self.n + self.v + 1)

    def log10(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """(words, 2 * classes): log10 probabilities of the lattice, then of the mixture; counts: (words, classes)."""
        ends = np.array([w == END for w in words], bool)
        lat = np.empty(counts.shape)
        lat[ends] = self.lattice.end
        lat[~ends] = self.lattice.log10([w for w in words if w != END])
        own = counts / np.maximum(self.sizes, 1)
        all_ = (counts.sum(1) / max(self.n, 1))[:, None]
        with np.errstate(divide="ignore"):
            seen = np.log10(MIX[0] * own + MIX[1] * all_)
        mixed = np.logaddexp(seen * math.log(10), (lat + math.log10(MIX[2])) * math.log(10)) / math.log(10)
        return np.concatenate([lat, mixed], 1)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(counts.sum(1) + 1) - (self.floor if self.n + self.v else 0.0)


def _scan(rows: DataFrame, frequent, n: int) -> DataFrame:
    """A summary row for each document (word null) and a row for each of its words that is not frequent."""
    probs = [f"p{k}" for k in range(2 * n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table, base, known = frequent.value
        index = {w.encode(): i for i, w in enumerate(words)}
        end = index.get(b"", -1)
        row = TaskContext.get().partitionId() << 40
        names, kinds = ["row", "doc_id", "held_out", "word", "tf", "n_tokens", "n_known", "base", *probs], [pa.int64(), None, pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), *[pa.float64()] * (2 * n)]
        for batch in batches:
            kinds[1] = batch.column(0).type
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sums, rare_row, rare_word, rare_tf = [], [], [], []
                for i, text in enumerate(part.column(2)):
                    own = split(text.as_py())
                    ids = np.fromiter((index.get(w, -1) for w in own), np.int64, len(own))
                    hit = np.append(ids[ids >= 0], end) if end >= 0 else ids[ids >= 0]
                    sums.append((len(own) + 1, int(known[hit].sum()), float(base[hit].sum()), *table[hit].sum(0).tolist()))
                    rare = Counter(own[j] for j in np.flatnonzero(ids < 0).tolist())
                    if end < 0:
                        rare[b""] = 1
                    rare_row += [row + i] * len(rare)
                    rare_word += [w.decode() for w in rare]
                    rare_tf += rare.values()
                m, r = part.num_rows, len(rare_row)
                cols = list(zip(*sums))
                full = [pa.array(range(row, row + m), pa.int64()), part.column(0), part.column(1), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds[5:]))]
                yield pa.RecordBatch.from_arrays(full, names=names)
                if r:
                    yield pa.RecordBatch.from_arrays([pa.array(rare_row, pa.int64()), pa.nulls(r, kinds[1]), pa.nulls(r, pa.bool_()), pa.array(rare_word, pa.string()), pa.array(rare_tf, pa.int64()), *(pa.nulls(r, t) for t in kinds[5:])], names=names)
                row += m

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, word string, tf long, n_tokens long, n_known long, base double, " + ", ".join(f"{p} double" for p in probs))


def _priced(words: DataFrame, model, n: int) -> DataFrame:
    """(word, counts) to (word, known, base, probabilities by class); the mixture's, which are beside the score, in half the room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TokenModel(*model.value)
        for batch in batches:
            c = np.stack([batch.column(1 + k).to_numpy() for k in range(n)], 1).astype(float)
            p = own.log10(batch.column(0).to_pylist(), c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c.sum(1) > 0), pa.array(own.base(c)), *(pa.array(np.ascontiguousarray(p[:, k]), pa.float64() if k < n else pa.float32()) for k in range(2 * n))], names=["word", "known", "b", *(f"q{k}" for k in range(2 * n))])

    return words.mapInArrow(run, "word string, known boolean, b double, " + ", ".join(f"q{k} {'double' if k < n else 'float'}" for k in range(2 * n)))


def score(docs: DataFrame, held_out, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", class_col: str = "lang") -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score), scores in log10.

    ``held_out``: a column expression over ``docs``; rows where it is true are scored but not learned from.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("text"), F.col(class_col).cast("string").alias("class"))
    train = rows.where("NOT held_out")
    classes = _classes(train)
    n = len(classes) + 1
    cs = [f"c{k}" for k in range(n)]
    counts = materialize(word_counts(train, classes), "counts")
    release(spark)
    total = counts.agg(F.count("*").alias("v"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cs)).first()
    sizes = np.array([total[c] for c in cs], float)
    ends = counts.where(F.col("word") == END).select(*cs).first()
    ends = np.array([*ends], float) if ends else np.zeros(n)
    top = counts.orderBy(F.expr(" + ".join(cs)).desc(), "word").limit(START_WORDS).toArrow()
    words = top.column("word").to_pylist()
    c = np.stack([top.column(x).to_numpy() for x in cs], 1).astype(float).reshape(len(words), n)
    pieces = piece_counts(counts, vocabulary, n, fit_frequent(vocabulary, words, c.sum(1), ends.sum()), float(ends.sum()))
    parts = (vocabulary, pieces[:-1], ends, sizes, total["v"])
    model = TokenModel(*parts)
    held = max(1, min(FREQUENT, TABLE // n))
    words, c = words[:held], c[:held]
    frequent = spark.sparkContext.broadcast((words, model.log10(words, c), model.base(c), c.sum(1) > 0))

    found = materialize(_scan(rows.select("doc_id", "held_out", "text"), frequent, n), "scan")
    rare = found.where("word IS NOT NULL").select("row", "word", "tf")
    need = rare.groupBy("word").agg(F.count("*").alias("d")).join(counts, "word", "left").select("word", *(F.coalesce(x, F.lit(0)).alias(x) for x in cs))
    priced = materialize(_priced(need, spark.sparkContext.broadcast(parts), n), "priced")
    drop_table(counts)
    release(spark)
    sums = rare.join(priced, "word").groupBy("row").agg(F.sum(F.when(F.col("known"), F.col("tf")).otherwise(0)).alias("rk"), F.sum(F.col("tf") * F.col("b")).alias("rb"), *(F.sum(F.col("tf") * F.col(f"q{k}")).alias(f"r{k}") for k in range(2 * n)))
    met = found.where("word IS NULL").join(sums, "row", "left")
    docs_of = np.maximum(ends, 0.5) / np.maximum(ends, 0.5).sum()

    def whole(first: int):
        logs = [F.col(f"p{first + k}") + F.coalesce(f"r{first + k}", F.lit(0.0)) + F.lit(float(np.log10(docs_of[k]))) for k in range(n)]
        best = F.greatest(*logs) if n > 1 else logs[0]
        return best + F.log10(sum((F.pow(F.lit(10.0), x - best) for x in logs), F.lit(0.0)))

    return met.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rk", F.lit(0))).alias("n_known"), F.lit(int(sizes.sum())).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rb", F.lit(0.0))).alias("base_score"), whole(0).alias("score"), whole(n).alias("mixed_score"))


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score(load(spark, sf_dir, "documents"), held, public_tokenizers.path("piece_bpe_32k.model"))
