"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows.  A document's tokens fill whole windows while they can; the rest
goes to the open window that it fits most tightly.  If none fits and no window may be opened, the fullest is emitted: a
gap of more than ``max_gap`` tokens is first topped up with the head of the piece at hand, so that padding stays below
that.  At the end the open windows of groups of ``fan_in`` partitions are merged, level by level, until one window is
left; only pieces of open windows travel, at most ``fan_in * windows`` of them at once.

Tokens come from an existing vocabulary file (a parameter); words repeat, so each worker keeps the ids of up to
``CACHE`` words.  A very long text is held whole, with its ids, by the task that reads it; its full windows leave at once.
Columns of other names in the input are ignored.  Ties (windows equally full) go to the oldest window.  Nulls: a null text is empty and has the end token alone; a null id is kept.  Repeated rows
are packed each.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize

#: Words that a task may hold, and those that a worker keeps from task to task.
CACHE, KEPT = 600_000, 100_000
_SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, open boolean"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a letter: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


_LETTERS = _byte_letters()
_PACK = [struct.Struct(f"<{n}I") for n in range(32)]


class _Words(dict):
    """Ids by word, found when first asked for."""

    def __init__(self, find) -> None:
        self.find = find

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.find(word)
        return ids


class WordIds:
    """Token ids (little-endian unsigned 32-bit) of texts.

    The vocabulary file says how it cuts text.  Where it lower-cases (after composing characters and replacing white
    space at most), keeps the matches of one pattern that white space ends, and writes bytes as letters, a text's ids
    are those of its words in turn, and a word's ids those of the pattern's matches; each distinct match then goes to
    the file's model once for each worker.  Words beyond the Latin letters, for which libraries might disagree about
    cases and classes, and words that hold an added token are encoded by the tokenizer itself.  Of any other file whole
    texts are encoded plainly.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self._word)
        self.matches: dict[str, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.starts = {x[0] for x in self.added}
        self.pattern = self._pattern(json.loads(self.tokenizer.to_str()))
        self.latin = regex.compile("[\u0021-\u012f\u0131-\u024f]+")
        self.model = self.tokenizer.model

    def _pattern(self, file: dict):
        """The pattern whose matches are encoded one by one; None if the file cuts text in another way."""

        def steps(part: dict | None, name: str) -> list[dict]:
            return [] if part is None else part[name] if part["type"] == "Sequence" else [part]

        for n in steps(file["normalizer"], "normalizers"):
            if n["type"] not in ("NFC", "Lowercase") and not (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "):
                return None
        cuts = steps(file["pre_tokenizer"], "pretokenizers")
        if [c["type"] for c in cuts] != ["Split", "ByteLevel"] or file["model"]["type"] != "BPE" or file["model"]["dropout"]:
            return None
        split, letters = cuts
        if "Regex" not in split["pattern"] or (split["behavior"], split["invert"]) != ("Removed", True) or letters["add_prefix_space"] or letters["use_regex"]:
            return None
        if any(set(x) & set(string.whitespace) for x in self.added):
            return None
        self.lower = any(n["type"] == "Lowercase" for n in steps(file["normalizer"], "normalizers"))
        pattern = regex.compile(split["pattern"]["Regex"])
        # No match reaches over white space if none does in a text with each kind of character on both sides of it.
        probe = [f"{a}{gap}{b}" for a in "a1.'\u00e9" for b in "a1.'\u00e9s" for gap in " \n\t\r\x0b\x0c"]
        return None if any(c in m for p in probe for m in pattern.findall(p) for c in string.whitespace) else pattern

    def trim(self, keep: int = KEPT) -> None:
        """Keep the words met first: frequent ones are among them."""
        for held in (self.words, self.matches):
            if len(held) > keep:
                first = list(itertools.islice(held.items(), keep))
                held.clear()
                held.update(first)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _match(self, match: str) -> bytes:
        found = self.matches.get(match)
        if found is None:
            plain = match.isascii() and match.isprintable()
            ids = [t.id for t in self.model.tokenize(match if plain else match.encode().decode("latin-1").translate(_LETTERS))]
            found = self.matches[match] = (_PACK[len(ids)] if len(ids) < len(_PACK) else struct.Struct(f"<{len(ids)}I")).pack(*ids)
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if not (text.isascii() or self.latin.fullmatch(text)) or (not self.starts.isdisjoint(text) and any(x in text for x in self.added)):
            return self._plain(text)
        found = self.pattern.findall(text.lower() if self.lower else text)
        return self._match(found[0]) if len(found) == 1 else b"".join(map(self._match, found))

    def encode(self, texts: list[bytes | None], end: int) -> Iterator[bytes]:
        tail = end.to_bytes(4, "little")
        if self.pattern is None:
            for at in range(0, len(texts), 64):
                for got in self.tokenizer.encode_batch_fast([(t or b"").decode() for t in texts[at : at + 64]], add_special_tokens=False):
                    yield np.array(got.ids, "<u4").tobytes() + tail
            return
        known = self.words
        for text in texts:
            if len(known) > CACHE or len(self.matches) > CACHE:
                self.trim()
            yield b"".join([*map(known.__getitem__, (text or b"").split()), tail])


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One cache a worker process, kept from task to task."""
    return WordIds(path)


class Packer:
    """The open windows of one partition; finished pieces collect in ``done``."""

    def __init__(self, size: int, windows: int, max_gap: int, stage: int, part: int, keep_ids: bool) -> None:
        self.size, self.windows, self.max_gap, self.keep_ids, self.part = size, windows, max_gap, keep_ids, part
        self.open: list[list] = []  # [tokens used, pieces]
        self.done: list[tuple] = []
        self.next_id = (stage << 58) | (part << 34)

    def emit(self, pieces: list[tuple], is_open: bool = False) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, ids if self.keep_ids or is_open else None, zlib.crc32(ids), total, self.next_id, at, self.part, is_open))
            at += n
        self.next_id += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        size, open_ = self.size, self.open
        while len(ids) >= 4 * size:
            self.emit([(doc, start, ids[: 4 * size], total)])
            ids, start = ids[4 * size :], start + size
        while ids:
            n = len(ids) // 4
            fit = max((w for w in open_ if w[0] + n <= size), key=lambda w: w[0], default=None)
            if fit is not None:
                fit[0] += n
                fit[1].append((doc, start, ids, total))
                if fit[0] == size:
                    open_.remove(fit)
                    self.emit(fit[1])
                return
            if len(open_) < self.windows:
                open_.append([n, [(doc, start, ids, total)]])
                return
            fullest = max(open_, key=lambda w: w[0])
            gap = size - fullest[0]
            if gap > self.max_gap:
                fullest[1].append((doc, start, ids[: 4 * gap], total))
                ids, start = ids[4 * gap :], start + gap
            open_.remove(fullest)
            self.emit(fullest[1])

    def close(self) -> None:
        for _, pieces in self.open:
            self.emit(pieces, True)
        self.open = []

    def batch(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_ARROW), _ARROW)], names=_NAMES)


def _first_level(docs: DataFrame, path: str, end: int, size: int, windows: int, max_gap: int, keep_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, words = Packer(size, windows, max_gap, 0, TaskContext.get().partitionId(), keep_ids), word_ids(path)
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist(), end)):
                packer.add(doc, 0, ids, len(ids) // 4)
                if len(packer.done) > 4096:
                    yield packer.batch()
        words.trim()
        packer.close()
        yield packer.batch()

    return docs.mapInArrow(run, _SCHEMA)


def _merge(open_: DataFrame, size: int, level: int, keep_ids: bool, last: bool) -> DataFrame:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        packer = Packer(size, 1, 0, level, key[0].as_py(), keep_ids)
        rows = table.select(["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]).sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        for r in rows:
            packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        if last:
            for _, pieces in packer.open:
                packer.emit(pieces)
        else:
            packer.close()
        return pa.Table.from_batches([packer.batch()])

    return open_.groupBy("part").applyInArrow(run, _SCHEMA)


def pack(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, windows: int = 32, max_gap: int = 16, fan_in: int = 8, keep_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit; null without ``keep_ids``),
    ids_crc32, doc_tokens, sequence_id, offset.  ``tokenizer`` is the path of a vocabulary file."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    packed = materialize(_first_level(rows, tokenizer, end, size, windows, max_gap, keep_ids), "packed")
    out, left, level = packed.where("NOT open"), packed.where("open"), 1
    parts = (packed.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // fan_in)
        merged = materialize(_merge(left.withColumn("part", F.expr(f"part div {fan_in}")), size, level, keep_ids, parts == 1), "merged")
        out = out.unionAll(merged.where("NOT open"))
        if parts == 1:
            return out.drop("part", "open")
        left, level = merged.where("open"), level + 1


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, keep_ids=False))
