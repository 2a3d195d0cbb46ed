"""Token counts of whole texts, from overlapping chunks that are spliced.

A text longer than ``chunk`` characters is encoded as chunks that overlap.
Two neighbours are spliced at a boundary that both have and that is proven: a
word starts there, right after white space, with a character that composes with
nothing before it.  The vocabulary's word pattern never crosses white space and
remembers nothing from one word to the next, so both encodings read the same
words from there on; that they agree up to the last whole word of the overlap is
checked too.  Where no such boundary exists, the overlap is widened until one
does or the rest of the document is one chunk.

Texts of more than ``segment`` characters are cut once more, into overlapping
segments that different tasks encode: both tasks at a cut find the same boundary
behind it and report the ids they read from there on.  A text whose segments do
not agree is counted whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delvegraph.llm.encoding import WordEncoder, default_path, encoder
from delvegraph.llm.storage import materialize, shuffle_partitions
from delvegraph.llm.textkit import slices
from delvegraph.llm.worker import tidy

#: Characters of a chunk, of an overlap, and of what one task encodes of a huge text.
CHUNK, OVERLAP, SEGMENT = 1024, 48, 1 << 20
_RUN = re.compile(r"\S+")


def _stable(text: str, p: int) -> bool:
    c = text[p]
    return text[p - 1].isspace() and not ("\x1c" <= text[p - 1] <= "\x1f") and (c.isascii() or (unicodedata.combining(c) == 0 and unicodedata.is_normalized("NFC", text[p - 1] + c) and not "ᅠ" <= c <= "ᇿ"))


class Chunk:
    """The encoding of ``text[a:b]``: its ids by the places where their words start."""

    def __init__(self, enc: WordEncoder, text: str, a: int, b: int):
        self.text, self.a, self.b, self.width = text, a, b, enc.width
        part = text[a:b]
        self.plain = enc.plain(part)
        if self.plain:  # words of plain texts are found in the encoder's memory, run by run
            self.runs = enc.packed(part.lower().split())
            self.n = sum(map(len, self.runs)) // self.width
        else:
            e = enc.tokenizer.encode(part, add_special_tokens=False)
            self.ids = np.array(e.ids, dtype=enc.dtype)
            self.at = np.array([s for s, _ in e.offsets], dtype=np.int64) + a
            word = np.array([-1 if w is None else w for w in e.word_ids], dtype=np.int64)
            first = np.ones(len(word), dtype=bool)
            first[1:] = (word[1:] != word[:-1]) | (word[1:] < 0)
            self.first, self.n = first, len(e.ids)

    def starts(self, lo: int, hi: int) -> set[int]:
        """Places after ``lo`` and before ``hi`` where a word starts."""
        if self.plain:
            return {m.start() for m in _RUN.finditer(self.text, lo, hi) if m.start() > lo}
        return set(self.at[self.first & (self.at > lo) & (self.at < hi)].tolist())

    def _after(self, p: int) -> int:
        return len(self.text[p : self.b].split())

    def until(self, p: int) -> int:
        """Tokens before the word start ``p``."""
        if not self.plain:
            return int(np.count_nonzero(self.at < p))
        k = self._after(p)
        return self.n - (sum(map(len, self.runs[-k:])) // self.width if k else 0)

    def between(self, p: int, q: int) -> bytes:
        """Packed ids of the words from ``p`` to ``q``, where words start or white space stands."""
        if not self.plain:
            return self.ids[(self.at >= p) & (self.at < q)].tobytes()
        n, k = len(self.runs), self._after(q)
        return b"".join(self.runs[n - self._after(p) : n - k])


def splice(left: Chunk, right: Chunk, text: str, begin: int, stop: int) -> int | None:
    """The first proven boundary of the overlap ``begin:stop`` at which both
    encodings go on alike, or None."""
    last = stop - 1
    while last > begin and not text[last].isspace():
        last -= 1  # the word that the left chunk may have cut
    for p in sorted(left.starts(begin, last) & right.starts(begin, last)):
        if _stable(text, p) and left.between(p, last) == right.between(p, last):
            return p
    return None


def count_chunked(enc: WordEncoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, as the library gives for the whole of it."""
    n, stop = len(text), min(chunk, len(text))
    left = Chunk(enc, text, 0, stop)
    total, floor = 0, 0  # tokens before ``floor`` are counted
    while stop < n:
        width, at = overlap, None
        while at is None:
            begin = max(floor, stop - width)
            to = min(n, begin + max(chunk, 2 * width))
            right = Chunk(enc, text, begin, to)
            at = splice(left, right, text, begin, stop)
            if at is None:
                if begin == floor:  # no boundary in all of the left chunk: read it again, longer
                    to = min(n, floor + 2 * (stop - floor))
                    left, stop = Chunk(enc, text, floor, to), to
                    break
                width *= 2
        if at is None:
            continue
        total += left.until(at) - (left.until(floor) if floor > left.a else 0)
        left, floor, stop = right, at, to
    return total + left.n - (left.until(floor) if floor > left.a else 0)


def _border(text: str, cut: int, reach: int) -> int | None:
    """The first proven boundary after ``cut`` and before the last whole word of ``reach`` characters."""
    for m in _RUN.finditer(text, cut, min(len(text), cut + reach)):
        if m.start() > cut and _stable(text, m.start()):
            return m.start()
    return None


def count_segment(enc: WordEncoder, text: str, before: int, size: int, reach: int, first: bool, last: bool, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, bool, int, int]:
    """(tokens, whether both ends were found, marks of what was read behind either end) of a segment:
    ``text`` is its ``size`` characters with ``before`` others ahead of them and up to ``reach`` behind."""
    lo = 0 if first else _border(text, before, reach)
    hi = len(text) if last else _border(text, before + size, reach)
    if lo is None or hi is None or hi < lo:
        return 0, False, 0, 0
    end = len(text) - 1
    while end > hi and not text[end].isspace():
        end -= 1
    mark = lambda a, p, q: zlib.crc32(Chunk(enc, text, a, q).between(p, q))
    stop = lambda p: min(p + reach // 2, len(text))
    words = lambda p: max((m.start() for m in _RUN.finditer(text, p, stop(p))), default=p)
    return count_chunked(enc, text[lo:hi], chunk, overlap), True, 0 if first else mark(0, lo, words(lo)), 0 if last else mark(max(0, hi - chunk), hi, words(hi))


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, segment: int = SEGMENT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens.

    Null text is empty: no bytes, no tokens.  No special tokens are added; their
    strings in a text are read as the library does by default.  Rows with equal
    ids are counted one by one; an empty table gives an empty result; other
    columns are not read.  ``path`` names the vocabulary on the executors.
    """
    path = path or default_path()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    kind = dict(source.dtypes)["doc_id"]

    @tidy("tokens")
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in (part for all_ in batches for part in slices(all_, "text")):
            n = [count_chunked(enc, t, chunk, overlap) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    huge = F.coalesce(F.length("text"), F.lit(0)) > segment
    out = source.filter(~huge).mapInArrow(whole, f"doc_id {kind}, n_bytes long, n_tokens long")
    big = source.filter(huge)
    if not big.limit(1).count():
        return out

    reach = max(4 * overlap, min(4096, segment // 4))

    @tidy("tokens")
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in (part for all_ in batches for part in slices(all_, "text")):
            rows = [count_segment(enc, t, reach if k else 0, segment, reach, k == 0, k == n - 1, chunk, overlap) for t, k, n in zip(*(batch[c].to_pylist() for c in ("text", "k", "parts")), strict=True)]
            n, ok, lo, hi = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["k"], pa.array(n, pa.int64()), pa.array(ok), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["key", "k", "n", "ok", "lo", "hi"])

    # written with their keys, so that a retry deals the same ones
    big = materialize(big.withColumn("key", F.monotonically_increasing_id()), "huge-texts")
    parts = F.ceil(F.length("text") / segment).cast("int")
    cut = big.withColumn("parts", parts).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    begin = F.greatest(F.col("k") * segment - reach, F.lit(0))
    cut = cut.select("key", "k", "parts", F.substring("text", begin + 1, (F.col("k") + 1) * segment + reach - begin).alias("text"))
    counted = materialize(cut.repartition(shuffle_partitions(docs.sparkSession), "key", "k").mapInArrow(part, "key long, k int, n long, ok boolean, lo long, hi long"), "segments")
    ahead = counted.select("key", (F.col("k") + 1).alias("k"), F.col("hi").alias("before"))
    alike = counted.join(ahead, ["key", "k"], "left").groupBy("key").agg(F.sum("n").cast("long").alias("n_tokens"), F.bool_and(F.col("ok") & ((F.col("k") == 0) | F.coalesce(F.col("before") == F.col("lo"), F.lit(False)))).alias("alike"))
    known = big.drop("text").join(alike.filter("alike"), "key").select("doc_id", "n_bytes", "n_tokens")
    rest = big.join(alike.filter("not alike").select("key"), "key", "left_semi").select("doc_id", "text", "n_bytes")
    return out.unionByName(known).unionByName(rest.mapInArrow(whole, f"doc_id {kind}, n_bytes long, n_tokens long"))
