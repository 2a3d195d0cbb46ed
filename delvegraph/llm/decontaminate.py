"""Benchmark decontamination with a generalised suffix automaton over words.

All normalised benchmark items go into one automaton (built item by item, so no
path crosses items).  Documents stream through it word by word; the automaton
keeps the longest suffix of the words read so far that occurs in some item.
Where that length reaches ``window`` words, or a whole shorter item ends, the
words it spans are hit.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delvegraph.llm.storage import drop, materialize
from delvegraph.llm.textkit import slices
from delvegraph.llm.worker import tidy

#: Letters, digits and every non-ASCII byte make words; A-Z is lower-cased.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

#: Benchmark words in one automaton (about 40 bytes each in a task); a larger benchmark takes several, one pass over
#: the documents each.
BLOCK_WORDS = 500_000


def words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8 bytes; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class ItemAutomaton:
    """Suffix automaton of word sequences with the items known at each state.

    Built with a dictionary of edges for each state; then laid out in flat arrays,
    as all but a few states have one edge and one item.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.names: list[str] = []
        self._next: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]
        paths = []
        for name, item in items:
            if not item:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in item]
            paths.append((len(self.names), ids))
            self.names.append(name)
            last = 0
            for c in ids:
                last = self._extend(last, c)
        n = len(self._next)
        #: Of each state: the item known there (-1: none; -2: those in ``several``).
        self.owner = array("i", [-1]) * n
        self.several: dict[int, tuple[int, ...]] = {}
        owners: dict[int, set[int]] = {}
        whole: dict[int, list[int]] = {}
        mark = array("i", [-1]) * n
        for k, ids in paths:
            v = 0
            for c in ids:
                v = u = self._next[v][c]
                while u > 0 and mark[u] != k:
                    mark[u] = k
                    if self.owner[u] == -1:
                        self.owner[u] = k
                    elif self.owner[u] != k:
                        owners.setdefault(u, {self.owner[u]}).add(k)
                    u = self._link[u]
            if len(ids) < window:
                whole.setdefault(v, []).append(k)
        for u, o in owners.items():
            self.owner[u], self.several[u] = -2, tuple(sorted(o))
        #: Short items that are a state's longest string, as (length, items).
        self.whole = {v: (self._length[v], tuple(k)) for v, k in whole.items()}
        #: For every state, the suffix state that holds its last ``window`` words.
        self.at_window = array("i", [0]) * n
        #: For every state, itself or the nearest suffix state at which a short item ends; 0: none.
        self.ends = array("i", [0]) * n
        for v in sorted(range(1, n), key=self._length.__getitem__):
            p = self._link[v]
            if self._length[v] >= window:
                self.at_window[v] = v if self._length[p] < window else self.at_window[p]
            self.ends[v] = v if v in self.whole else self.ends[p]
        self.link, self.length = array("i", self._link), array("i", self._length)
        #: The one edge of a state (word, target); states with more have theirs in ``branch``.
        self.word, self.target = array("i", [-1]) * n, array("i", [0]) * n
        self.branch: dict[int, dict[int, int]] = {}
        for v, edges in enumerate(self._next):
            if len(edges) == 1:
                self.word[v], self.target[v] = next(iter(edges.items()))
            elif edges:
                self.branch[v] = edges
        del self._next, self._link, self._length

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self._next.append(edges)
        self._link.append(link)
        self._length.append(length)
        return len(self._next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self._length[p] + 1, self._link[q], dict(self._next[q]))
        while p >= 0 and self._next[p].get(c) == q:
            self._next[p][c] = clone
            p = self._link[p]
        self._link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self._next[last].get(c)
        if q is not None:
            return q if self._length[q] == self._length[last] + 1 else self._split(last, c, q)
        cur = self._state(self._length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self._next[p]:
            self._next[p][c] = cur
            p = self._link[p]
        if p >= 0:
            q = self._next[p][c]
            self._link[cur] = q if self._length[q] == self._length[p] + 1 else self._split(p, c, q)
        return cur

    def hits(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal runs of hit words (start, stop) and the items with occurring windows."""
        runs: list[tuple[int, int]] = []
        seen: set[int] = set()
        done: set[int] = set()  # states whose items are in ``seen``
        window, word, target, branch, link, length, ends, whole = self.window, self.word, self.target, self.branch, self.link, self.length, self.ends, self.whole
        none: dict[int, int] = {}
        state = size = 0
        for i, c in enumerate(map(self.vocab.get, doc)):
            if c is None:
                state = size = 0
                continue
            if word[state] == c:
                state, size = target[state], size + 1
            else:
                to = branch.get(state, none).get(c)
                if to is None:
                    while state > 0:
                        state = link[state]
                        to = target[state] if word[state] == c else branch.get(state, none).get(c)
                        if to is not None:
                            break
                    size = length[state]
                    if to is None:
                        size = 0
                        continue
                state, size = to, size + 1
            reach = 0
            if size >= window:
                at = self.at_window[state] if length[state] >= window else state
                if at not in done:
                    done.add(at)
                    seen.update(self.several[at] if self.owner[at] == -2 else (self.owner[at],))
                reach = window
            e = ends[state]
            if e:
                while length[e] > size:  # only the state itself may be longer than what was read
                    e = ends[link[e]]
                reach = max(reach, length[e])
                while e and e not in done:  # what ends below a state that is done is done
                    done.add(e)
                    seen.update(whole[e][1])
                    e = ends[link[e]]
            if reach:
                start = i + 1 - reach
                while runs and runs[-1][1] >= start:
                    start = min(start, runs.pop()[0])
                runs.append((start, i + 1))
        return runs, seen


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@tidy("overlap")
def _scan(batches: Iterator[pa.RecordBatch], automaton: ItemAutomaton, one_in: int | None = None) -> Iterator[pa.RecordBatch]:
    """Merge what ``automaton`` finds into each row; with ``one_in``, contaminated rows
    go and hit words are cut out of the others."""
    for batch in (part for whole in batches for part in slices(whole, "scan_text")):
        n_words, spans, items = [], [], []
        for text, runs, seen in zip(batch["scan_text"].to_pylist(), batch["spans"].to_pylist(), batch["items"].to_pylist(), strict=True):
            w = words(text)
            more, found = automaton.hits(w)
            n_words.append(len(w))
            spans.append([{"start": a, "stop": b} for a, b in _merge(more + [(r["start"], r["stop"]) for r in runs])])
            items.append(sorted({*seen, *(automaton.names[k] for k in found)}))
        done = {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, _SPANS), "items": pa.array(items, pa.list_(pa.string()))}
        if one_in is not None:
            texts = batch["scan_text"].to_pylist()
            hits = [sum(s["stop"] - s["start"] for s in x) for x in spans]
            for i, x in enumerate(spans):
                if x and hits[i] * one_in < n_words[i]:
                    texts[i] = cut_words(texts[i], [(s["start"], s["stop"]) for s in x])
            done["scan_text"] = pa.array(texts, pa.string())
            clean = pa.array([not h or h * one_in < n for h, n in zip(hits, n_words, strict=True)], pa.bool_())
        out = pa.RecordBatch.from_arrays([done.get(n, batch[n]) for n in batch.schema.names], names=batch.schema.names)
        yield out if one_in is None else out.filter(clean)


def item_blocks(benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Benchmark items as word lists, streamed in blocks of a bounded word count.

    An item longer than the bound goes in parts that overlap by ``window`` - 1 words,
    so that every window lies in one.  Items of equal id and different text are one
    item with several windows; a null id is the empty string.
    """
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    most = max(block_words, 2 * window)
    for item_id, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        whole = words(text)
        for at in range(0, max(1, len(whole) - window + 1), most - window + 1):
            w = whole[at : at + most]
            if w and block and size + len(w) > block_words:
                yield block
                block, size = [], 0
            if w:
                block.append((item_id if item_id is not None else "", w))
                size += len(w)
    yield block


def _with_overlap(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, block_words: int, one_in: int | None = None) -> DataFrame:
    """``docs`` plus scan_text, n_words, spans and items; the last block's pass cuts."""
    spark = docs.sparkSession
    out = docs.withColumn(text_col, F.col(text_col).cast("string")).withColumnRenamed(text_col, "scan_text").withColumns(
        {
            "n_words": F.lit(None).cast("long"),
            "spans": F.array().cast("array<struct<start:long,stop:long>>"),
            "items": F.array().cast("array<string>"),
        }
    )
    blocks, table = item_blocks(benchmark, window, block_words), None
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        shared = spark.sparkContext.broadcast(ItemAutomaton(block, window))
        last = one_in if after is None else None
        out = out.mapInArrow(lambda it, s=shared, c=last: _scan(it, s.value, c), out.schema)
        if after is not None:  # one automaton at a time in a worker
            before, table = table, materialize(out, "overlap-block")
            if before is not None:
                drop(before)
            shared.destroy()
            out = table
        block = after
    return out


def find_overlap(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_words, spans (runs of hit words), items.

    Null and wordless texts have no words; items without words have no
    windows; rows with equal ids are scanned one by one; an empty benchmark
    hits nothing and an empty table gives an empty result.  No shuffle.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _with_overlap(source, benchmark, window, "text", block_words).select("doc_id", "n_words", "spans", "items")


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])


def is_contaminated(n_words: Column, hit: Column, one_in: int = 20) -> Column:
    """Some word is hit, and at least one in ``one_in``."""
    return (hit > 0) & (hit * one_in >= n_words)


def remove_overlap(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with its columns, without contamination.

    A document with at least one hit word in ``one_in`` goes.  In others the
    characters of each hit run, from the first of its words to the last, are
    cut out of the text.
    """
    others = [c for c in docs.columns if c != text_col]
    source = docs.select(F.struct(*(f"`{c}`" for c in others)).alias("row") if others else F.lit(None).cast("int").alias("row"), F.col(text_col).alias("text"))
    cleaned = _with_overlap(source, benchmark, window, "text", block_words, one_in)
    return cleaned.select(*(F.col("scan_text").cast(t).alias(c) if c == text_col else F.col("row")[c].alias(c) for c, t in docs.dtypes))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters of the word runs ``spans``."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    keep, last = [], 0
    for start, stop in spans:
        keep.append(raw[last : at[start][0]])
        last = at[stop - 1][1]
    return b"".join([*keep, raw[last:]]).decode("utf-8", "surrogatepass")
