"""Language identification with a linear-chain conditional random field.

Every word of a text is a position of the chain.  Its features are affixes,
character n-grams and membership in learned lexicons; transitions between
languages are learned too, so words of code-switched text get their own labels.
Forward-backward gives each word its label distribution; a document's language is
the label with the largest share of its words, its score that share.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delvegraph.llm.storage import drop, materialize
from delvegraph.llm.textkit import mix, slices
from delvegraph.llm.worker import hold, tidy

UNKNOWN = "und"
BUCKETS = 1 << 15
#: Bounds of the fitting sample: documents and word windows of each language, words of a window.
SAMPLE_DOCS, WINDOWS, WINDOW = 300, 900, 48
LEXICON = 400
EPOCHS, BATCH, RATE, DECAY = 2, 64, 0.6, 1e-4
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none if the text has no letter."""
    found = _WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found[:64] for c in w) or any(c.isalpha() for w in found for c in w) else []


@dataclass
class Crf:
    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def features(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(feature of each place, first place of each word): affixes of 1 to 4,
        2- and 3-grams with word ends, lexicon entry, and a constant."""
        marked = np.frombuffer("".join(f"\x02{w}\x03" for w in vocabulary).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        size = np.array([len(w) + 2 for w in vocabulary])
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(vocabulary)), size)
        end = np.repeat(begin + size, size)
        at = np.arange(len(marked))
        who, what = [np.arange(len(vocabulary))], [np.full(len(vocabulary), BUCKETS + len(self.lexicon))]
        with np.errstate(over="ignore"):
            gram = np.full(len(marked), np.uint64(0))
            padded = np.concatenate([marked, np.zeros(6, np.uint64)])
            for n in range(1, 6):
                gram = mix(gram * np.uint64(31) + padded[at + n - 1] + np.uint64(n << 40))
                inside = at + n <= end
                if n in (2, 3):
                    who.append(owner[inside])
                    what.append((gram[inside] % np.uint64(BUCKETS)).astype(np.int64))
                if n >= 3:  # the mark and 2 to 4 letters, from either end
                    for first in (begin, begin + size - n):
                        ok = size >= n
                        who.append(np.flatnonzero(ok))
                        what.append((mix(gram[first[ok]] + np.uint64(977)) % np.uint64(BUCKETS)).astype(np.int64))
        known = [(i, self.lexicon[w]) for i, w in enumerate(vocabulary) if w in self.lexicon]
        if known:
            i, k = zip(*known, strict=True)
            who.append(np.array(i))
            what.append(np.array(k) + BUCKETS)
        who, what = np.concatenate(who), np.concatenate(what)
        order = np.argsort(who, kind="stable")
        return what[order], np.searchsorted(who[order], np.arange(len(vocabulary)))

    def emissions(self, vocabulary: list[str]) -> np.ndarray:
        """Label scores of each word."""
        if not vocabulary:
            return np.zeros((0, len(self.labels)), np.float32)
        what, first = self.features(vocabulary)
        return np.add.reduceat(self.weights[what], first, axis=0)


def marginals(em: np.ndarray, at: np.ndarray, length: np.ndarray, transition: np.ndarray, start: np.ndarray, pairs: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Label distributions of every position of many chains by forward-backward.

    ``em`` holds the label scores of all positions; chain ``i`` starts at
    ``at[i]`` and has ``length[i]`` of them, longest chains first.  With
    ``pairs`` also the expected number of each transition in all chains.
    """
    e = np.exp(em - em.max(axis=1, keepdims=True))
    t = np.exp(transition - transition.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left").tolist()
    prev = None
    for k, n in enumerate(live):
        p = at[:n] + k
        a = e[p] * (np.exp(start - start.max()) if prev is None else prev[:n] @ t)
        a /= a.sum(axis=1, keepdims=True)
        alpha[p] = a
        prev = a
    expected = np.zeros(t.shape)
    for k in range(len(live) - 1, 0, -1):
        p = at[: live[k]] + k
        ahead = e[p] * beta[p]  # what this place and those after it say of its label
        if pairs:
            both = alpha[p - 1][:, :, None] * t * ahead[:, None, :]
            expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = ahead @ t.T
        beta[p - 1] = b / b.sum(axis=1, keepdims=True)
    alpha *= beta
    alpha /= alpha.sum(axis=1, keepdims=True)
    return (alpha, expected) if pairs else alpha


def fit(rows: list[tuple[str, list[str]]]) -> Crf:
    """Learn from (language, words of a window); windows of two languages are spliced to teach transitions."""
    labels = sorted({lang for lang, _ in rows})
    code = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(11)
    windows: list[list[list[str]]] = [[] for _ in labels]
    counts = [Counter() for _ in labels]
    for lang, w in rows:
        counts[code[lang]].update(w)
        windows[code[lang]].append(w)
    lexicon: dict[str, int] = {}
    for c in counts:
        for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if n > 1:
                lexicon.setdefault(w, len(lexicon))
    n = len(labels)
    model = Crf(labels, lexicon, np.zeros((BUCKETS + len(lexicon) + 1, n), np.float32), np.zeros((n, n), np.float32), np.zeros(n, np.float32))
    chains: list[tuple[list[str], list[int]]] = []
    for k, own in enumerate(windows):
        for i in rng.permutation(len(own)).tolist():
            w, y = own[i], [k] * len(own[i])
            other = int(rng.integers(0, n))
            if rng.random() < 0.3 and windows[other]:
                more = windows[other][int(rng.integers(0, len(windows[other])))]
                cut = int(rng.integers(0, len(w) + 1))
                w, y = w[:cut] + more[cut:], y[:cut] + [other] * len(more[cut:])
            if w:
                chains.append((w, y))
    vocabulary = sorted({w for c, _ in chains for w in c})
    index = {w: i for i, w in enumerate(vocabulary)}
    if not vocabulary:
        return model
    what, first = model.features(vocabulary)
    last = np.append(first[1:], len(what))
    squares = [np.full_like(model.weights, 1e-2), np.full_like(model.transition, 1e-2), np.full_like(model.start, 1e-2)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for b in range(0, len(order), BATCH):
            batch = sorted((chains[i] for i in order[b : b + BATCH].tolist()), key=lambda c: -len(c[0]))
            ids = np.array([index[w] for c, _ in batch for w in c])
            y = np.array([v for _, c in batch for v in c])
            length = np.array([len(c) for c, _ in batch])
            at = np.cumsum(length) - length
            types, place = np.unique(ids, return_inverse=True)
            spans = [np.arange(first[t], last[t]) for t in types]
            own = np.repeat(np.arange(len(types)), [len(s) for s in spans])
            feats = what[np.concatenate(spans)]
            em = np.add.reduceat(model.weights[feats], np.cumsum([0] + [len(s) for s in spans[:-1]]), axis=0)[place]
            p, expected = marginals(em, at, length, model.transition, model.start, pairs=True)
            gap = p.copy()
            gap[np.arange(len(y)), y] -= 1
            gap /= len(batch)
            by_type = np.zeros((len(types), n), np.float32)
            np.add.at(by_type, place, gap.astype(np.float32))
            used, back = np.unique(feats, return_inverse=True)
            g = np.zeros((len(used), n), np.float32)
            np.add.at(g, back, by_type[own])
            g += DECAY * model.weights[used]
            squares[0][used] += g * g
            model.weights[used] -= RATE * g / np.sqrt(squares[0][used])
            after = np.ones(len(y), dtype=bool)
            after[at] = False
            i = np.flatnonzero(after)
            gt = expected  # less what was observed
            np.subtract.at(gt, (y[i - 1], y[i]), 1)
            gs = p[at].sum(axis=0) - np.bincount(y[at], minlength=n)
            for param, grad, sq in ((model.transition, gt / len(batch), squares[1]), (model.start, gs / len(batch), squares[2])):
                sq += grad * grad
                param -= (0.1 * grad / np.sqrt(sq)).astype(np.float32)
    return model


class Labeller:
    """A model with the scores of the words met so far (a bounded memory)."""

    def __init__(self, model: Crf, memory: int = 250_000):
        self.model, self.memory = model, memory
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.labels)), np.float32)

    def _learn(self, new: list[str]) -> None:
        begin, stop = len(self.index), len(self.index) + len(new)
        if stop > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(stop - len(self.table), len(self.table)), self.table.shape[1]), np.float32)])
        for i in range(0, len(new), 20_000):
            self.table[begin + i : begin + min(i + 20_000, len(new))] = self.model.emissions(new[i : i + 20_000])
        self.index.update(zip(new, range(begin, stop), strict=True))

    def shares(self, docs: list[list[str]]) -> np.ndarray:
        """For each list of words, the mean label distribution; zeros without words."""
        out = np.zeros((len(docs), len(self.model.labels)))
        if len(self.index) > self.memory:
            self.index = {}
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        order = [i for i in order if docs[i]]
        if not order or not self.model.labels:
            return out
        new = list({w for d in docs for w in d}.difference(self.index))
        if new:
            self._learn(new)
        get = self.index.__getitem__
        length = np.array([len(docs[i]) for i in order])
        at = np.cumsum(length) - length
        ids = np.fromiter((k for i in order for k in map(get, docs[i])), np.int64, int(length.sum()))
        p = marginals(self.table[ids], at, length, self.model.transition, self.model.start)
        out[order] = np.add.reduceat(p, at, axis=0) / length[:, None]
        return out


@tidy("language")
def _predict(batches: Iterator[pa.RecordBatch], shared, place: int, kept: int) -> Iterator[pa.RecordBatch]:
    labeller = hold("language", ("labeller", shared.id), lambda: Labeller(shared.value[1]))
    labels = labeller.model.labels
    for batch in (part for whole in batches for part in slices(whole, whole.schema.names[place], 16 << 20)):
        texts = batch.column(place).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i] or ""))
        pred: list[str] = [UNKNOWN] * len(texts)
        score = [0.0] * len(texts)
        group: list[int] = []
        size = 0
        for k, i in enumerate(order):
            group.append(i)
            size += len(texts[i] or "")
            if size > 2_000_000 or k == len(order) - 1:
                found = [words(texts[j]) for j in group]
                shares = labeller.shares(found)
                for j, w, s in zip(group, found, shares, strict=True):
                    if w and labels:
                        best = int(s.argmax())
                        pred[j], score[j] = labels[best], min(1.0, max(0.0, float(s[best])))
                group, size = [], 0
        del texts
        yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:kept], "lang_pred", "score"])


def held_out(doc_id: Column, of: int = 4, rest: int = 2) -> Column:
    """crc32 of the id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == rest, F.lit(False))


@tidy("language")
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "t", 1 << 20)):
        out = [(lang, " ".join(w[k : k + WINDOW])) for lang, text in zip(batch["l"].to_pylist(), batch["t"].to_pylist(), strict=True) for w in [words(text)] for k in range(0, len(w), WINDOW)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["l", "w"])


def _some(rows: DataFrame, lang: str, key: Column, most: int) -> DataFrame:
    """About ``most`` rows of each language, and never more, by the hash ``key``."""
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # a row for each language
    if not sizes:
        return rows
    draw = F.pmod(key, F.lit(1 << 20))
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 1.3 * most / n)))), F.col(lang))
    nth = F.row_number().over(Window.partitionBy(lang).orderBy("__d", "__r"))
    return rows.withColumn("__d", draw).withColumn("__r", key).filter(F.col("__d") < share * (1 << 20)).withColumn("__n", nth).filter(F.col("__n") <= most).drop("__d", "__r", "__n")


def fit_on(docs: DataFrame, learn: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, windows: int = WINDOWS) -> Crf:
    """Fit on ``sample_docs`` documents of each language at most, and ``windows`` windows of
    their whole texts, among the rows where ``learn`` holds, chosen by hashes.

    Null texts and languages teach nothing; repeated rows are rows of their own;
    an empty table gives a model without labels.  Only the drawn windows, a
    bounded number of bounded size, come to the driver.
    """
    usable = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"), F.col(id_col).cast("string").alias("i"))
    chosen = _some(usable, "l", F.xxhash64("i", F.xxhash64("t"), F.lit(17)), sample_docs)
    cut = materialize(chosen.select("l", "t").mapInArrow(_windows, "l string, w string"), "language-windows")
    taken = _some(cut, "l", F.xxhash64("w", F.lit(18)), windows).orderBy("l", "w").collect()
    drop(cut)
    if not taken:
        return Crf([], {}, np.zeros((BUCKETS + 1, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    return fit([(r.l, r.w.split(" ")) for r in taken])


def identify(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: the columns ``keep`` (the id), lang_pred, score.

    A text that is null or has no letter is ``und`` with score 0.  Language,
    source and id are not read by a prediction.  Long texts are one chain; rows
    of equal ids are judged one by one; columns named like the two new ones, or
    like any other name used here, may be kept and an empty table gives an empty
    result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((None, model))
    kept = [id_col] if keep is None else keep
    n = len(kept)
    own = kept.index(text_col) if text_col in kept else n  # a kept text crosses to Python once
    source = docs.select(*(F.col(f"`{c}`") for c in kept), *([] if own < n else [F.col(text_col).alias("__text")]))
    box = _Shared(shared)
    fields = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[:n])
    return source.mapInArrow(lambda it: _predict(it, box, own, n), f"{fields}, lang_pred string, score double")


class _Shared:
    """A broadcast with a name that tells models apart in a worker."""

    def __init__(self, broadcast):
        self._broadcast = broadcast
        self.id = broadcast._jbroadcast.id()

    @property
    def value(self):
        return self._broadcast.value

    def __getstate__(self):
        return {"_broadcast": self._broadcast, "id": self.id}
