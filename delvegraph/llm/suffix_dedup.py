"""Removal of repeated byte strings by deep-shallow suffix sorting.

A string of ``length`` bytes is removed wherever it also starts earlier.  Sorting
all suffixes of a 100 TB corpus would move every byte many times, so suffixes are
first dealt by content:

1. Every ``length``-byte string has an anchor, the leftmost of its ``GRAM``-byte
   grams with the least hash.  Equal strings have equal anchors at equal places.
   Consecutive strings of one anchor form a block; only its two hashes travel.
2. Blocks equal to an earlier one are repeated whole.  A gram with several
   different blocks needs their suffixes sorted; the first of each is fetched.
3. Those suffixes are dealt again by the bytes on one side of the anchor and
   sorted to depth ``length``: multikey quicksort, whose characters are eight bytes,
   to the depth ``SHALLOW``, then blind tries for the groups whose common prefix is
   longer (a trie of two strings is one comparison).  Of suffixes equal to the full depth, all but the earliest are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delvegraph.llm.ranking import global_rank
from delvegraph.llm.storage import drop, materialize, shuffle_partitions
from delvegraph.llm.textkit import mix, slices
from delvegraph.llm.worker import tidy

GRAM, SHALLOW = 24, 32
#: Bytes of text in one numpy step, and of a segment of a longer text.
STEP, SEGMENT = 1 << 20, 1 << 22
#: Bytes of text for each bucket of grams and suffixes, whatever the size of the corpus.
PART_BYTES = 32 << 20
_POSITION = np.uint64(24)
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}

OCCURRENCE = np.dtype([("gram", "<u8"), ("block", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("lead", "<u2"), ("size", "<u2")])
REQUEST = np.dtype([("start", "<i4"), ("lead", "<u2"), ("size", "<u2")])
INTERVAL = np.dtype([("a", "<i4"), ("b", "<i4")])
CONTEXT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("lead", "<u2"), ("n", "<u2")])


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _TABLES.get(int(base))
    if held is None or len(held[0]) < n:
        out = []
        for b in (base, np.uint64(pow(int(base), -1, 1 << 64))):
            step = np.full(max(n, 1 << 16), b, np.uint64)
            step[0] = 1
            out.append(np.multiply.accumulate(step))
        held = _TABLES[int(base)] = (out[0], out[1])
    return held


class _Rolling:
    """Hashes of any substring of a buffer."""

    def __init__(self, raw: np.ndarray, base: np.uint64):
        self.power, self.inverse = _powers(base, len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * self.power[: len(raw)], out=self.total[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.total[b] - self.total[a]) * self.inverse[a])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.total) - k
        return mix((self.total[k:] - self.total[:-k]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def blocks(docs: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    """The blocks (OCCURRENCE) of some texts."""
    pieces = [(d, s, t[s : s + SEGMENT + length - 1]) for d, t in zip(docs.tolist(), texts, strict=True) if len(t) >= length for s in range(0, len(t) - length + 1, SEGMENT)]
    out, group, size = [], [], 0
    for i, piece in enumerate(pieces):
        group.append(piece)
        size += len(piece[2])
        if size >= STEP or i == len(pieces) - 1:
            out.append(_blocks(group, length))
            group, size = [], 0
    return np.concatenate(out) if out else np.zeros(0, OCCURRENCE)


def _blocks(pieces: list[tuple[int, int, bytes]], length: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8).astype(np.uint64)
    n = np.array([len(p[2]) for p in pieces])
    begin = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        gram = _Rolling(raw, _ONE).grams(GRAM)
        least = (gram >> _POSITION << _POSITION) | np.arange(len(gram), dtype=np.uint64)
        have, width = 1, length - GRAM + 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if rest := width - have:
            least = np.minimum(least[:-rest], least[rest:])
        anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        count = n - length + 1
        s = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
        owner = np.repeat(np.arange(len(pieces)), count)
        at = anchor[s]
        new = np.ones(len(s), bool)
        new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(s)) - 1
        a, b, p = s[head], s[tail] + length, at[head]
        shape = ((p - a) * 100_003 + (b - a)).astype(np.uint64)
        out = np.zeros(len(head), OCCURRENCE)
        out["gram"], out["block"] = gram[p], mix(_Rolling(raw, _TWO).of(a, b) + shape * _ONE)
        who = owner[head]
        out["doc"] = np.array([q[0] for q in pieces])[who]
        out["start"] = np.array([q[1] for q in pieces])[who] + a - begin[who]
        out["lead"], out["size"] = p - a, b - a
    return out


def first_of_each(occ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``occ`` by (gram, block, doc, start), and which of them is the first of its block."""
    occ = occ[np.lexsort((occ["start"], occ["doc"], occ["block"], occ["gram"]))]
    first = np.ones(len(occ), bool)
    first[1:] = (occ["gram"][1:] != occ["gram"][:-1]) | (occ["block"][1:] != occ["block"][:-1])
    return occ, first


def _packed(doc: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(documents, their rows as one binary each)."""
    order = np.argsort(doc, kind="stable")
    doc, rows = doc[order], rows[order]
    ids, begin = np.unique(doc, return_index=True)
    offsets = np.append(begin, len(doc)).astype(np.int32) * rows.dtype.itemsize
    return ids, pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _intervals(occ: np.ndarray) -> np.ndarray:
    out = np.zeros(len(occ), INTERVAL)
    out["a"], out["b"] = occ["start"], occ["start"] + occ["size"]
    return out


_MESSAGE = ["kind", "key", "blob"]


def _message(kind: int, key: np.ndarray, blob: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), blob], names=_MESSAGE)


INTERVALS, REQUESTS, BLOCKS = 1, 2, 0


def _find_blocks(length: int, buckets: int):
    @tidy("suffix")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            occ, first = first_of_each(blocks(batch.column(0).to_numpy(), texts, length))
            if not len(occ):
                continue
            if not first.all():  # repeats inside this batch need not travel
                again = occ[~first]
                yield _message(INTERVALS, *_packed(again["doc"], _intervals(again)))
                occ = occ[first]
            key, blob = _packed((occ["gram"] % np.uint64(buckets)).astype(np.int64), occ)
            yield _message(BLOCKS, key, blob)

    return run


def _by_key(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of equal key, which come together, as one list of blobs."""
    now, rows = None, []
    for batch in batches:
        for key, *row in zip(*(batch[c].to_pylist() for c in ("key", *columns)), strict=True):
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(tuple(row))
    if rows:
        yield now, rows


def _match_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _by_key(batches, ("kind", "blob")):
        occ, first = first_of_each(np.frombuffer(b"".join(x for k, x in rows if k == BLOCKS), OCCURRENCE))
        if not len(occ):
            continue
        if not first.all():
            again = occ[~first]
            yield _message(INTERVALS, *_packed(again["doc"], _intervals(again)))
        heads = occ[first]
        same = heads["gram"][1:] == heads["gram"][:-1]
        several = np.zeros(len(heads), bool)
        several[1:] |= same
        several[:-1] |= same
        if several.any():
            ask = heads[several]
            rows_ = np.zeros(len(ask), REQUEST)
            for c in REQUEST.names:
                rows_[c] = ask[c]
            yield _message(REQUESTS, *_packed(ask["doc"], rows_))


@tidy("suffix")
def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in (part for whole in batches for part in slices(whole, "text")):
        z = [pack((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], names=["id", "z"])


def contexts(docs: list[int], texts: list[bytes], asked: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(CONTEXT rows, their bytes one after the other): each requested block is split at
    the string whose anchor has ``side`` bytes before it; a half is keyed by the
    bytes that all of its strings hold around the anchor."""
    side = (length - GRAM) // 2
    raw8 = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum([0] + [len(t) for t in texts[:-1]])
    count = [len(r) for r in asked]
    req = np.concatenate(asked)
    doc = np.repeat(np.array(docs, np.int64), count)
    off = np.repeat(base, count)
    a = off + req["start"]
    p = a + req["lead"]
    last = a + req["size"] - length  # the last string of the block
    with np.errstate(over="ignore"):
        roll = _Rolling(raw8.astype(np.uint64), _TWO)
        left, right = a <= p - side, last > p - side
        parts = []
        for ok, begin, stop, lo, hi, salt in (
            (left, a, np.minimum(last, p - side), p - side, p + GRAM, 0),
            (right, np.maximum(a, p - side + 1), last, p, p + length - side, 1),
        ):
            i = np.flatnonzero(ok)
            c = np.zeros(len(i), CONTEXT)
            c["key"] = mix(roll.of(lo[i], hi[i]) + np.uint64(salt))
            c["doc"], c["start"] = doc[i], begin[i] - off[i]
            c["lead"], c["n"] = p[i] - begin[i], stop[i] - begin[i] + 1
            parts.append((c, begin[i]))
    c = np.concatenate([x for x, _ in parts])
    begin = np.concatenate([x for _, x in parts])
    size = c["n"].astype(np.int64) + length - 1
    at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
    return c, raw8[at]


def _fetch(length: int, buckets: int):
    def flush(docs: list, texts: list, asked: list) -> pa.RecordBatch:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        c, raw = contexts(docs, texts, asked, length)
        size = c["n"].astype(np.int64) + length - 1
        begin = np.cumsum(size) - size
        bucket = (c["key"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, first = np.unique(bucket[order], return_index=True)
        rows, data = [], []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            i = order[lo:hi]
            at = np.arange(size[i].sum()) + np.repeat(begin[i] - (np.cumsum(size[i]) - size[i]), size[i])
            rows.append(c[i].tobytes())
            data.append(pack(raw[at].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rows, pa.binary()), pa.array(data, pa.binary())], names=["key", "rows", "data"])

    @tidy("suffix")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        docs, texts, asked, size = [], [], [], 0
        for batch in batches:
            for doc, z, blobs in zip(batch["id"].to_pylist(), batch["z"].to_pylist(), batch["blobs"].to_pylist(), strict=True):
                docs.append(doc)
                texts.append(unpack(z))
                asked.append(np.frombuffer(b"".join(blobs), REQUEST))
                size += len(texts[-1])
                if size > 8 << 20:
                    yield flush(docs, texts, asked)
                    docs, texts, asked, size = [], [], [], 0
        if docs:
            yield flush(docs, texts, asked)

    return run


class BlindTrie:
    """Patricia trie over strings of one length; equal strings share a leaf.

    A node is [place of the byte that branches, children by that byte]; a leaf is
    (string as a number, members).  Insertion first walks blindly to some leaf,
    compares once, and then branches where the two differ.
    """

    def __init__(self, size: int):
        self.size = size
        self.root: list | tuple | None = None

    def insert(self, s: bytes, member: int) -> None:
        if self.root is None:
            self.root = (int.from_bytes(s, "big"), [member])
            return
        node = self.root
        while type(node) is list:
            kids = node[1]
            node = kids.get(s[node[0]]) or next(iter(kids.values()))
        value = int.from_bytes(s, "big")
        if value == node[0]:
            node[1].append(member)
            return
        place = self.size - 1 - ((value ^ node[0]).bit_length() - 1) // 8
        other = (node[0] >> 8 * (self.size - 1 - place)) & 255
        up, node = None, self.root
        while type(node) is list and node[0] < place:
            up, node = node, node[1][s[node[0]]]
        leaf = (value, [member])
        if type(node) is list and node[0] == place:
            node[1][s[place]] = leaf
            return
        branch = [place, {other: node, s[place]: leaf}]
        if up is None:
            self.root = branch
        else:
            up[1][s[up[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        """Members of each leaf, in the order of the strings."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                yield node[1]


def multikey_quicksort(word: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes ``at`` inside each group by their first ``depth`` bytes.

    ``word[i]`` is the eight bytes at ``i`` as a number: the characters of the sort.
    All groups are partitioned at once, each by a pivot of its own (the median of
    three), into less, equal and greater; only the equal part goes on to the next
    eight bytes.  Returns (suffixes in order, class of each); groups of one are left out.
    """
    index = np.argsort(group, kind="stable")
    head = np.flatnonzero(np.append(True, np.diff(group[index]) != 0)) if len(index) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(index)))
    place, level = head.copy(), np.zeros(len(head), np.int64)  # where a group's sorted suffixes start; bytes known equal
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(head):
        flat = np.repeat(head - (np.cumsum(size) - size), size) + np.arange(size.sum())
        index = index[flat]
        head = np.cumsum(size) - size
        deep = level >= depth
        for some, keep in ((deep & (size > 1), True), (~deep & (size > 1), False)):
            rows = np.repeat(some, size)
            if keep:
                if rows.any():
                    done.append((index[rows], place[some], size[some]))
            else:
                index, place, level, size = index[rows], place[some], level[some], size[some]
        if not len(size):
            break
        head = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        key = word[at[index] + level[owner]]
        a, b, c = key[head], key[head + size // 2], key[head + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[owner]
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        parts = np.bincount(owner * 3 + side, minlength=3 * len(size))
        begin = np.cumsum(parts) - parts
        to = np.empty(len(index), np.int64)
        for k in range(3):
            own = np.flatnonzero(side == k)
            n = parts[k::3]
            to[own] = np.repeat(begin[k::3] - (np.cumsum(n) - n), n) + np.arange(len(own))
        moved = np.empty_like(index)
        moved[to] = index
        some = parts > 0
        start = np.repeat(place - head, 3) + begin
        index, head, size, place, level = moved, begin[some], parts[some], start[some], (np.repeat(level, 3) + 8 * (np.arange(len(parts)) % 3 == 1))[some]
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, size = np.concatenate([d[1] for d in done]), np.concatenate([d[2] for d in done])
    index, begin = np.concatenate([d[0] for d in done]), np.cumsum(size) - size
    order = np.argsort(place, kind="stable")
    n = size[order]
    return index[np.repeat(begin[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())], np.repeat(np.arange(len(n)), n)


def deep_shallow(raw: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes ``at`` of ``raw`` inside each group to depth ``length``.

    Returns (suffixes in order, class of each): suffixes of one class are equal
    to that depth.  Suffixes that equal no other are left out.
    """
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    word = np.zeros(len(raw), np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : j + len(raw)]
    index, cls = multikey_quicksort(word, at, group, min(SHALLOW, length // 8 * 8))
    if not len(index):
        return index, cls
    start = min(SHALLOW, length // 8 * 8)
    heads = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
    sizes = np.diff(np.append(heads, len(cls)))
    out_i, out_c = [], []
    two = heads[sizes == 2]  # a trie of two strings is one comparison
    if len(two):
        x, y = at[index[two]], at[index[two + 1]]
        same = np.ones(len(two), bool)
        for depth in [*range(start, length - 7, 8), length - 8]:
            same &= word[x + depth] == word[y + depth]
        keep = two[same]
        out_i.append(np.stack([index[keep], index[keep + 1]], 1).ravel())
        out_c.append(np.repeat(np.arange(len(keep)), 2))
    n_class = len(out_c[0]) // 2 if out_c else 0
    data = raw.tobytes()
    deep_i: list[int] = []
    deep_c: list[int] = []
    many = sizes > 2
    where = at[index]
    for h, n in zip(heads[many].tolist(), sizes[many].tolist(), strict=True):
        trie = BlindTrie(length - start)
        for k, p in enumerate(where[h : h + n].tolist(), h):
            trie.insert(data[p + start : p + length], k)
        for members in trie.leaves():
            if len(members) > 1:
                deep_i += members
                deep_c += [n_class] * len(members)
                n_class += 1
    out_i.append(index[np.array(deep_i, np.int64)])
    out_c.append(np.array(deep_c, np.int64))
    return np.concatenate(out_i), np.concatenate(out_c)


def repeated_strings(ctx: np.ndarray, raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, INTERVAL rows) of the strings of ``ctx`` that occur earlier in it."""
    size = ctx["n"].astype(np.int64) + length - 1
    base = np.cumsum(size) - size
    _, inverse, count = np.unique(ctx["key"], return_inverse=True, return_counts=True)
    use = np.flatnonzero(count[inverse] > 1)
    if not len(use):
        return np.zeros(0, np.int64), np.zeros(0, INTERVAL)
    n = ctx["n"][use].astype(np.int64)
    owner = np.repeat(use, n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ahead = ctx["lead"][owner].astype(np.int64) - nth
    index, cls = deep_shallow(raw, base[owner] + nth, inverse[owner].astype(np.int64) * 65_536 + ahead, length)
    doc, pos = ctx["doc"][owner[index]], ctx["start"][owner[index]].astype(np.int64) + nth[index]
    order = np.lexsort((pos, doc, cls))
    again = np.zeros(len(order), bool)
    again[1:] = cls[order][1:] == cls[order][:-1]
    doc, pos = doc[order][again], pos[order][again]
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + length)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc)) - 1
    out = np.zeros(len(head), INTERVAL)
    if len(head):
        out["a"], out["b"] = pos[head], pos[tail] + length
    return doc[head], out


def _sort(length: int):
    @tidy("suffix")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for _, rows in _by_key(batches, ("rows", "data")):
            ctx = np.frombuffer(b"".join(r for r, _ in rows), CONTEXT)
            raw = np.frombuffer(b"".join(unpack(d) for _, d in rows), np.uint8)
            doc, found = repeated_strings(ctx, raw, length)
            if len(doc):
                yield _message(INTERVALS, *_packed(doc, found))

    return run


def merge(found: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of INTERVAL rows; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in np.sort(found, order=["a", "b"]).tolist():
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, last = [], 0
    for a, b in spans:
        parts.append(text[last:a])
        last = b
    return b"".join([*parts, text[last:]])


@tidy("suffix")
def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in (part for whole in batches for part in slices(whole, "z", 2 << 20)):
        rows = []
        for z, blobs in zip(batch["z"].to_pylist(), batch["blobs"].to_pylist(), strict=True):
            text = unpack(z)
            spans = merge(np.frombuffer(b"".join(blobs), INTERVAL)) if blobs else []
            rows.append((len(text), [{"start": a, "stop": b} for a, b in spans], cut(text, spans)))
        n, spans, kept = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch["id"], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (removed runs of bytes), kept (bytes).

    Ids are longs.  Null text is empty; texts shorter than ``length`` stay whole.
    Of rows with equal ids, those of equal text are one document and keep the same
    bytes; others come in the order of their texts' hashes.  A null id comes before
    all others.  An empty table gives an empty result.
    """
    if not 2 * GRAM <= length <= 32_000:
        raise ValueError(f"length must be {2 * GRAM} to 32000")
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    each = plain.select("doc_id", F.octet_length("text").alias("b")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"))
    odd, n_bytes = each.agg(F.coalesce(F.bool_or((F.col("n") > 1) | F.col("doc_id").isNull()), F.lit(False)), F.coalesce(F.sum("b"), F.lit(0))).first()
    if odd:  # ids do not tell rows apart: number (id, text) pairs instead
        keyed = plain.withColumn("h", F.xxhash64("text")).withColumn("m", F.md5(F.col("text").cast("binary")))
        ranks = global_rank(keyed.select("doc_id", "h", "m").distinct(), ["doc_id", "h", "m"], "id")
        source = keyed.dropDuplicates(["doc_id", "h", "m"]).alias("k").join(ranks.alias("r"), F.expr("k.doc_id <=> r.doc_id and k.h = r.h and k.m = r.m")).select("id", "k.text", "k.doc_id", "k.h", "k.m")
        source = materialize(source, "numbered")
    else:
        source = plain.select(F.col("doc_id").alias("id"), "text")
    parts = max(shuffle_partitions(spark), -(-int(n_bytes) // PART_BYTES))
    buckets = 2 * parts
    message = "kind int, key long, blob binary"
    found = source.select("id", "text").mapInArrow(_find_blocks(length, buckets), message)
    local = found.withColumn("deal", F.when(F.col("kind") == BLOCKS, F.col("key")).otherwise(F.pmod("key", F.lit(buckets))))
    dealt = local.repartition(parts, "deal").sortWithinPartitions("kind", "key").select("kind", "key", "blob")
    matched = materialize(dealt.mapInArrow(_pass_through(_match_blocks), message), "blocks")
    zipped = source.select("id", "text").mapInArrow(_compress, "id long, z binary")
    asked = matched.filter(F.col("kind") == REQUESTS).groupBy(F.col("key").alias("id")).agg(F.collect_list("blob").alias("blobs"))
    halves = zipped.join(asked, "id").select("id", "z", "blobs").mapInArrow(_fetch(length, buckets), "key long, rows binary, data binary")
    ordered = halves.repartition(parts, "key").sortWithinPartitions("key")
    sorted_ = materialize(ordered.mapInArrow(_sort(length), message), "suffixes")
    spans = matched.filter(F.col("kind") == INTERVALS).unionByName(sorted_).groupBy(F.col("key").alias("id")).agg(F.collect_list("blob").alias("blobs"))
    done = zipped.join(spans, "id", "left").select("id", "z", "blobs").mapInArrow(_finish, "id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    if not odd:
        return done.withColumnRenamed("id", "doc_id")
    each = source.drop("text").join(done, "id").drop("id")
    return keyed.select("doc_id", "h", "m").alias("k").join(each.alias("e"), F.expr("k.doc_id <=> e.doc_id and k.h = e.h and k.m = e.m")).select("k.doc_id", "n_bytes", "spans", "kept")


def _pass_through(match):
    """Intervals that a mapper found pass; blocks go to ``match``."""

    @tidy("suffix")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def blocks_only() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = batch["kind"].to_numpy()
                n = int((kinds == BLOCKS).sum())  # blocks are sorted first
                if n:
                    yield batch.slice(0, n)
                if n < len(kinds):
                    passed.append(batch.slice(n))
                    break

        yield from match(blocks_only())
        yield from passed
        yield from batches

    return run


def n_removed(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
