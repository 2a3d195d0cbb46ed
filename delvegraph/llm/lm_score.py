"""Language-model scores: an exact add-one unigram base and a causal self-attention model.

Base.  Training word counts are gathered from the whole corpus.  The most
frequent words (a bounded table) go to every task; what a document holds of all
other words is joined with the full count table, so every count is exact.

Model.  A text is cut before every blank and line feed; each piece goes, with a
blank before it where it has no line feed, through a public byte-level vocabulary.
So a piece always has the same subword ids, and the counts of ids follow exactly
from the counts of pieces.  Overlapping windows are read in batches: the first ids
of a window are context only, so every id is scored once.  A place attends, masked,
to all places before it in the window; what it gathers is added to vectors of the
place's own id and of the hashed pairs and triples that end there.  The next id is
predicted as a class and a member of the class (frequent ids), or as a rare id with
its share of the training counts, so the probabilities of all ids sum to one.

Fitting.  Every id of every training text, its end included, is predicted and learned
from.  The counts of ids and of neighbours that make the classes are of all training
texts too.  One task fits a start on about ``SEED_WINDOWS`` windows, drawn from all
training texts by bytes; then tasks that grow in number with the corpus go on from there
with all windows of all training texts, each once, and every row of weights is averaged
over the tasks that touched it.  A corpus of no more windows is fitted whole in one task.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delvegraph.llm.storage import drop, materialize
from delvegraph.llm.textkit import _SPACE, mix, slices
from delvegraph.llm.worker import hold, one_thread, tidy

#: Words whose counts every task holds, and pieces that a worker remembers.
HEAD_WORDS, MEMORY = 200_000, 200_000
#: Windows that the start is fitted on; windows of one later task, and most such tasks (each takes more beyond).
SEED_WINDOWS, TASK_WINDOWS, FIT_TASKS = 56_000, 262_144, 4096
#: Windows of a row that is dealt to a task, windows that a task shuffles at once, and windows of one of its steps.
BLOCK, POOL, STEP = 128, 16_384, 256
#: Ids with vectors of their own, vectors that all others share, and vectors of hashed pairs and triples.
HEAD, SHARED, PAIR_BITS, TRIPLE_BITS = 4096, 1024, 15, 16
CLASSES, MEMBERS, WIDTH, KEY = 32, 32, 24, 8
CONTEXT, SCORED = 16, 32
SPAN = CONTEXT + SCORED
RARE = CLASSES * MEMBERS - 1
#: Members of most uses, by which the company that ids keep is told.
NEAR = 512
PAD, BEGIN = HEAD + SHARED, HEAD + SHARED + 1
#: No word holds white space, so this stands for the end of a text.
END = b"\n"


def words(text: str | None) -> list[bytes]:
    """Runs without \\x20 and \\x09-\\x0D with A-Z in lower case; null is empty."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


# ---------------------------------------------------------------- subword ids


def pieces(raw: bytes) -> list[bytes]:
    """``raw`` (not empty) cut at every blank, which goes, and before every line feed."""
    return raw.replace(b"\n", b" \n").split(b" ")


def one_word(some: list[bytes]) -> np.ndarray:
    """Which of them are words: not empty, and without white space."""
    length = np.fromiter(map(len, some), np.int64, len(some))
    white = np.concatenate([[0], np.cumsum(_SPACE[np.frombuffer(b"".join(some), np.uint8)])])
    stop = np.cumsum(length)
    return (length > 0) & (white[stop] == white[stop - length])


class Subwords:
    """Ids of pieces by a public byte-level vocabulary; nothing is added."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.length = np.zeros(self.size, np.int64)
        for token, k in ranks.items():
            self.length[k] = len(token)
        self.encoding = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def one(self, shown: bytes) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(shown.decode("utf-8", "replace")), np.int64)

    def many(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, ids of each piece)."""
        shown = [p if p[:1] == b"\n" else b" " + p for p in some]
        length = np.array([len(s) for s in shown], np.int64)
        white = _SPACE[np.frombuffer(b"".join(shown), np.uint8)]
        plain = (length > 1) & (np.add.reduceat(white, np.cumsum(length) - length, dtype=np.int64) == 1 if len(shown) else False)
        # plain pieces go together, as no word crosses from one to the next; those with other white space go alone
        joined = [s for s, x in zip(shown, plain.tolist(), strict=True) if x]
        ids = self.encoding.encode_to_numpy(b"".join(joined).decode("utf-8", "replace")).astype(np.int64)
        ends, stop = np.cumsum(self.length[ids]), np.cumsum(length[plain])
        cut = np.searchsorted(ends, stop)
        if len(joined) and (cut[-1] != len(ids) - 1 or not (ends[cut] == stop).all()):
            plain[:], ids, cut = False, ids[:0], cut[:0]
        alone = [self.one(s) for s, x in zip(shown, plain.tolist(), strict=True) if not x]
        size = np.empty(len(shown), np.int64)
        size[plain], size[~plain] = np.diff(cut, prepend=-1), [len(x) for x in alone]
        if not alone:
            return ids, size
        begin = np.empty(len(shown), np.int64)
        begin[plain] = np.cumsum(size[plain]) - size[plain]
        begin[~plain] = len(ids) + np.cumsum(size[~plain]) - size[~plain]
        at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
        return np.concatenate([ids, *alone])[at], size

    def ids(self, text: str | None) -> np.ndarray:
        raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
        return self.many(pieces(raw))[0] if raw else np.zeros(0, np.int64)


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def subwords(path: str) -> Subwords:
    return hold("lm", ("subwords", path), lambda: Subwords(path))


# ---------------------------------------------------------------- network

Weights = dict[str, np.ndarray]


@dataclass
class Network:
    slot: np.ndarray  # input row of each id (the end last)
    out: np.ndarray  # class * MEMBERS + member of each id
    share: np.ndarray  # natural log of each id's share of its member
    p: Weights
    steps: Weights  # squares of the gradients so far, by row

    @property
    def end(self) -> int:
        return len(self.slot) - 1


_CAUSAL = np.tril(np.ones((SPAN, SPAN), np.float32))[CONTEXT:]
_BACK = np.clip(np.arange(SPAN)[CONTEXT:, None] - np.arange(SPAN)[None], 0, SPAN - 1)
#: The bits of a float grow almost as its logarithm does, so x * SCALE + SHIFT, read as a float, is within 3 % of exp(x).
#: It is positive and each sum of it is divided by, so distributions stay whole.
SCALE, SHIFT = np.float32(12102203.0), np.float32(1064986823.0)


def _bits(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32).view(np.float32)


def grams(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs and the triples that end at the scored places."""
    a, b, c = (x[:, CONTEXT - k : SPAN - k].astype(np.uint32) for k in range(3))
    two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    three = two + c * np.uint32(0xC2B2AE3D)
    two = (two ^ two >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - PAIR_BITS)
    three = (three ^ three >> np.uint32(15)) * np.uint32(0x297A2D39) >> np.uint32(32 - TRIPLE_BITS)
    return two.astype(np.int32), three.astype(np.int32)


def first_weights(rng: np.random.Generator, bias: np.ndarray, member_bias: np.ndarray) -> Weights:
    draw = lambda z, *s: (rng.standard_normal(s) * z).astype(np.float32)
    slots = BEGIN + 1
    return {
        "query": draw(0.3, slots, KEY), "key": draw(0.3, slots, KEY), "value": draw(0.1, slots, WIDTH), "one": draw(0.3, slots, WIDTH),
        "two": np.zeros((1 << PAIR_BITS, WIDTH), np.float32), "three": np.zeros((1 << TRIPLE_BITS, WIDTH), np.float32), "back": np.zeros((SPAN, 1), np.float32),
        "out": draw(0.1, CLASSES, WIDTH), "bias": bias.reshape(-1, 1).astype(np.float32), "member": draw(0.1, CLASSES * MEMBERS, WIDTH), "member_bias": member_bias.reshape(-1, 1).astype(np.float32),
    }


def first_steps(p: Weights) -> Weights:
    return {k: np.full(len(w), 1e-2 if k in ("two", "three") else 1e-3, np.float32) for k, w in p.items()}


def hidden(p: Weights, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """State after each of the last SCORED slots of every window (rows of ``x``) with a 1 at its end, and what a gradient needs."""
    pair, triple = grams(x)
    x = x.astype(np.intp)
    own = np.ascontiguousarray(x[:, CONTEXT:])
    q, k = p["query"].take(own, axis=0), p["key"].take(x, axis=0)
    v = _with_one(p["value"]).take(x, axis=0)  # the ones sum the weights of the places
    a = np.matmul(q, k.transpose(0, 2, 1))
    a += p["back"][:, 0][_BACK]
    np.exp(np.clip(a, -25, 25, out=a), out=a)
    a *= _CAUSAL
    gathered = np.matmul(a, v)
    whole = 1 / gathered[:, :, WIDTH:]
    gathered = gathered[:, :, :WIDTH] * whole
    z = p["one"].take(own, axis=0)
    z += gathered
    z += p["two"].take(pair, axis=0)
    z += p["three"].take(triple, axis=0)
    r = z * z
    r += 1
    np.divide(1, np.sqrt(r, out=r), out=r)
    h = np.ones((*z.shape[:2], WIDTH + 1), z.dtype)
    np.multiply(z, r, out=h[:, :, :WIDTH])
    return h, (pair, triple, own, x, q, k, v, a, whole, gathered, r)


def _with_one(t: np.ndarray) -> np.ndarray:
    return np.concatenate([t, np.ones((len(t), 1), t.dtype)], axis=1)


def _put(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """table[rows] = values for different rows, each moved as one item."""
    kind = np.dtype((np.void, table.shape[1] * table.itemsize))
    np.put(table.view(kind), rows, np.ascontiguousarray(values).view(kind))


def heads(out: np.ndarray, bias: np.ndarray, member: np.ndarray, member_bias: np.ndarray) -> np.ndarray:
    """For each class: rows of all classes and then of its members, with their bias last."""
    both = np.empty((CLASSES, CLASSES + MEMBERS, WIDTH + 1), out.dtype)
    both[:, :CLASSES, :WIDTH], both[:, :CLASSES, WIDTH:] = out, bias
    both[:, CLASSES:, :WIDTH], both[:, CLASSES:, WIDTH] = member.reshape(CLASSES, MEMBERS, WIDTH), member_bias.reshape(CLASSES, MEMBERS)
    return both


def spans(cuts: np.ndarray) -> list[tuple[int, slice]]:
    """The classes that have places, and where these lie."""
    ends = cuts.tolist()
    return [(g, slice(i, j)) for g, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if i < j]


def logits(both: np.ndarray, state: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A column for each state (rows by class): of all classes, then of the members of its class."""
    e = np.empty((CLASSES + MEMBERS, len(state)), state.dtype)
    for g, own in spans(cuts):
        np.matmul(both[g], state[own].T, out=e[:, own])
    return e


def gradients(p: Weights, x: np.ndarray, y: np.ndarray, cost: bool = True) -> tuple[float, int, list[tuple[str, np.ndarray | None, np.ndarray]]]:
    """(loss in nats if ``cost``, places, gradients as (table, rows or all, values)) for the output slots ``y``; -1: none."""
    h, (pair, triple, last, x, q, k, v, a, whole, gathered, r) = hidden(p, x)
    y = y.ravel().astype(np.int16)
    order = np.argsort(y, kind="stable")
    cuts = np.searchsorted(y.take(order), np.arange(CLASSES + 1) * MEMBERS)
    order, cuts = order[cuts[0] :], cuts - cuts[0]  # by class; places with nothing to predict came first
    state, y = h.reshape(-1, WIDTH + 1).take(order, axis=0), y.take(order).astype(np.intp)
    n = len(order)
    both = heads(p["out"], p["bias"], p["member"], p["member_bias"])
    e = logits(both, state, cuts)
    np.exp(np.clip(e, -60, 60, out=e), out=e)  # as ``Scorer`` keeps logits
    nats = _less_one(e[:CLASSES], y // MEMBERS, cost) + _less_one(e[CLASSES:], y % MEMBERS, cost)
    d_state, d_heads = np.empty((n, WIDTH), h.dtype), np.zeros_like(both)
    for g, own in spans(cuts):
        np.matmul(e[:, own].T, both[g, :, :WIDTH], out=d_state[own])
        np.matmul(e[:, own], state[own], out=d_heads[g])
    d_out, d_member = d_heads[:, :CLASSES].sum(axis=0), d_heads[:, CLASSES:].reshape(-1, WIDTH + 1)
    dz = np.zeros((r.size // WIDTH, WIDTH), d_state.dtype)
    _put(dz, order, d_state)
    dz = dz.reshape(r.shape)
    dz *= r
    r *= r
    dz *= r
    d = np.empty((*r.shape[:2], WIDTH + 1), dz.dtype)
    np.multiply(dz, whole, out=d[:, :, :WIDTH])
    np.negative(np.einsum("bij,bij->bi", d[:, :, :WIDTH], gathered), out=d[:, :, WIDTH])
    ds = np.matmul(d, v.transpose(0, 2, 1))
    ds *= a
    d_back = np.bincount(_BACK.ravel(), ds.sum(axis=0).ravel(), SPAN).astype(ds.dtype)[:, None]
    flat = lambda t: t.reshape(-1, t.shape[-1])
    dz_flat = flat(dz)
    return nats, n, [
        ("query", last, flat(np.matmul(ds, k))), ("key", x, flat(np.matmul(ds.transpose(0, 2, 1), q))), ("value", x, flat(np.matmul(a.transpose(0, 2, 1), d[:, :, :WIDTH]))),
        ("one", last, dz_flat), ("two", pair, dz_flat), ("three", triple, dz_flat), ("back", None, d_back),
        ("out", None, d_out[:, :WIDTH]), ("bias", None, d_out[:, WIDTH:]), ("member", None, d_member[:, :WIDTH]), ("member_bias", None, d_member[:, WIDTH:]),
    ]


def _less_one(e: np.ndarray, at: np.ndarray, cost: bool) -> float:
    """Make columns of sums 1, take 1 from row ``at`` of each, and return the nats that these cost."""
    e *= 1 / e.sum(axis=0)
    flat = e.reshape(-1)
    at = at * e.shape[1] + np.arange(e.shape[1])
    nats = -float(np.log(np.maximum(flat.take(at), 1e-30)).sum()) if cost else 0.0
    flat[at] -= 1
    return nats


def descend(p: Weights, steps: Weights, grads: list, n: float, rate: float, touched: Weights | None = None) -> None:
    """One step, each row by its own rate; ``touched`` counts the steps of every row."""
    seen: dict[int, tuple] = {}  # tables that share their rows share the order
    scale = np.float32(100 / n)
    for name, rows, g in grads:
        if rows is None:
            u, s, size = slice(None), g, steps[name]
        else:
            if id(rows) not in seen:
                flat = rows.ravel()
                flat = flat.astype(np.uint16) if len(p[name]) <= 1 << 16 else flat
                order = np.argsort(flat, kind="stable")
                flat = flat.take(order)
                first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
                size = np.diff(first, append=len(flat))
                more = np.flatnonzero(size > 1)  # most rows are met once and need no sum
                size = size.take(more)
                begin = np.cumsum(size) - size
                at = order.take(np.arange(int(size.sum())) + np.repeat(first.take(more) - begin, size))
                seen[id(rows)] = order.take(first), more, at, begin, flat.take(first).astype(np.intp)
            once, more, at, begin, u = seen[id(rows)]
            s = g.take(once, axis=0)
            if len(more):
                _put(s, more, _sums(g.take(at, axis=0), begin))
            size = steps[name].take(u)
        size += np.einsum("ij,ij->i", s, s) * (scale * scale / s.shape[1])
        s *= (rate * scale / np.sqrt(size))[:, None]
        if rows is None:
            p[name] -= s
        else:
            steps[name][u] = size
            _put(p[name], u, p[name].take(u, axis=0) - s)
        if touched is not None:
            touched[name][u] += 1


def _sums(g: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that ``begin`` there; two columns are summed as one of complex numbers, which halves the work."""
    if g.dtype != np.float32 or g.shape[1] % 2:
        return np.add.reduceat(g, begin, axis=0)
    return np.add.reduceat(g.view(np.complex64), begin, axis=0).view(np.float32)


def learn(net: Network, rows: np.ndarray, first: float, last: float, touched: Weights | None = None, batch: int = 64) -> None:
    """Fit ``net`` in place on windows (rows of SPAN + 1 ids) in their order, the rate falling from ``first`` to ``last``.

    A gradient is scaled as one of 64 windows, whatever the batch, so that rows met once weigh alike.
    """
    slot = np.concatenate([net.slot, [BEGIN, PAD]]).astype(np.int32)
    out = np.concatenate([net.out, [-1, -1]])
    n = -(-len(rows) // batch)
    for k in range(n):
        part = rows[k * batch : (k + 1) * batch]
        _, places, grads = gradients(net.p, slot[part[:, :SPAN]], out[part[:, CONTEXT + 1 :]], cost=False)
        if places:
            descend(net.p, net.steps, grads, places * 64 / batch, first + (last - first) * k / n, touched)


def most_used(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(input slot, place among the members by uses or RARE) of every id by its count."""
    order = np.argsort(-counts, kind="stable")
    slot = (HEAD + np.arange(len(counts)) % SHARED).astype(np.int32)
    slot[order[:HEAD]] = np.arange(min(HEAD, len(counts)))
    place = np.full(len(counts), RARE, np.int64)
    place[order[:RARE]] = np.arange(min(RARE, len(counts)))
    if place[-1] == RARE:  # the end always has a slot of its own
        place[order[RARE - 1]], place[-1] = RARE, RARE - 1
    return slot, place


def pairs(seen: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How often each place follows each of the NEAR most used ones."""
    cell = np.minimum(before, NEAR)
    cell += seen * (NEAR + 1)
    return np.bincount(cell, minlength=(RARE + 1) * (NEAR + 1)).reshape(RARE + 1, NEAR + 1)[:, :NEAR]


def new_network(counts: np.ndarray, rows: np.ndarray | None = None, profile: np.ndarray | None = None) -> Network:
    """``counts``: of every id (the end last) in the training corpus; ``profile``: its ``pairs`` (or windows ``rows``
    to take them from), which tell which ids keep alike company, as such ids go into one class."""
    rng = np.random.default_rng(5)
    size = CLASSES * MEMBERS
    slot, place = most_used(counts)
    if profile is None:
        seen = np.concatenate([place, [RARE, RARE]])[rows]
        profile = pairs(seen[:, 1:].ravel(), seen[:, :-1].ravel())
    z = np.sqrt(profile.astype(np.float32))
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def halves(idx: np.ndarray, depth: int) -> list[np.ndarray]:
        if not depth:
            return [idx]
        x = z[idx] - z[idx].mean(axis=0)
        v = rng.standard_normal(x.shape[1]).astype(np.float32)
        for _ in range(12):
            v = x.T @ (x @ v)
            v /= np.linalg.norm(v) + 1e-9
        sorted_ = idx[np.argsort(x @ v, kind="stable")]
        return halves(sorted_[: len(idx) // 2], depth - 1) + halves(sorted_[len(idx) // 2 :], depth - 1)

    member = np.empty(size, np.int64)
    member[np.concatenate(halves(np.arange(size), CLASSES.bit_length() - 1))] = np.arange(size)
    out = member[place]
    mass = np.bincount(out, counts + 0.5, size)
    share = np.log((counts + 0.5) / mass[out]).astype(np.float32)
    mass = np.maximum(mass, 1e-3)
    of_class = mass.reshape(CLASSES, MEMBERS).sum(axis=1)
    p = first_weights(rng, np.log(of_class / of_class.sum()), np.log(mass / np.repeat(of_class, MEMBERS)))
    return Network(slot, out, share, p, first_steps(p))


def windows(ids: list[np.ndarray], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all windows, windows of each text).  A text of n ids has n + 1
    places to score: after its beginning and after each id."""
    n = np.array([len(i) + 1 for i in ids])
    count = -(-n // SCORED)
    size = CONTEXT + count * SCORED
    begin = np.cumsum(size) - size
    stream = np.full(int(size.sum()), PAD, np.int32)
    stream[begin + CONTEXT] = BEGIN
    place = np.arange(int((n - 1).sum())) + np.repeat(begin + CONTEXT + 1 - (np.cumsum(n - 1) - (n - 1)), n - 1)
    stream[place] = slot[np.concatenate(ids)] if len(place) else 0
    first = np.repeat(begin - SCORED * (np.cumsum(count) - count), count) + SCORED * np.arange(int(count.sum()))
    return stream[first[:, None] + np.arange(SPAN)], count


def targets(ids: list[np.ndarray], count: np.ndarray, end: int) -> np.ndarray:
    """The id to predict at every scored place; -1 where there is none."""
    out = np.full(int(count.sum()) * SCORED, -1, np.int64)
    at = (np.cumsum(count) - count) * SCORED
    n = np.array([len(i) for i in ids])
    place = np.arange(int(n.sum())) + np.repeat(at - (np.cumsum(n) - n), n)
    out[place] = np.concatenate(ids)
    out[at + n] = end
    return out.reshape(-1, SCORED)


class Scorer:
    """A network laid out for scoring: tables side by side, scaled for ``_bits``."""

    def __init__(self, net: Network):
        p, self.net = net.p, net
        # logits stay where ``_bits`` holds: within 85 of 0
        bound = lambda t, most: t * np.minimum(1, most / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.query_one = np.concatenate([bound(p["query"], 4.5) * SCALE, p["one"]], axis=1)
        self.key, self.two, self.three = bound(p["key"], 4.5), p["two"], p["three"]
        self.value = np.concatenate([p["value"], np.ones((len(p["value"]), 1), np.float32)], axis=1)
        self.back = np.clip(p["back"][:, 0], -20, 20)[_BACK] * SCALE + SHIFT
        most, bias = 60 / math.sqrt(WIDTH), lambda t: np.clip(t, -20, 20) * SCALE + SHIFT
        self.out, self.bias = np.ascontiguousarray(bound(p["out"], most).T) * SCALE, bias(p["bias"][:, 0])
        self.member = np.ascontiguousarray(bound(p["member"], most).reshape(CLASSES, MEMBERS, WIDTH).transpose(0, 2, 1)) * SCALE
        self.member_bias = bias(p["member_bias"].reshape(CLASSES, MEMBERS))

    def states(self, x: np.ndarray) -> np.ndarray:
        pair, triple = grams(x)
        mine = self.query_one.take(x[:, CONTEXT:], axis=0)
        s = np.matmul(mine[:, :, :KEY], self.key.take(x, axis=0).transpose(0, 2, 1))
        s += self.back
        a = _bits(s)
        a *= _CAUSAL
        gathered = np.matmul(a, self.value.take(x, axis=0))
        z = gathered[:, :, :WIDTH] / gathered[:, :, WIDTH:]
        z += mine[:, :, KEY:]
        z += self.two.take(pair, axis=0)
        z += self.three.take(triple, axis=0)
        r = z * z
        r += 1
        z /= np.sqrt(r, out=r)
        return z

    def log_p(self, x: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Natural log probability of the output slots ``out`` at the scored places."""
        h = np.empty((len(x), SCORED, WIDTH), np.float32)
        for i in range(0, len(x), 64):
            h[i : i + 64] = self.states(x[i : i + 64])
        flat = out.ravel().astype(np.int16)
        order = np.argsort(flat // MEMBERS, kind="stable")
        flat = flat.take(order)
        h, m = h.reshape(-1, WIDTH).take(order, axis=0), (flat % MEMBERS).astype(np.intp)
        return self._values(h, m, np.searchsorted(flat // MEMBERS, np.arange(CLASSES + 1)), order).reshape(out.shape)

    def _values(self, h: np.ndarray, m: np.ndarray, cuts: np.ndarray, order: np.ndarray) -> np.ndarray:
        logits = h @ self.out
        logits += self.bias
        f = _bits(logits)
        above, below = np.empty(len(h), np.float32), f @ np.ones(CLASSES, np.float32)
        ones, at = np.ones(MEMBERS, np.float32), np.arange(len(h)) * MEMBERS
        for k in range(CLASSES):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                g = h[a:b] @ self.member[k]
                g += self.member_bias[k]
                g = _bits(g)
                np.multiply(f[a:b, k] / below[a:b], g.ravel().take(at[: b - a] + m[a:b]), out=above[a:b])
                np.matmul(g, ones, out=below[a:b])
        above /= below
        value = np.empty(len(h), np.float32)
        value[order] = np.log(np.maximum(above, 1e-37))
        return value

    def text_scores(self, ids: list[np.ndarray], batch: int = 512) -> np.ndarray:
        """log10 probability of each text, its end included."""
        if not ids:
            return np.zeros(0)
        net = self.net
        x, count = windows(ids, net.slot)
        y = targets(ids, count, net.end)
        per = np.empty(len(x))
        for i in range(0, len(x), batch):
            t = y[i : i + batch]
            value = self.log_p(x[i : i + batch], net.out[t]) + net.share[t]
            per[i : i + batch] = np.where(t >= 0, value, 0).sum(axis=1, dtype=np.float64)
        return np.add.reduceat(per, np.cumsum(count) - count) / math.log(10)


# ---------------------------------------------------------------- corpus


def held_out(doc_id: Column, of: int = 7, rest: int = 2) -> Column:
    """crc32 of the id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == rest, F.lit(False))


@tidy("lm")
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, uses as a word, uses as a piece after a blank, and after a line feed).

    A piece that is no word (white space in it, or none) has a row of its own with no uses as a word.
    """
    counts: Counter[bytes] = Counter()
    ends = 0

    def out() -> pa.RecordBatch:
        found, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
        body = [p[1:] if p[:1] == b"\n" else p for p in found]
        line = np.fromiter(map(len, found), np.int64, len(found)) > np.fromiter(map(len, body), np.int64, len(found))
        plain = one_word(body)
        more = [(w, k) for i, k in zip(np.flatnonzero(~plain).tolist(), n[~plain].tolist(), strict=True) for w in body[i].split()]
        more += [(END, ends)] if ends else []
        none = np.zeros(len(more), np.int64)
        columns = (np.where(plain, n, 0), np.array([k for _, k in more], np.int64)), (np.where(line, 0, n), none), (np.where(line, n, 0), none)
        return pa.RecordBatch.from_arrays([pa.array(body + [w for w, _ in more], pa.binary()), *(pa.array(np.concatenate(c)) for c in columns)], names=["word", "c", "space", "line"])

    for batch in (part for whole in batches for part in slices(whole, "text")):
        for text in batch.column(0).to_pylist():
            ends += 1
            if text:
                counts.update(pieces(text.encode("utf-8", "surrogatepass").lower()))
            if len(counts) > 200_000:
                yield out()
                counts.clear()
                ends = 0
    if counts or ends:
        yield out()


def _id_counts(path: str):
    """Counts of ids from the counts of pieces."""

    @tidy("lm")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = subwords(path)
        total = np.zeros(enc.size, np.float64)
        for batch in batches:
            body = batch["word"].to_pylist()
            for lead, column in ((b"", "space"), (b"\n", "line")):
                n = batch[column].to_numpy()
                at = np.flatnonzero(n)
                for k in range(0, len(at), 20_000):
                    some = at[k : k + 20_000]
                    ids, size = enc.many([lead + body[i] for i in some.tolist()])
                    total += np.bincount(ids, np.repeat(n[some], size), enc.size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used].astype(np.int64))], names=["id", "n"])

    return run


#: Bytes of text that a drawn window is cut from.
REACH = 6 * SPAN


def drawn(enc: Subwords, texts: list[bytes], gap: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows of SPAN + 1 ids) of windows of some texts: about one for every ``gap`` bytes, at hashed places.

    enc.size: the end; + 1: the beginning; + 2: nothing.
    """
    hashes, heads, cut, last = [], [], [], []
    before = 4 * SCORED
    for raw in texts:
        mark = zlib.crc32(raw)
        n = int((len(raw) + before) / gap + mark / 2**32)
        where = mix(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(mark + 1))
        hashes += (where >> np.uint64(1)).tolist()
        for w in ((where % np.uint64(len(raw) + before)).astype(np.int64) - before).tolist():
            part = raw[max(w, 0) : max(w, 0) + REACH]
            ends = max(w, 0) + len(part) >= len(raw)
            if w > 0:  # from the next piece on
                at = min((i for i in (part.find(b" ") + 1, part.find(b"\n")) if i > 0), default=len(part))
                part, ends = part[at:], ends and at < len(part)
            found = pieces(part) if part else []
            if w > 0 and part[:1] == b"\n":
                found = found[1:]  # no blank came before the line feed
            heads.append(w <= 0)
            last.append(ends)
            cut.append(found if ends else found[:-1])
    rows = np.full((len(cut), SPAN + 1), enc.size + 2, np.int32)
    every = list(chain.from_iterable(cut))
    index = {p: i for i, p in enumerate(dict.fromkeys(every))}
    pool, width = enc.many(list(index))
    at = np.array([index[p] for p in every], np.int64)
    size, first = width[at], (np.cumsum(width) - width)[at]
    ids = pool[np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)]
    stop = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0] + [len(c) for c in cut])]
    for k, (head, end) in enumerate(zip(heads, last, strict=True)):
        at = 0
        if head:
            rows[k, CONTEXT], at = enc.size + 1, CONTEXT + 1
        own = ids[stop[k] : min(stop[k + 1], stop[k] + SPAN + 1 - at)]
        rows[k, at : at + len(own)] = own
        if end and at + len(own) <= SPAN:
            rows[k, at + len(own)] = enc.size
    return np.array(hashes, np.int64), rows


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(r[8:] for r in batch["row"].to_pylist()), "<i4").reshape(-1, SPAN + 1)


def _kind(size: int) -> np.dtype:
    """How ids are written, with the end, the beginning and nothing after them."""
    return np.dtype("<u2" if size + 3 <= 1 << 16 else "<u4")


def _ids(batch: pa.RecordBatch, kind: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(b, kind).astype(np.int64) for b in batch["ids"].to_pylist()]


def _company(place: np.ndarray):
    """Pairs of places in training texts, summed: (64 rows of the table, their counts)."""

    @tidy("lm")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((RARE + 1, NEAR), np.int64)
        for batch in (part for whole in batches for part in slices(whole, "ids", 1 << 20)):
            texts = [place[i] for i in _ids(batch, _kind(len(place) - 1))]
            seen = np.concatenate([x for t in texts for x in (t, place[-1:])])
            before = np.concatenate([[RARE], seen[:-1]])
            before[np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])] = RARE
            total += pairs(seen, before)
        for k in range(0, RARE + 1, 64):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + 64].tobytes()], pa.binary())], names=["at", "n"])

    return run


@tidy("lm")
def _add_company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, n in zip(batch["at"].to_pylist(), batch["n"].to_pylist(), strict=True):
            sums[at] = sums.get(at, 0) + np.frombuffer(n, np.int64)
    for at, n in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([n.tobytes()], pa.binary())], names=["at", "n"])


def _blocks(size: int):
    """All windows of the texts, in rows of up to BLOCK windows with a hash that orders them."""
    kind = _kind(size)

    @tidy("lm")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "ids")):
            marks, cut = [], []
            for row, raw in zip(batch["row"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                ids = np.frombuffer(raw, kind)
                count = len(ids) // SCORED + 1
                stream = np.full(CONTEXT + 1 + count * SCORED, size + 2, kind)
                stream[CONTEXT], stream[CONTEXT + 1 : CONTEXT + 1 + len(ids)], stream[CONTEXT + 1 + len(ids)] = size + 1, ids, size
                at = range(0, count, BLOCK)
                cut += [stream[k * SCORED : (k + BLOCK) * SCORED + CONTEXT + 1].tobytes() for k in at]
                marks.append(mix(mix(np.array([row], np.uint64)) + np.arange(len(at), dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(marks) >> np.uint64(1)).astype(np.int64)), pa.array(cut, pa.binary())], names=["mark", "block"])

    return run


def _unrolled(blocks: list[bytes], size: int) -> np.ndarray:
    """The windows (rows of SPAN + 1 ids) of some blocks."""
    streams = [np.frombuffer(b, _kind(size)) for b in blocks]
    n = np.array([(len(s) - CONTEXT - 1) // SCORED for s in streams])
    length = np.array([len(s) for s in streams])
    first = np.repeat(np.cumsum(length) - length - SCORED * (np.cumsum(n) - n), n) + SCORED * np.arange(int(n.sum()))
    return np.concatenate(streams).astype(np.int32)[first[:, None] + np.arange(SPAN + 1)]


def _pools(batches: Iterator[pa.RecordBatch], size: int, most: int = POOL) -> Iterator[np.ndarray]:
    """The windows of a task's blocks in their order, shuffled within pools of about ``most``."""
    rng = np.random.default_rng(9)
    held: list[bytes] = []
    room = most * SCORED * _kind(size).itemsize
    for block in (b for batch in batches for b in batch["block"].to_pylist()):
        held.append(block)
        room -= len(block)
        if room <= 0:
            yield rng.permutation(_unrolled(held, size))
            held, room = [], most * SCORED * _kind(size).itemsize
    if held:
        yield rng.permutation(_unrolled(held, size))


def _fit_start(shared, passes: int):
    """Weights and steps after ``passes`` over the rows: drawn windows, or (blocks) all windows of a small corpus."""

    @tidy("lm")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        net, parts = shared.value, []
        for batch in batches:
            if batch.num_rows:
                parts.append(_rows(batch) if "row" in batch.schema.names else _unrolled(batch["block"].to_pylist(), net.end))
        if parts:
            rows, rng = np.concatenate(parts), np.random.default_rng(9)
            learn(net, rows[np.concatenate([rng.permutation(len(rows)) for _ in range(passes)])], 0.1, 0.005)
        for k, v in [*((f"p:{k}", v) for k, v in net.p.items()), *((f"s:{k}", v) for k, v in net.steps.items())]:
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([v.tobytes()], pa.binary())], names=["name", "data"])

    return run


CHUNK = 512


def _fit_more(shared, key: int):
    """Weighted changes of the rows of the tables, by chunks: (name, chunk, change x touches, touches)."""

    @tidy("lm")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        base = hold("lm", ("fit", key), lambda: shared.value)
        net = Network(base.slot, base.out, base.share, {k: v.copy() for k, v in base.p.items()}, {k: v.copy() for k, v in base.steps.items()})
        touched = {k: np.zeros(len(v), np.float32) for k, v in net.p.items()}
        for rows in _pools(batches, net.end):
            learn(net, rows, 0.03, 0.03, touched, STEP)
        for name, w in net.p.items():
            change = (w - base.p[name]) * touched[name][:, None]
            for k in range(0, len(w), CHUNK):
                n = touched[name][k : k + CHUNK]
                if n.any():
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k // CHUNK], pa.int32()), pa.array([change[k : k + CHUNK].astype("<f4").tobytes()], pa.binary()), pa.array([n.astype("<f4").tobytes()], pa.binary())], names=["name", "chunk", "change", "touches"])

    return run


@tidy("lm")
def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], list[np.ndarray]] = {}
    for batch in batches:
        for name, chunk, change, touches in zip(*(batch[c].to_pylist() for c in ("name", "chunk", "change", "touches")), strict=True):
            new = [np.frombuffer(change, "<f4"), np.frombuffer(touches, "<f4")]
            held = sums.get((name, chunk))
            sums[name, chunk] = new if held is None else [held[0] + new[0], held[1] + new[1]]
    for (name, chunk), (change, touches) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([chunk], pa.int32()), pa.array([change.tobytes()], pa.binary()), pa.array([touches.tobytes()], pa.binary())], names=["name", "chunk", "change", "touches"])


def fit_network(train: DataFrame, id_counts: np.ndarray, n: int, seed_windows: int = SEED_WINDOWS, task_windows: int = TASK_WINDOWS) -> Network:
    """The network of the texts ``train(row, ids, draws)``, which have ``n`` windows; an empty corpus leaves it at its first weights."""
    context = train.sparkSession.sparkContext
    size = len(id_counts) - 1
    table = train.select("ids").mapInArrow(_company(most_used(id_counts)[1]), "at int, n binary").repartition("at").mapInArrow(_add_company, "at int, n binary").collect()  # one table of fixed size
    profile = np.zeros((RARE + 1, NEAR), np.int64)
    for at, counts in table:
        profile[at : at + 64] = np.frombuffer(counts, np.int64).reshape(-1, NEAR)
    net = new_network(id_counts, profile=profile)
    whole = n <= 1.05 * seed_windows
    blocks = train.select("row", "ids").mapInArrow(_blocks(size), "mark long, block binary")
    first = blocks if whole else train.select(F.explode("draws").alias("row"))
    shared = context.broadcast(net)
    start = first.repartition(1).sortWithinPartitions(*first.columns).mapInArrow(_fit_start(shared, max(1, min(8, -(-seed_windows // max(1, n))))), "name string, data binary").collect()
    shared.destroy()
    for name, data in start:
        held, k = (net.p if name[0] == "p" else net.steps), name[2:]
        held[k] = np.frombuffer(data, np.float32).reshape(held[k].shape).copy()
    if not whole:
        shared = context.broadcast(net)
        tasks = max(1, min(FIT_TASKS, math.ceil(n / task_windows)))
        schema = "name string, chunk int, change binary, touches binary"
        # dealt evenly, not by a key: a task's changes are as large as the network, so tasks follow the windows alone
        parts = blocks.repartition(tasks).sortWithinPartitions("mark", "block").mapInArrow(_fit_more(shared, shared._jbroadcast.id()), schema)
        sums = materialize(parts.repartition("name", "chunk").mapInArrow(_add_up, schema), "lm-weights")
        for name, chunk, change, touches in sums.collect():  # as large as the network
            w = net.p[name]
            t = np.frombuffer(touches, "<f4")[:, None]
            w[chunk * CHUNK : (chunk + 1) * CHUNK] += np.frombuffer(change, "<f4").reshape(len(t), -1) / np.maximum(t, 1)
        shared.destroy()
        drop(sums)
    net.steps = {}
    return net


class _Numbers(dict):
    """Numbers things as they are first asked for."""

    def __missing__(self, thing):
        self[thing] = n = len(self)
        return n


class Reader:
    """Ids and base values of texts (``head``: log10(c + 1) of the most frequent words).

    What is known of a piece is remembered; where that gets too much, pieces met once go first.
    """

    def __init__(self, head: dict[bytes, float], enc: Subwords):
        self.head, self.enc = head, enc
        self.index: dict[bytes, int] = _Numbers()
        self.pool, self.begin = np.zeros(1 << 16, np.uint16 if self.enc.size <= 1 << 16 else np.uint32), np.zeros(1 << 14, np.int64)
        self.size, self.uses = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.value, self.known, self.tails = np.zeros(1 << 14), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.used = 0

    def _forget(self) -> None:
        """Keep the pieces met most since the last time, of those met again; earlier uses count half."""
        uses = self.uses[: len(self.index)]
        keep = np.flatnonzero(uses > 1)
        if len(keep) > MEMORY // 2:
            keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[: MEMORY // 2]])
        names, size = list(self.index), self.size[keep].astype(np.int64)
        stop = np.cumsum(size)
        self.used = int(size.sum())
        self.pool[: self.used] = self.pool[np.arange(self.used) + np.repeat(self.begin[keep] - (stop - size), size)]
        for c in ("size", "value", "known", "tails"):
            getattr(self, c)[: len(keep)] = getattr(self, c)[keep]
        self.begin[: len(keep)] = stop - size
        uses[: len(keep)], uses[len(keep) :] = uses[keep] // 2, 0
        self.index = _Numbers(zip([names[i] for i in keep.tolist()], range(len(keep)), strict=True))

    def _learn(self, new: list[bytes]) -> None:
        """``new``: the pieces that came last into ``index``."""
        b = len(self.index)
        a = b - len(new)
        ids, size = self.enc.many(new)
        while b > len(self.begin):
            for c in ("begin", "size", "value", "known", "tails", "uses"):
                setattr(self, c, np.concatenate([getattr(self, c), np.zeros_like(getattr(self, c))]))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.begin[a:b], self.size[a:b] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)
        self.value[a:b] = np.fromiter(map(self.head.get, new, repeat(-1.0)), float, len(new))  # no word has less than 0
        self.known[a:b] = self.value[a:b] >= 0
        self.tails[a:b] = ~(self.value[a:b] >= 0)
        self.value[a:b] *= self.known[a:b]
        for i in np.flatnonzero(~one_word(new)).tolist():
            found = list(map(self.head.get, new[i].split()))
            none = found.count(None)
            self.value[a + i], self.known[a + i], self.tails[a + i] = sum(filter(None, found)), len(found) - none, none

    def read(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, list[dict[bytes, int]]]:
        """(ids, words, known words, base values, other words) of some texts."""
        cut = [pieces(t) if t else [] for t in texts]
        if len(self.index) > MEMORY:
            self._forget()
        every = list(chain.from_iterable(cut))
        before = len(self.index)
        n, at = np.array([len(c) for c in cut]), np.fromiter(map(self.index.__getitem__, every), np.int64, len(every))
        if len(self.index) > before:
            self._learn(list(islice(self.index, before, None)))
        self.uses[: len(self.index)] += np.bincount(at, minlength=len(self.index)).astype(np.int32)
        size = self.size[at].astype(np.int64)
        stop = np.concatenate([[0], np.cumsum(size)])
        flat = self.pool[np.arange(stop[-1]) + np.repeat(self.begin[at] - stop[:-1], size)].astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(n)])
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[at])])[edge])
        known, tails = total(self.known), total(self.tails)
        other: list[dict[bytes, int]] = [{} for _ in texts]
        odd = np.flatnonzero(self.tails[at])
        for i, k in zip(odd.tolist(), (np.searchsorted(edge, odd, side="right") - 1).tolist(), strict=True):
            here = other[k]
            for w in every[i].split():
                if w not in self.head:
                    here[w] = here.get(w, 0) + 1
        values = np.array([math.fsum(self.value[at[a:b]].tolist()) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)])
        return np.split(flat, stop[edge[1:-1]]), known + tails, known, values, other


def _read(path: str, shared, key: int, gap: float):
    """Ids of every text, what its words give the base, and windows drawn from training texts, one for about ``gap`` bytes."""

    @tidy("lm")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = subwords(path)
        reader = hold("lm", ("reader", key), lambda: Reader(shared.value, enc))
        kind = _kind(enc.size)
        task, row = TaskContext.get().partitionId() << 40, 0
        end_value = reader.head.get(END)
        ends = int(end_value is not None)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in batch["text"].to_pylist()]
            n_tokens, known, base, tails, tail_n, written = [], [], [], [], [], []
            group, size = [], 0
            for j, t in enumerate(texts):
                group.append(t)
                size += len(t)
                if size > 1_000_000 or j == len(texts) - 1:
                    ids, n, k, v, other = reader.read(group)
                    written += [i.astype(kind).tobytes() for i in ids]
                    n_tokens += (n + 1).tolist()
                    known += (k + ends).tolist()
                    base += (v + (end_value or 0.0)).tolist()
                    tails += [list(x) for x in other]
                    tail_n += [list(x.values()) for x in other]
                    group, size = [], 0
            learned = [j for j, out in enumerate(batch["held_out"].to_pylist()) if texts[j] and not out]
            draws: list[list[bytes]] = [[] for _ in texts]
            if learned:  # the first training row takes those of all
                hashes, cut = drawn(enc, [texts[j] for j in learned], gap)
                draws[learned[0]] = [h.to_bytes(8, "big") + r.tobytes() for h, r in zip(hashes.tolist(), cut, strict=True)]
            rows = np.arange(row, row + len(texts)) + task
            row += len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch["doc_id"], batch["held_out"], pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(tails, pa.list_(pa.binary())), pa.array(tail_n, pa.list_(pa.int32())), pa.array(written, pa.binary()), pa.array(draws, pa.list_(pa.binary()))],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "tail", "tail_n", "ids", "draws"],
            )

    return run


def _score(shared, key: int):
    @tidy("lm")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        scorer = hold("lm", ("scorer", key), lambda: Scorer(shared.value))
        for batch in (part for whole in batches for part in slices(whole, "ids", 1 << 20)):
            scores = scorer.text_scores(_ids(batch, _kind(scorer.net.end)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "ids"), pa.array(scores, pa.float64())], names=[*(c for c in batch.schema.names if c != "ids"), "score"])

    return run


def score_texts(docs: DataFrame, learn: Column | None = None, path: str | None = None, head_words: int = HEAD_WORDS, seed_windows: int = SEED_WINDOWS, task_windows: int = TASK_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows where ``learn`` does not hold (by default the held-out seventh) are
    scored but not learned from.  Null text is empty: its end is its only token.
    Rows of equal ids are texts of their own.  Without training rows every count
    is 0 and the network keeps its first weights; an empty table gives an empty
    result.  Other columns of ``docs`` are not read.  Rows that lie otherwise in
    partitions are learned from in another order, which moves ``score`` a little.
    """
    spark = docs.sparkSession
    path = path or default_path()
    out = held_out(F.col(id_col)) if learn is None else ~F.coalesce(learn, F.lit(False))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), out.alias("held_out"))
    train = source.filter(~F.col("held_out")).select("text")
    schema = "word binary, c long, space long, line long"
    counts = materialize(train.mapInArrow(_count, schema).groupBy("word").agg(*(F.sum(c).alias(c) for c in ("c", "space", "line"))), "word-counts")
    n_bytes = F.sum((F.octet_length("word") + 1) * (F.col("space") + F.col("line")))
    total, distinct, n_bytes, texts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(n_bytes, F.lit(0)), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0))).first()
    top = counts.filter("c > 0").orderBy(F.desc("c"), "word").limit(head_words).select("word", "c").toArrow()
    head = dict(zip(top["word"].to_pylist(), np.log10(top["c"].to_numpy() + 1.0).tolist(), strict=True))
    id_counts = np.zeros(Subwords(path).size + 1, np.int64)
    for r in counts.filter("space + line > 0").mapInArrow(_id_counts(path), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each id of the vocabulary
        id_counts[r.id] = r.n
    id_counts[-1] = texts
    gap = max(8.0, (int(n_bytes) + 4 * SCORED * texts) / seed_windows)
    shared = spark.sparkContext.broadcast(head)
    types = dict(source.dtypes)
    columns = f"row long, doc_id {types['doc_id']}, held_out boolean, n_tokens long, known long, base double"
    n_ids = F.octet_length("ids") / _kind(len(id_counts) - 1).itemsize
    read = materialize(
        source.mapInArrow(_read(path, shared, shared._jbroadcast.id(), gap), f"{columns}, tail array<binary>, tail_n array<int>, ids binary, draws array<binary>"),
        "lm-ids",
        n=F.sum(F.when(~F.col("held_out"), F.floor(n_ids / SCORED) + 1)),
    )
    shared.destroy()
    net = fit_network(read.filter(~F.col("held_out")), id_counts, int(read.measured["n"] or 0), seed_windows, task_windows)
    shared = spark.sparkContext.broadcast(net)
    scored = materialize(read.drop("tail", "tail_n", "draws").mapInArrow(_score(shared, shared._jbroadcast.id()), f"{columns}, score double"), "scored")
    shared.destroy()
    tail = read.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("n"))
    rare = (
        tail.join(counts.filter("c > 0").select("word", "c"), "word")
        .groupBy("row")
        .agg(F.sum("n").cast("long").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("value"))
    )
    spread = math.log10(total + distinct + 1)
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("value", F.lit(0.0)) - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        "score",
    )
