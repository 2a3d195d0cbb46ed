"""Near-duplicate documents by MinHash, odd sketches and exact verification.

1. Every text becomes its set of word shingles; MinHash samples of the set make
   band keys, and the samples folded into a parity bitmap make its odd sketch.
   Documents with equal sets are one class from here on.
2. Classes that share a band key are candidates; connected candidates make a
   family.  Families are cut into blocks of bounded size; a work unit is a block
   or a pair of blocks.
3. Inside a unit the population counts of XORed sketches estimate similarities
   and order the pairs; a pair of classes not yet united is confirmed on the full
   sets.  United classes need no further comparison, so a family of n near copies
   takes about n confirmations.
4. Confirmed links give the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delvegraph.llm.components import Forest, connected_components
from delvegraph.llm.storage import materialize
from delvegraph.llm.textkit import chunks, mix, shingle_hashes, slices
from delvegraph.llm.worker import tidy

#: 24 bands of 4 samples: a pair at similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 24, 4
SKETCH_BITS = 256
#: Pairs whose sketches estimate less are not confirmed; of pairs at similarity 0.8 fewer than 1 in a million do.
LEAST_ESTIMATE = 0.45
#: Bounds of a block: documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 2_000_000

_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
_XOR = (_SEEDS[: BANDS * ROWS] >> np.uint64(32)).astype(np.uint32)
_MUL = ((_SEEDS[BANDS * ROWS :] >> np.uint64(32)).astype(np.uint32)) | np.uint32(1)
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def distinct_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    s, begins = shingle_hashes(texts, k)
    return [np.unique(s[a:b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(band keys, odd sketches, digests of the sets) of non-empty sets."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0] + [len(s) for s in sets[:-1]])
    low = (flat >> np.uint64(32)).astype(np.uint32)
    samples = np.empty((len(sets), BANDS * ROWS), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(BANDS * ROWS):
            samples[:, i] = np.minimum.reduceat((low ^ _XOR[i]) * _MUL[i], begins)
        wide = samples.astype(np.uint64)
        keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sets), 1))
        for r in range(ROWS):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + wide[:, r::ROWS])
        bit = mix(wide + (np.arange(BANDS * ROWS, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
        place = (np.arange(len(sets))[:, None] * SKETCH_BITS + bit.astype(np.int64)).ravel()
        parity = (np.bincount(place, minlength=len(sets) * SKETCH_BITS) & 1).astype(np.uint8).reshape(len(sets), SKETCH_BITS)
        one, two = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begins), np.bitwise_xor.reduceat(mix(flat + np.uint64(0x5851F42D4C957F2D)), begins)
    digests = [x.tobytes() for x in np.stack([one, two], axis=1)]
    return keys.view(np.int64), np.packbits(parity, axis=1), digests


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the population count of two XORed odd sketches."""
    inside = np.maximum(1.0 - 2.0 * differing / SKETCH_BITS, 1e-9)
    return 1.0 + SKETCH_BITS / (4.0 * BANDS * ROWS) * np.log(inside)


def _sign(k: int):
    @tidy("near")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for begin, some in chunks(texts):
                sets = distinct_sets(some, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(some)
                sketch: list = [None] * len(some)
                digest: list = [None] * len(some)
                if full:
                    keys, sketches, digests = signatures([sets[i] for i in full])
                    for j, i in enumerate(full):
                        bands[i], sketch[i], digest[i] = keys[j], sketches[j].tobytes(), digests[j]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(some)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "sketch", "bands"],
                )

    return run


def _sets(k: int):
    @tidy("near")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]
            for begin, some in chunks(texts):
                packed = [s.tobytes() for s in distinct_sets(some, k)]
                rows = batch.slice(begin, len(some))
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()) if n == "text" else rows[n] for n in rows.schema.names], names=rows.schema.names)

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| on sorted distinct sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def unit_links(ids: list[int], sides: list[int], sketches: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Confirmed links of a unit that span its components.

    ``sides`` is 0 in a unit of one block; of two blocks (1 and 2) only the pairs
    across matter, as those inside have a unit of their own.
    """
    n = len(ids)
    order = sorted(range(n), key=lambda i: ids[i])
    lane = np.array(sides)
    size = np.array([len(s) for s in sets])
    forest, out = Forest(), []
    for at, i in enumerate(order[:-1]):
        rest = np.array(order[at + 1 :])
        fit = (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])) & ((lane[rest] != lane[i]) | (lane[rest] == 0))
        rest = rest[fit]
        if not len(rest):
            continue
        apart = _ONES[sketches[rest] ^ sketches[i]].sum(axis=1, dtype=np.int64)
        near = estimate(apart) >= LEAST_ESTIMATE
        rest, apart = rest[near], apart[near]
        for j in rest[np.argsort(apart, kind="stable")].tolist():
            if forest.find(ids[i]) != forest.find(ids[j]) and linked(sets[i], sets[j], percent):
                forest.union(ids[i], ids[j])
                out.append((ids[i], ids[j]))
    return out


def _confirm(percent: int):
    def flush(rows: list[tuple]) -> list[tuple[int, int]]:
        ids, sides, sketches, sets = zip(*rows, strict=True)
        return unit_links(list(ids), list(sides), np.frombuffer(b"".join(sketches), np.uint8).reshape(len(ids), -1), [np.frombuffer(s, np.uint64) for s in sets], percent)

    @tidy("near")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, found = None, [], []
        for batch in batches:
            for unit, *row in zip(*(batch[c].to_pylist() for c in ("unit", "rep", "side", "sketch", "text")), strict=True):
                if unit != now:
                    if len(rows) > 1:
                        found += flush(rows)
                    now, rows = unit, []
                rows.append(tuple(row))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
                found = []
        if len(rows) > 1 and (found := flush(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Ids are longs.  Null, empty and wordless texts have no shingles and are
    components of their own; equal sets are linked; rows of equal ids count as
    one document in links and each gets its row; a row without an id links
    nothing and has a null component.  An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(source.mapInArrow(_sign(shingle), "doc_id long, n_shingles long, digest binary, sketch binary, bands array<long>"), "minhash")
    classes = materialize(
        signed.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")),
        "classes",
    )
    keys = classes.select("rep", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "hub")
    candidates = keys.join(hubs, "key").filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    families = connected_components(candidates)
    members = families.join(classes.select("rep", "n", "sketch"), families["node"] == F.col("rep")).select("component", "rep", "n", "sketch")
    sizes = members.groupBy("component").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("n_blocks")
    )
    block = F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda j: F.struct(F.least("block", j).alias("lo"), F.greatest("block", j).alias("hi")))
    work = (
        members.join(sizes, "component")
        .withColumn("block", block)
        .withColumn("pairs", pairs)
    )
    work = materialize(work, "families")
    sets = source.filter("text is not null").join(work.hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).select("component", "rep", "block", "pairs", "sketch", "text")
    sets = sets.mapInArrow(_sets(shingle), "component long, rep long, block int, pairs array<struct<lo:int,hi:int>>, sketch binary, text binary")
    units = sets.select("rep", "block", "sketch", "text", "component", F.explode("pairs").alias("p")).select(
        F.xxhash64("component", "p.lo", "p.hi").alias("deal"),
        F.struct("component", "p.lo", "p.hi").cast("string").alias("unit"),
        "rep",
        F.when(F.col("p.lo") == F.col("p.hi"), 0).when(F.col("block") == F.col("p.lo"), 1).otherwise(2).alias("side"),
        "sketch",
        "text",
    )
    dealt = units.repartition("deal").sortWithinPartitions("unit").select("unit", "rep", "side", "sketch", "text")
    links = materialize(dealt.mapInArrow(_confirm(percent), "a long, b long"), "confirmed")
    parts = connected_components(links)
    placed = classes.select("digest", "rep").join(parts, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(placed, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one of smallest id.

    Rows that repeat that id all stay as they are one document; rows without an
    id stay.  All columns are kept.
    """
    found = near_duplicates(docs, shingle, percent, id_col, text_col)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    row = docs.select(F.col(id_col).alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # no column meets another of its name
    return row.join(gone, F.col("id") == F.col("doc_id"), "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
