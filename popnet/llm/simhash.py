"""SimHash near-duplicate detection by pigeonhole blocks (operator 9).

Fingerprints: ASCII-lower-cased text, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``width``
words with repeats, XXH64 (seed 42) of each; a bit is 1 where over half the hashes have it.

Links: two fingerprints within ``distance`` bits share all but ``distance`` of ``blocks``
blocks, so every choice of ``blocks - distance`` blocks is a join key (6 blocks, distance
2: 15 keys of 42 to 44 bits).  Distinct fingerprints only enter the join, so a group of
exact copies is one entry however large it is.  A bucket holds at most 2^22 distinct
values, as its other bits are fixed; inside it, a spanning forest of the pairs verified by
Hamming distance is returned instead of all pairs, which loses no connection.

Defined cases: null text is an empty text; a text without words has fingerprint zero and
links like any other; rows with a null doc_id get a fingerprint and the component of
their fingerprint's links, null if no linked row has a doc_id; repeated rows stay; an empty
table gives an empty table; a text of any length is read whole, ``COUNTED`` shingles at a
time; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from popnet.llm.graph import components
from popnet.llm.shared import bounded, table, tidied, written

SEED = 42
WIDTH = 3
DISTANCE = 2
BLOCKS = 6
#: Shingles whose bits are counted at once; bounds the memory that one long text needs.
COUNTED = 1 << 15
#: Buckets up to this size are compared pair by pair, larger ones by probing bit flips.
DIRECT = 1024
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text, an unsigned 64-bit integer."""
    words = text.translate(_LOWER).split()  # bytes.split: runs of \x20 \x09-\x0D
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(flat, seed)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = np.concatenate(([0], gaps[: len(words) - width] + 1))
    ends = np.concatenate((gaps[width - 1 :], [len(flat)]))
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), COUNTED):
        part = zip(starts[at : at + COUNTED].tolist(), ends[at : at + COUNTED].tolist(), strict=True)
        hashes = np.array([digest(flat[a:b], seed) for a, b in part], dtype=">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, 1):
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        found = [_signed(fingerprint(t or b"", width, seed)) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per row of ``docs``."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(lambda it: tidied(_fingerprints(it, width, seed)), "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """The bits kept by each join key."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _flips(free: list[int], distance: int) -> np.ndarray:
    masks = [sum(1 << b for b in c) for n in range(1, distance + 1) for c in combinations(free, n)]
    return np.array(masks, np.uint64)


def forest(values: np.ndarray, free: list[int], distance: int) -> list[tuple[int, int]]:
    """Positions (i, j), i < j, of a spanning forest of the links among distinct sorted ``values``."""
    n = len(values)
    label = np.arange(n)
    edges: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            label[max(a, b)] = min(a, b)
            edges.append((min(i, j), max(i, j)))

    def find(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return int(i)

    if n <= DIRECT:
        for i in range(n - 1):
            near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= distance)
            for j in near.tolist():
                join(i, i + 1 + j)
        return edges
    for mask in _flips(free, distance):
        other = values ^ mask
        at = np.searchsorted(values, other).clip(max=n - 1)
        hit = np.flatnonzero((values[at] == other) & (at > np.arange(n)))
        for i, j in zip(hit.tolist(), at[hit].tolist(), strict=True):
            join(i, j)
    return edges


def _linked(batches: Iterator[pa.RecordBatch], masks: list[int], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, fps) to the links of each bucket: (a, b), both fingerprints."""
    for batch in batches:
        lefts: list[np.ndarray] = []
        rights: list[np.ndarray] = []
        column = batch.column(1)
        flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        offsets = offsets - offsets[0]
        sizes = np.diff(offsets)
        two = np.flatnonzero(sizes == 2)
        a, b = flat[offsets[two]], flat[offsets[two] + 1]
        close = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
        lefts.append(a[close])
        rights.append(b[close])
        parts = batch.column(0).to_pylist()
        for row in np.flatnonzero(sizes > 2).tolist():
            values = np.unique(flat[offsets[row] : offsets[row + 1]].view(np.uint64))
            free = [bit for bit in range(64) if not masks[parts[row]] >> bit & 1]
            if found := forest(values, free, distance):
                pairs = np.array(found)
                lefts.append(values[pairs[:, 0]].view(np.int64))
                rights.append(values[pairs[:, 1]].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(lefts), pa.int64()), pa.array(np.concatenate(rights), pa.int64())], names=["a", "b"]
        )


def links(distinct: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) whose components are those of all links."""
    masks = block_masks(blocks, distance)
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("k.part", "k.key", "fp")
    buckets = (
        keyed.groupBy("part", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("part", "fps")
    )
    return buckets.mapInArrow(lambda it: tidied(_linked(it, masks, distance)), "a long, b long")


def groups(hashed: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id) for each fingerprint of ``hashed`` (doc_id, fp); ``root`` names the group by a fingerprint."""
    # a class: the rows of one fingerprint, with its smallest doc_id
    classes = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes.select("fp"), blocks, distance).select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, seed: int = SEED, blocks: int = BLOCKS, distance: int = DISTANCE
) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for each row of ``docs`` (doc_id, text)."""
    hashed = written(fingerprints(docs, width, seed), "simhash")
    return hashed.join(groups(hashed, blocks, distance), "fp", "left").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")
