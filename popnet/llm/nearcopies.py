"""Near copies by the Jaccard similarity of word shingles (the pipeline's near-duplicate stage).

Words as in ``simhash``; a text is the set of its shingles of ``WIDTH`` words (one shingle
of all words if it has fewer), each a 64-bit hash.  Two texts are near copies if the
Jaccard similarity of their sets is ``SIMILARITY`` or more; groups are the components.

Distinct sets only enter, so exact copies are one entry; every link is verified on the sets
themselves.  Links are sought by SimHash, and in two rounds for what it leaves apart:

0. Each set has a SimHash fingerprint of its shingles; the pigeonhole blocks of ``simhash``
   give a spanning forest of the fingerprints within ``simhash.DISTANCE`` bits, sets of equal
   fingerprints meet their least.  The next round tries no
   pair inside one of its components.
1. At similarity 0.8 fingerprints differ in 9.7 of 64 bits on average, beyond what blocks can
   find, so other keys follow.  Sets that share one of ``BANDS`` keys of ``ROWS`` minimum hashes each are a bucket (a pair at
   similarity 0.8 shares none with probability (1 - 0.8^5)^32 = 3e-6, one above it with less).
   A bucket is cut into parts of about ``PART`` sets before it is gathered.  In a part, pairs
   are tried along a tree, and each set whose pair there is not a sure one with those of
   the nearest sketches (a byte of each minimum hash): at most 1 + ``NEAREST`` pairs a set
   and bucket, whatever the bucket's size.
2. Sets of buckets that hold several components of verified links then meet by their rare shingles, which is
   exact among them.  Shingles that only one component has come first, the others by the number
   of sets that have them; two sets as similar as wanted share one of the first few (prefix
   filter: a ninth of the smaller set's, a fifth of the larger one's), at places that leave
   room for enough others.  Pages that share a template and no more are no candidates: what is
   their own fills those few places.  So the work grows with the sets and with the pairs that
   might be links, not with the square of a bucket.

Pairs of round 1 whose sketches differ in over ``FAR`` bytes are not tried there.

Defined cases: null text is an empty text; texts without words are one group; rows with a
null doc_id count last; of rows that repeat a doc_id and its text one stays, the first by a
hash of all columns; an empty table gives an empty table; long texts are read whole; further
columns stay and may have any names but those starting with ``__dup_``, which raise
ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from popnet.llm import simhash
from popnet.llm.graph import components
from popnet.llm.shared import bounded, released, tidied, written

WIDTH = 5
SIMILARITY = 0.8
#: The same as a fraction.
OF, ALL = Fraction(SIMILARITY).limit_denominator(1000).as_integer_ratio()
ROWS = 5
BANDS = 32
#: Most sketch bytes, of ROWS * BANDS, in which a candidate pair differs.
FAR = 58
#: Sketch bytes up to which a pair along the tree needs no other beside it in the first round.
SURE = 20
#: Sets in a part of a bucket in the first round, about, and the nearest ones that each meets.
PART, NEAREST = 512, 3
#: Sets that meet the same set along a tree, about, and bytes of sets in a block of those to verify.
FAN, BLOCK = 32, 4 << 20
#: Bits of the map of names that is broadcast (4 MB).
PLACES = 1 << 25
#: Shingles whose minimum hashes are taken at once; words whose hashes a worker keeps.
AT_ONCE, KNOWN = 512, 1 << 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(42).integers(0, 1 << 64, (2, ROWS * BANDS, 1), np.uint64)
_FLIP, _TIMES = _RANDOM[0], _RANDOM[1] | np.uint64(1)
_words: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word(word: bytes) -> int:
    found = _words.get(word)
    if found is None:
        if len(_words) >= KNOWN:
            _words.clear()
        found = _words[word] = xxhash.xxh64_intdigest(word, 42)
    return found


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The hashes of a text's shingles: sorted, distinct, unsigned."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_word, words), np.uint64, len(words))
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = total * _STEP + hashes[k : len(words) - n + 1 + k]
    return np.unique(_mixed(total))


def minima(found: np.ndarray) -> np.ndarray:
    """The minimum hashes of a set."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), AT_ONCE):
        np.minimum(least, ((found[at : at + AT_ONCE] ^ _FLIP) * _TIMES).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key a band."""
    total = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        total = total * _STEP + least[k::ROWS]
    return _mixed(total)


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set, unsigned: a bit is 1 where over half the hashes have it; zero for no hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(found), simhash.COUNTED):
        part = found[at : at + simhash.COUNTED].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(found)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _name(found: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(found.tobytes(), 42)) if len(found) else 0


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, 1):
        names, sizes, keys, bits, prints = [], [], [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            found = shingles(text or b"")
            least = minima(found)
            names.append(_name(found))
            sizes.append(len(found))
            keys.append(band_keys(least))
            bits.append((least >> np.uint64(20)).astype(np.uint8).tobytes())
            prints.append(_signed(fingerprint(found)))
        flat = pa.array(np.concatenate(keys).view(np.int64), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * BANDS, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(bits, pa.binary()), pa.array(prints, pa.int64())], names=["doc_id", "th", "fp", "size", "keys", "sketch", "simhash"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, 0):
        found = [shingles(t or b"") for t in batch.column(0).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["fp", "shingles"])


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in found)]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def tree(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) that connect distinct sorted unsigned ``names``: those of equal leading bits to their least, these to the least of all."""
    bits = max(0, (len(names) // FAN).bit_length())
    lead = names >> np.uint64(64 - bits) if bits else np.zeros(len(names), np.uint64)
    _, first, of = np.unique(lead, return_index=True, return_inverse=True)
    up = first[of]
    up[first] = 0
    return np.arange(1, len(names)), up[1:]


def _differing(sketches: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The number of bytes in which each of ``some`` differs from each of ``sketches``."""
    return np.count_nonzero(some[:, None, :] != sketches[None, :, :], axis=2)


def nearest(sketches: np.ndarray, roots: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j): for each set at ``rows`` those of other components with the nearest sketches."""
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    k = min(NEAREST, len(roots) - 1)
    for at in range(0, len(rows), 64):
        own = rows[at : at + 64]
        part = _differing(sketches, sketches[own])
        part[roots[own, None] == roots[None, :]] = 1 << 20
        j = np.argpartition(part, k - 1, axis=1)[:, :k]
        i = np.repeat(own, k)
        fine = np.take_along_axis(part, j, axis=1).ravel() <= FAR
        lefts.append(i[fine])
        rights.append(j.ravel()[fine])
    return np.concatenate(lefts), np.concatenate(rights)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 1: parts of buckets (least: the bucket's least name, its root, m: fp, root, sketch) to pairs of different roots."""
    for batch in batches:
        heads, tops, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        flat, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        all_names = flat.field("fp").to_numpy(zero_copy_only=False)
        all_roots = flat.field("root").to_numpy(zero_copy_only=False)
        all_sketches = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(-1, ROWS * BANDS)
        found = []
        for n, (head, top) in enumerate(zip(heads, tops, strict=True)):
            own = slice(at[n], at[n + 1])
            order = np.argsort(all_names[own].view(np.uint64))
            names, roots, sketches = all_names[own][order], all_roots[own][order], all_sketches[own][order]
            if top != roots[0] and head not in names:
                found.append((names[:1], np.array([head])))  # parts of one bucket meet its least set
            i, j = tree(names.view(np.uint64))
            far = np.count_nonzero(sketches[i] != sketches[j], axis=1)
            tried = (far <= FAR) & (roots[i] != roots[j])
            found.append((names[i[tried]], names[j[tried]]))
            unsure = np.ones(len(names), bool)  # a set's own pair along the tree hardly fails
            unsure[i[far <= SURE]] = False
            if len(names) > 1:
                a, b = nearest(sketches, roots, np.flatnonzero(unsure))
                found.append((names[a], names[b]))
        yield _pairs(found)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, root, size, shingles) to (token, fp, root, size), a row a shingle."""
    for batch in bounded(batches, 3):
        sets = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
        lengths = [len(x) for x in sets]
        named = [pa.array(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), lengths), pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets])), *named], names=["token", "fp", "root", "size"])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (len(x) + len(y) - both)


def _verified(_: tuple, pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The pairs (.., a, b) of a block pair whose sets (.., fp, shingles) are as similar as wanted."""
    found = dict(zip(sets.column("fp").to_pylist(), (np.frombuffer(x, np.uint64) for x in sets.column("shingles").to_pylist()), strict=True))
    kept = []
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
        kept.append(_similar(found[a], found[b]))
    return pairs.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


KEY = ["__dup_none", "__dup_id", "__dup_th"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the three columns that name a row: whether it has no doc_id, the doc_id, and a hash of the text."""
    return docs.withColumns({"__dup_none": F.col("doc_id").isNull(), "__dup_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__dup_th": F.xxhash64(F.col("text").cast("string"))})


def _maybe(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with ``__dup_maybe``: false only where KEY is surely none of ``names``'.

    A bitmap of PLACES bits, whatever the number of names, is broadcast; so texts that no name
    means meet no shuffle.  With many more names than places it tells less, and more texts travel.
    """
    place = F.pmod(F.xxhash64(*KEY), F.lit(PLACES))
    bits = names.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("__dup_page")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("__dup_bits"))
    out = rows.withColumn("__dup_place", place).withColumn("__dup_page", F.expr("__dup_place div 32768")).join(F.broadcast(bits), "__dup_page", "left")
    byte = "cast(conv(hex(substring(__dup_bits, cast((__dup_place % 32768) div 8 as int) + 1, 1)), 16, 10) as int)"
    return out.withColumn("__dup_maybe", F.expr(f"coalesce({byte} & shiftleft(1, cast(__dup_place % 8 as int)) <> 0, false)")).drop("__dup_page", "__dup_place", "__dup_bits")


def _named(best: str) -> list[Column]:
    return [F.col(f"{best}.{x}").alias(k) for x, k in zip(("none", "id", "th"), KEY, strict=True)]


def _sets_of(docs: DataFrame, classes: DataFrame, names: DataFrame) -> DataFrame:
    """(fp, shingles) of the sets named by ``names`` (fp); a set is read from the least row of its class."""
    rows = written(classes.join(names, "fp", "left_semi").select(*_named("best")), "candidate-rows")
    texts = _maybe(_keyed(docs.select("doc_id", "text")), rows).where("__dup_maybe").join(rows, KEY, "left_semi").select(F.col("text").cast("string").alias("text"))
    # rows that repeat both doc_id and text give a set more than once
    out = written(texts.mapInArrow(lambda it: tidied(_sets(it)), "fp long, shingles binary").dropDuplicates(["fp"]), "shingles")
    released(rows)
    return out


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of ``sets`` (fp, shingles) that are as similar as wanted.

    Sets go to groups of pairs, not to each pair: the components of the pairs are cut into
    blocks of about BLOCK bytes, and a group is the pairs of two blocks, or of many components
    of one block.
    """
    nodes = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "fp")
    nodes = written(nodes.join(sets.select("fp", (F.length("shingles") + 512).alias("bytes")), "fp"), "nodes")
    sizes = nodes.groupBy("component").agg(F.sum("bytes").alias("n"))
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = F.ceil(F.col("n") / BLOCK)
    mixed = F.pmod(F.xxhash64("component"), F.lit(max(1, -(-total // BLOCK))))
    placed = nodes.join(sizes, "component").select(
        "fp", F.when(blocks > 1, F.col("component")).otherwise(mixed).alias("part"),
        F.when(blocks > 1, F.pmod(F.xxhash64("fp"), blocks)).otherwise(F.lit(-1)).alias("block"),
    )
    placed = written(placed, "placed")
    left, right = (placed.select(F.col("fp").alias(x), "part", F.col("block").alias(f"block_{x}")) for x in ("a", "b"))
    at = ["part", "lo", "hi"]
    tasks = pairs.join(left, "a").join(right, ["b", "part"]).select("part", F.least("block_a", "block_b").alias("lo"), F.greatest("block_a", "block_b").alias("hi"), "a", "b")
    tasks = written(tasks, "tasks")
    wanted = written(tasks.select(*at, F.explode(F.array("a", "b")).alias("fp")).distinct(), "wanted")  # a set goes where a pair has it
    given = sets.join(wanted, "fp").select(*at, "fp", "shingles").toDF("for_part", "for_lo", "for_hi", "fp", "shingles")
    found = tasks.groupBy(*at).cogroup(given.groupBy("for_part", "for_lo", "for_hi")).applyInArrow(_verified, "a long, b long")
    found = written(found, "links")
    released(nodes, placed, tasks, wanted)
    return found


def rare_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) of ``sets`` (fp, root, size, shingles) of different roots that may be as similar as wanted, a < b, each once.

    Exact by prefixes: sets of x and y shingles, x <= y, at OF / ALL share at least
    OF (x + y) / (OF + ALL) of them; so at most x (ALL - OF) / (ALL + OF) of the smaller
    set's, in any one order, come before the first shared one.
    """
    tokens = sets.select("fp", "root", "size", "shingles").mapInArrow(lambda it: tidied(_tokens(it)), "token long, fp long, root long, size long")
    common = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token", "n")
    kept = tokens.join(common, "token").groupBy("fp", "root", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("m"))
    least = lambda x, y: F.ceil(OF * (F.col(x) + F.col(y)) / (OF + ALL))
    own = F.col("size") - F.size("m")
    first = (F.col("size") - F.ceil(OF * F.col("size") / ALL) + 1 - own).cast("int")
    rows = kept.select("fp", "root", "size", own.alias("own"), F.posexplode(F.slice("m", 1, F.greatest(F.lit(0), first))).alias("pos", "t"))
    rows = written(rows.select(F.col("t.token").alias("token"), "fp", "root", "size", (F.col("own") + F.col("pos")).alias("at")), "rare")
    x = rows.where(F.col("at") <= F.col("size") - least("size", "size")).toDF("token", "fp_x", "root_x", "size_x", "at_x")
    y = rows.toDF("token", "fp_y", "root_y", "size_y", "at_y")
    room = F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y")) >= least("size_x", "size_y")
    met = x.join(y, "token").where("root_x <> root_y and size_x <= size_y").where(room)
    out = written(met.select(F.least("fp_x", "fp_y").alias("a"), F.greatest("fp_x", "fp_y").alias("b")).distinct(), "rare-pairs")
    released(rows)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp, size, keys, sketch, simhash) of each row: the text's hash, its set's name and size, its band keys, its sketch and its SimHash."""
    some = _keyed(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("__dup_th").alias("th"))
    return written(some.mapInArrow(lambda it: tidied(_signatures(it)), "doc_id long, th long, fp long, size long, keys array<long>, sketch binary, simhash long"), "minima")


def groups(docs: DataFrame, hashed: DataFrame) -> DataFrame:
    """(fp, best, root) of each distinct set of ``hashed`` (the ``signatures`` of ``docs``); ``best`` names its least row, ``root`` its group."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "th")).alias("best")
    # copies of one set have one list of keys: any of them will do
    classes = written(hashed.groupBy("fp").agg(best, F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("simhash").alias("simhash")), "classes")
    close, roots = simhash_pairs(classes)
    others, members = first_pairs(classes, roots)
    tried = close.unionByName(others)
    sets = _sets_of(docs, classes, tried.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
    links = _verify(tried, sets)
    released(sets)
    rooted = _rooted(classes, links)
    now = written(members.join(rooted.select("fp", "root"), "fp"), "rooted-members")
    still = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    open_ = written(now.join(still, "key", "left_semi").select("fp", "root").distinct().join(classes.select("fp", "size"), "fp"), "open")
    sets = _sets_of(docs, classes, open_.select("fp"))
    rare = rare_pairs(open_.join(sets, "fp"))
    more = _verify(rare, sets)
    out = _rooted(classes, links.unionByName(more))
    released(classes, close, roots, members, others, links, rooted, now, open_, sets, rare, more)
    return out


def simhash_pairs(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of sets within ``simhash.DISTANCE`` bits, a spanning forest, from ``classes`` (fp, simhash); and (fp, root), the component of each set that has a pair."""
    prints = written(classes.groupBy("simhash").agg(F.min("fp").alias("least")), "fingerprints")
    blocks = simhash.links(prints.select(F.col("simhash").alias("fp"))).distinct()
    left, right = (prints.select(F.col("simhash").alias(x), F.col("least").alias(f"least_{x}")) for x in ("a", "b"))
    met = blocks.join(left, "a").join(right, "b").select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"))
    equal = classes.select("fp", "simhash").join(prints, "simhash").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    close = written(met.unionByName(equal), "simhash-pairs")
    roots = written(components(close.select(F.col("a").alias("u"), F.col("b").alias("v"))).toDF("fp", "root"), "simhash-roots")
    released(prints)
    return close, roots


def first_pairs(classes: DataFrame, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of the first round, and the members (key, fp) of buckets of several sets, from ``classes`` (fp, keys, sketch).

    Sets of equal ``roots`` (fp, root) are not tried with each other; one without a root is its own.
    """
    each = classes.select("fp", F.explode("keys").alias("key"))
    busy = written(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = each.join(busy, "key").select("key", "fp", F.pmod(F.xxhash64("fp", "key"), F.ceil(F.col("n") / PART)).alias("part"))
    members = rooted = written(members, "members")
    root = F.col("fp")
    if roots is not None:
        rooted, root = members.join(roots, "fp", "left"), F.coalesce("root", "fp")
    rooted = written(rooted.select("key", "fp", "part", root.alias("root")), "members-by-root")
    least = F.min(F.struct("fp", "root")).alias("least")
    open_ = rooted.groupBy("key").agg(least, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "least")
    parts = rooted.join(open_, "key").join(classes.select("fp", "sketch"), "fp").groupBy("key", "part", "least").agg(F.collect_list(F.struct("fp", "root", "sketch")).alias("m"))
    tried = parts.select("least.fp", "least.root", "m").mapInArrow(lambda it: tidied(_near(it)), "a long, b long")
    tried = written(tried.where("a <> b").distinct(), "candidates")
    released(busy, rooted)
    return tried, members.select("key", "fp")


def _rooted(classes: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "fp")
    return written(classes.select("fp", "best").join(found, "fp", "left").select("fp", "best", F.coalesce("component", "fp").alias("root")), "rooted")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per group of near copies: the smallest doc_id's (nulls last); all columns stay.

    Rows that go are named by (doc_id, hash of the text), and the texts meet those names,
    not each other; only texts that a bitmap of the names lets through are shuffled.  Of rows that
    repeat the chosen doc_id and text, one stays; they alone are numbered.
    """
    if clash := [c for c in docs.columns if c.lower().startswith("__dup_")]:
        raise ValueError(f"columns {clash} have names that this uses itself")
    hashed = signatures(docs)
    grouped = groups(docs, hashed)
    chosen = written(grouped.groupBy("root").agg(F.min("best").alias("best")).select(*_named("best")), "chosen")
    names = hashed.select(F.col("doc_id").isNull().alias(KEY[0]), F.coalesce("doc_id", F.lit(0)).alias(KEY[1]), F.col("th").alias(KEY[2])).groupBy(*KEY).agg(F.count("*").alias("n"))
    names = written(names.join(chosen.withColumn("stays", F.lit(True)), KEY, "left").where("n > 1 or stays is null"), "leaving")
    released(hashed, grouped, chosen)
    rows = _keyed(docs)
    own = [F.col(f"`{c}`") for c in docs.columns]
    marked = _maybe(rows, names)
    out = marked.where("not __dup_maybe").select(*own).union(marked.where("__dup_maybe").join(names.select(*KEY), KEY, "left_anti").select(*own))
    again = names.where("stays")
    if again.isEmpty():
        return out
    order = [F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("__dup_")])))]
    several = _maybe(rows, again).where("__dup_maybe").join(again.select(*KEY), KEY, "left_semi").withColumn("__dup_at", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)))
    return out.union(several.where(F.col("__dup_at") == 1).select(*own))
