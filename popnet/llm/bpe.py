"""BPE encoding and decoding with content-defined chunk reuse (operator 3).

A text is cut where a hash of the 16 bytes before a place has ``mask_bits`` leading zeros,
so equal passages of different documents give equal chunks.  Chunks that several texts
have are encoded once in the whole corpus and brought to those texts (see ``encode``);
what one text alone has is encoded with its neighbours as one run; copies of a text that a
task has side by side are encoded once.  A cut may fall inside
a pre-token, so every join of a run and a chunk, or of two chunks, is repaired: the text
around it is encoded again, from one synchronising token further out than the last one
before the join to one further out than the first one behind it, and wider until the new
ids agree with those of both sides up to these tokens.  A synchronising token begins with
a space and an ASCII letter: the splitting pattern starts a pre-token at every such place,
whatever stands around it.  Without one inside a chunk the window runs on into its
neighbour, at most over the text.

The byte-level vocabulary comes from the file named by ``path`` (tokens, with the special
token's identifier); the file's merges are in the order of the merged tokens' identifiers,
which is checked when it is read, so ranks alone give the same merges.  Added tokens are
matched first, as the library does.  Decoding joins the tokens' bytes; invalid UTF-8 is
replaced, as the library does.

Defined cases: null is the empty text, which has no ids and decodes to the empty text; a
row's doc_id may be null or repeated; an empty table gives an empty table; further columns,
whatever their names, are ignored; a text's length is bounded by memory only (work is
linear in it).
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from popnet.llm.shared import bounded, released, table, tidied, written

VOCABULARY = "byte_bpe_50k.json"
MASK_BITS = 10
SHORTEST, LONGEST = 128, 1 << 14
#: Bits of the broadcast filter of shared chunks at most (beyond: a join), bytes of its blocks, and digests that a task remembers.
FILTER_BITS, BLOCK, REMEMBERED = 1 << 26, 4096, 200_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary: tokens as bytes, added tokens, and an encoder of plain text."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        model = spec["model"]
        tokens = {t: i for t, i in model["vocab"].items() if t not in self.added}
        as_bytes = {t: bytes(letters[c] for c in t) for t in tokens}
        last = -1
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if tokens[a + b] <= last:
                raise ValueError("merges are not in the order of their tokens")
            last = tokens[a + b]
        ranks = {as_bytes[t]: i for t, i in tokens.items()}
        self.plain = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max([*tokens.values(), *self.added.values()]) + 1)
        for t, i in tokens.items():
            self.bytes[i] = as_bytes[t]
        for t, i in self.added.items():
            self.bytes[i] = t.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.sync = np.array([len(b) > 1 and b[:1] == b" " and b[1:2].isalpha() for b in self.bytes])
        self.special = np.zeros(len(self.bytes), bool)
        self.special[list(self.added.values())] = True
        self.sync &= ~self.special

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of a text without added tokens."""
        return np.array(self.plain.encode_ordinary(text.decode("utf-8")), np.uint32)

    def join(self, ids: np.ndarray) -> bytes:
        """The bytes of ids."""
        if self.special[ids].any():
            return b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return self.plain.decode_bytes(ids.tolist())

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        return self.join(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    """The vocabulary of a file, read once in a process; ``name`` is a public tokenizer's name or a path."""
    return Vocabulary(name if "/" in name else public_tokenizers.path(name))


def cuts(data: np.ndarray, mask_bits: int = MASK_BITS) -> np.ndarray:
    """Places (offsets in ``data``) at which the hash of the 16 bytes before ends a chunk, moved on to character starts."""
    n = len(data)
    if n < 17:
        return np.empty(0, np.int64)
    words = np.ndarray((n - 7,), np.dtype("<u8"), np.ascontiguousarray(data), strides=(1,))
    with np.errstate(over="ignore"):
        h = words[:-8] * _A + words[8:] * _B
    h ^= h >> np.uint64(29)
    with np.errstate(over="ignore"):
        h *= _A
    at = np.flatnonzero(h >> np.uint64(64 - mask_bits) == 0) + 16
    at = at[at < n]
    for _ in range(3):
        inside = (data[at] & 0xC0) == 0x80
        if not inside.any():
            break
        at = at + inside
        at = at[at < n]
    return at


def spaced(at: list[int], start: int, end: int) -> list[int]:
    """The chunk ends of a text from ``start`` to ``end``: not under SHORTEST apart; LONGEST at most but for a character's rest."""
    out, last = [], start
    for c in at:
        if c - last >= SHORTEST and end - c >= SHORTEST:
            out.append(c)
            last = c
    return [*out, end]


def repaired(text: bytes, parts: list[np.ndarray], vocab: Vocabulary) -> np.ndarray:
    """Ids of a text from the ids of its consecutive parts, each encoded alone: the joins are encoded again until both sides agree."""
    ids = np.concatenate(parts)
    sync = np.flatnonzero(vocab.sync[ids])
    offsets = np.concatenate(([0], np.cumsum(vocab.lengths[ids])))
    joins = np.cumsum([len(p) for p in parts[:-1]]).tolist()
    place = lambda k: 0 if k < 0 else int(sync[k]) if k < len(sync) else len(ids)
    out, done, i = [], 0, 0
    while i < len(joins):
        right = int(np.searchsorted(sync, joins[i]))  # the first synchronising token at or behind the join
        left = right - 1
        while True:
            a, b, to = max(place(left), done), place(right), place(right + 1)
            start = max(place(left - 1), done)
            if i + 1 < len(joins) and joins[i + 1] < to:  # the next join lies in the window: one window for both
                i += 1
                right = int(np.searchsorted(sync, joins[i]))
                continue
            fresh = vocab.encode(text[int(offsets[start]) : int(offsets[to])])
            before = np.array_equal(fresh[: a - start], ids[start:a])
            behind = np.array_equal(fresh[len(fresh) - (to - b) :], ids[b:to])
            if before and behind:
                break
            left, right = left - (not before), right + (not behind)
        out += [ids[done:start], fresh]
        done = to
        i += 1
    return np.concatenate([*out, ids[done:]])


def cut_slice(texts: list[bytes], vocab: Vocabulary, mask_bits: int | None = MASK_BITS) -> tuple[list[bytes], list[list[int]], list[list]]:
    """(segments, their chunks' ends, and for each text its parts: (segment's number,) or an added token's id); all texts are cut at once, or not at all."""
    added = [(t.encode(), i) for t, i in vocab.added.items()]
    plain: list[bytes] = []
    shape: list[list] = []
    for t in texts:
        segments: list = [t]
        for mark, i in added:
            if mark in t:
                segments = [y for s in segments for y in ([s] if not isinstance(s, bytes) else _split(s, mark, i))]
        shape.append(row := [])
        for s in segments:
            row.append(s if not isinstance(s, bytes) else (len(plain),))
            if isinstance(s, bytes):
                plain.append(s)
    if mask_bits is None:
        return plain, [], shape
    joined = b"".join(plain)
    found = cuts(np.frombuffer(joined, np.uint8), mask_bits)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in plain]))).astype(np.int64)
    # a hash over two texts' bytes is no cut of the second one
    lo, hi = np.searchsorted(found, starts[:-1] + 16), np.searchsorted(found, starts[1:])
    ends = [_bounded(p, spaced((found[lo[k] : hi[k]] - starts[k]).tolist(), 0, len(p))) for k, p in enumerate(plain)]
    return plain, ends, shape


class Text:
    """A text cut into chunks: its parts (a segment, or an added token's id), and for each chunk its segment, ends and digest."""

    def __init__(self, shape: list, plain: list[bytes], ends: list[list[int]]) -> None:
        self.shape = [x if isinstance(x, int) else plain[x[0]] for x in shape]
        self.spans = [(k, a, b) for k, x in enumerate(shape) if not isinstance(x, int) for a, b in zip([0, *ends[x[0]]], ends[x[0]], strict=False)]
        self.names = [digest(self.shape[k][a:b]) for k, a, b in self.spans]

    def chunk(self, i: int) -> bytes:
        k, a, b = self.spans[i]
        return self.shape[k][a:b]

    def ids(self, vocab: Vocabulary, given: dict[bytes, np.ndarray] | None = None) -> np.ndarray:
        """Ids of the text; chunks in ``given`` (digest to ids, held against the chunk) aren't encoded."""
        known = {}
        if given:
            for i, name in enumerate(self.names):
                found = given.get(name)
                if found is not None and vocab.join(found) == self.chunk(i):
                    known[i] = found
        out, i = [np.empty(0, np.uint32)], 0
        for k, x in enumerate(self.shape):
            if isinstance(x, int):
                out.append(np.array([x], np.uint32))
                continue
            parts, a, b = [], 0, 0  # the run of chunks from a to b has no ids yet
            while i < len(self.spans) and self.spans[i][0] == k:
                if i in known:
                    if b > a:
                        parts.append(vocab.encode(x[a:b]))
                    parts.append(known[i])
                    a = self.spans[i][2]
                b = self.spans[i][2]
                i += 1
            if b > a:
                parts.append(vocab.encode(x[a:b]))
            if parts:
                out.append(parts[0] if len(parts) == 1 else repaired(x, parts, vocab))
        return np.concatenate(out)


def cut_texts(texts: list[bytes], vocab: Vocabulary, mask_bits: int = MASK_BITS) -> list[Text]:
    """The texts, all cut at once."""
    plain, ends, shape = cut_slice(texts, vocab, mask_bits)
    return [Text(row, plain, ends) for row in shape]


def _split(text: bytes, mark: bytes, number: int) -> list:
    out: list = []
    for k, piece in enumerate(text.split(mark)):
        if k:
            out.append(number)
        if piece:
            out.append(piece)
    return out


def _bounded(text: bytes, ends: list[int]) -> list[int]:
    """Chunks over LONGEST are cut at multiples of it, at character starts."""
    if len(text) <= LONGEST:
        return ends
    out, last = [], 0
    for e in ends:
        while e - last > LONGEST:
            c = last + LONGEST
            while c < e and text[c] & 0xC0 == 0x80:
                c += 1
            if c >= e:
                break
            out.append(c)
            last = c
        out.append(e)
        last = e
    return out


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """The ids and texts of a batch (id, text), a bounded number of bytes at a time; null texts are empty."""
    for part in bounded(iter([batch]), 1):
        yield part.column(0), [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]


def digest(chunk: bytes) -> bytes:
    """A chunk's name: 16 bytes."""
    return xxhash.xxh3_128_digest(chunk)


class Filter:
    """A Bloom filter of digests with a size that follows their number."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.n = bits, len(bits) * 8

    @staticmethod
    def places(digests: np.ndarray, n: int) -> np.ndarray:
        """The bits of digests (rows of two 64-bit words)."""
        with np.errstate(over="ignore"):
            return np.stack([(digests[:, 0] + np.uint64(i) * (digests[:, 1] | np.uint64(1))) % np.uint64(n) for i in range(4)])

    def hits(self, digests: list[bytes]) -> np.ndarray:
        """Whether each digest may be in the filter."""
        if not digests:
            return np.empty(0, bool)
        at = self.places(np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2), self.n)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _digests(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """(key, h): the digests of each text's chunks, once a text; copies in one task are one text, as far as it remembers, and are encoded side by side."""
    vocab, seen = vocabulary(name), set()
    for batch in batches:
        for keys, texts in slices(batch):
            names = keys.to_pylist()
            fresh = [i for i in {k: i for i, k in reversed(list(enumerate(names)))}.values() if names[i] not in seen]
            seen.update(names)
            if len(seen) > REMEMBERED:
                seen = set()
            found = [list(dict.fromkeys(t.names)) for t in cut_texts([texts[i] for i in fresh], vocab)]
            at = np.repeat(np.array(fresh, np.int64), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array([h for f in found for h in f], pa.binary())], names=["key", "h"])


def _filter_parts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(block, bits): the blocks of a filter that this task's digests touch."""
    bits = np.zeros(n // 8, np.uint8)
    for batch in batches:
        words = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8").reshape(-1, 2)
        at = Filter.places(words, n).ravel()
        np.bitwise_or.at(bits, at >> np.uint64(3), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
    blocks = bits.reshape(-1, BLOCK)
    some = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([blocks[i].tobytes() for i in some], pa.binary())], names=["block", "bits"])


def _either(table_: pa.Table) -> pa.Table:
    rows = [np.frombuffer(b, np.uint8) for b in table_.column("bits").to_pylist()]
    return pa.table({"block": table_.column("block").slice(0, 1), "bits": pa.array([np.bitwise_or.reduce(rows).tobytes()], pa.binary())})


def _filter(several: DataFrame, bits: int) -> Filter:
    """The filter of the digests ``h``; what reaches the driver is the filter."""
    parts = several.mapInArrow(lambda it: _filter_parts(it, bits), "block long, bits binary")
    out = np.zeros((bits // 8 // BLOCK, BLOCK), np.uint8)
    for r in parts.groupBy("block").applyInArrow(_either, "block long, bits binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return Filter(out.ravel())


def marked(rows: DataFrame, name: str) -> tuple[DataFrame, Filter | None] | None:
    """(rows, filter): ``rows`` (doc_id, text, key) with what tells their shared chunks; None if no two texts share one.

    Digests that two or more texts have are counted.  Their filter is made if it fits
    FILTER_BITS; if it doesn't, each text's own digests are joined with them, and come with
    the row in a column ``shared``: then nothing of the corpus's size is broadcast.
    """
    digests = rows.select("key", "text").mapInArrow(lambda it: tidied(_digests(it, name)), "key long, h binary")
    several = written(digests.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared-chunks")
    n = several.count()
    if not n:
        return None
    bits = max(BLOCK * 8, 1 << (16 * n - 1).bit_length())
    if bits <= FILTER_BITS:
        found = _filter(several, bits)
        released(several)
        return rows, found
    lists = digests.distinct().join(several, "h").groupBy("key").agg(F.collect_list("h").alias("shared"))
    lists = written(lists, "shared-lists")  # the join below is then a join alone, whose large partitions are split
    return written(rows.join(lists, "key", "left").select("doc_id", "text", "key", "shared"), "marked"), None


def _marks(batch: pa.RecordBatch, vocab: Vocabulary, some: Filter | None) -> list[tuple[Text, list[int]]]:
    """Each text of a batch (doc_id, text, key[, shared]) with the numbers of its shared chunks."""
    texts = cut_texts([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], vocab)
    if some is not None:
        return [(t, np.flatnonzero(some.hits(t.names)).tolist()) for t in texts]
    known = [set(x or ()) for x in batch.column(3).to_pylist()]
    return [(t, [i for i, h in enumerate(t.names) if h in k]) for t, k in zip(texts, known, strict=True)]


def _open(batches: Iterator[pa.RecordBatch], name: str, some: Filter | None) -> Iterator[pa.RecordBatch]:
    """The texts with a shared chunk as (doc_id, text, key), and each such chunk as (key, h, chunk); a task gives a chunk's bytes once, as far as it remembers."""
    vocab, told = vocabulary(name), set()
    for batch in bounded(batches, 1):
        keys = batch.column(2).to_pylist()
        refs: list[tuple] = []
        opened = []
        for at, (text, shared) in enumerate(_marks(batch, vocab, some)):
            if shared:
                opened.append(at)
            for i in shared:
                h = text.names[i]
                refs.append((keys[at], h, None if h in told else text.chunk(i)))
                told.add(h)
        if len(told) > REMEMBERED:
            told = set()
        whole = batch.select([0, 1, 2]).take(pa.array(opened, pa.int64()))
        blank = lambda n, kind: pa.nulls(n, kind)
        yield pa.RecordBatch.from_arrays([*whole.columns, blank(len(opened), pa.binary()), blank(len(opened), pa.binary())], names=OPEN)
        kinds = (pa.int64(), pa.binary(), pa.binary())
        cols = [pa.array(c, k) for c, k in zip(zip(*refs, strict=True) if refs else ((), (), ()), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([blank(len(refs), pa.int64()), blank(len(refs), whole.column(1).type), *cols], names=OPEN)


OPEN = ["doc_id", "text", "key", "h", "chunk"]


def _encode_chunks(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """(h, ids): each shared chunk, encoded once."""
    vocab = vocabulary(name)
    for batch in bounded(batches, 1):
        ids = [vocab.encode(c).astype("<u4").tobytes() for c in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["h", "ids"])


def _results(ids: pa.Array, found: list[np.ndarray], places: list[int], vocab: Vocabulary, decode: bool) -> pa.RecordBatch:
    """The results of rows whose texts' ids are those at ``places`` of ``found``."""
    at = pa.array(places, pa.int64())
    out = [ids, pa.array([len(f) for f in found], pa.int64()).take(at), pa.array([f.astype("<u4").tobytes() for f in found], pa.binary()).take(at)]
    if decode:
        out.append(pa.array([vocab.decode(f) for f in found], pa.string()).take(at))
    return pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids", "decoded"][: len(out)])


def _whole(texts: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of texts, each segment encoded as one run."""
    plain, _, shape = cut_slice(texts, vocab, None)
    none = np.empty(0, np.uint32)
    return [np.concatenate([none, *[np.array([x], np.uint32) if isinstance(x, int) else vocab.encode(plain[x[0]]) for x in row]]) for row in shape]


def _alone(batches: Iterator[pa.RecordBatch], name: str, decode: bool, check: bool, some: Filter | None) -> Iterator[pa.RecordBatch]:
    """The results of the rows (doc_id, text, key[, shared]) without a shared chunk; without ``check`` of all rows."""
    vocab = vocabulary(name)
    for batch in bounded(batches, 1):
        if check:
            batch = batch.filter(pa.array([not shared for _, shared in _marks(batch, vocab, some)], pa.bool_()))
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        once = list(dict.fromkeys(texts))
        place = {t: i for i, t in enumerate(once)}
        yield _results(batch.column(0), _whole(once, vocab), [place[t] for t in texts], vocab, decode)


def _together(batches: Iterator[pa.RecordBatch], name: str, decode: bool) -> Iterator[pa.RecordBatch]:
    """The results of rows (doc_id, text, given: ids of shared chunks)."""
    vocab = vocabulary(name)
    for batch in bounded(batches, 1):
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        first = {t: i for i, t in reversed(list(enumerate(texts)))}
        found = []
        for text, i in zip(cut_texts(list(first), vocab), first.values(), strict=True):
            given = {g["h"]: np.frombuffer(g["ids"], "<u4").astype(np.uint32) for g in batch.column(2)[i].as_py() or ()}
            found.append(text.ids(vocab, given))
        place = {t: k for k, t in enumerate(first)}
        yield _results(batch.column(0), found, [place[t] for t in texts], vocab, decode)


def encode(docs: DataFrame, vocab: str = VOCABULARY, decode: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): a row per row of ``docs`` (doc_id, text).

    ``ids`` is binary, little-endian unsigned 32-bit integers; ``decoded`` is their text.

    Three passes over the texts: one counts the digests of their chunks, one writes the
    texts that have a shared chunk and those chunks, one encodes the other texts in place.
    Only the former texts are shuffled, to the ids of their shared chunks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # texts go by a hash: equal ones share their list, and a collision only makes a list longer, as digests name its entries
    rows = rows.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    schema = "doc_id long, n_tokens long, ids binary" + (", decoded string" if decode else "")
    found = marked(rows, vocab)
    if found is None:
        return rows.mapInArrow(lambda it: tidied(_alone(it, vocab, decode, False, None)), schema)
    rows, some = found
    held = docs.sparkSession.sparkContext.broadcast(some)
    alone = rows.mapInArrow(lambda it: tidied(_alone(it, vocab, decode, True, held.value)), schema)
    opened = written(rows.mapInArrow(lambda it: tidied(_open(it, vocab, held.value)), "doc_id long, text string, key long, h binary, chunk binary"), "open")
    refs = opened.where("h is not null").select("key", "h")
    chunks = opened.where("chunk is not null").groupBy("h").agg(F.any_value("chunk").alias("chunk"))
    encoded = written(chunks.mapInArrow(lambda it: tidied(_encode_chunks(it, vocab)), "h binary, ids binary"), "encoded-chunks")
    lists = refs.distinct().join(encoded, "h").groupBy("key").agg(F.collect_list(F.struct("h", "ids")).alias("given"))
    lists = written(lists, "lists")  # the join below is then a join alone, whose large partitions (many copies of a text) are split
    released(encoded)
    joined = opened.where("h is null").select("doc_id", "text", "key").join(lists, "key", "left").select("doc_id", "text", "given")
    return alone.unionByName(joined.mapInArrow(lambda it: tidied(_together(it, vocab, decode)), schema))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of both."""
    found = encode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
