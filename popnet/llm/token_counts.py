"""Edit-aware token counts on kept segment trees of pre-token runs (operator 4).

A document is cut into segments at places that start a pre-token whatever stands around
them (a space and an ASCII letter), about ``SEGMENT`` bytes apart; the tree's leaves are
the segments' token counts and a node is the sum of its children.  ``token_trees`` builds
the trees; they are kept as a table whose ``tree`` column has each segment's code points
and tokens, beside the text that it stands for.  ``edit_trees`` takes such a table and
edits, and gives the table for the edited texts, which the next edits are applied to.

An edit replaces a range of code points.  Only the segments that the range touches, with
one segment of context on either side, are encoded again (the context decides where the
new boundaries are).  If that leaves the number of segments as it was, the sums of the
paths above them are updated; if not, the sums are added up again from the leaves' counts,
which encodes nothing.  Edits of a document apply in the order of ``seq``, each to the
text that the one before left.

Defined cases: a null text is empty and has 0 tokens; a range is cut to the text (start
over the end: an insertion at the end; end under start: at start); null bounds are the
text's ends; a null replacement is empty; a document without edits keeps its tree and is
not encoded; edits of unknown documents are ignored; repeated document rows are each edited
by all edits of their doc_id, as are rows with a null doc_id by none; ties in seq go by
start, end and replacement; long texts are counted whole, with work linear in their length
to build and in the edits to update; further columns, whatever their names, are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from popnet.llm.bpe import VOCABULARY, Vocabulary, vocabulary
from popnet.llm.shared import SLICE, bounded, table, tidied

#: Code points in a segment, about: the next boundary behind so many ends it.
SEGMENT = 512
#: Children of a node.
FAN = 16
_START = regex.compile(r" (?=[A-Za-z])")
EDITS = "array<struct<seq:bigint,start:bigint,end:bigint,replacement:string>>"


def count_tokens(text: str, vocab: Vocabulary) -> int:
    """Tokens of a text, added tokens included."""
    n, parts = 0, [text]
    for mark in vocab.added:
        if mark in text:
            parts = [y for x in parts for y in x.split(mark)]
            n += len(parts) - 1
    return n + sum(len(vocab.plain.encode_ordinary(x)) for x in parts if x)


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """``text`` cut at boundaries that hold whatever stands around them."""
    out, at, n = [], 0, len(text)
    while at < n:
        if n - at <= size:
            out.append(text[at:])
            break
        found = _START.search(text, at + size)
        to = found.start() if found else n
        out.append(text[at:to])
        at = to
    return out


class Tree:
    """Segments of a text with their token counts, summed level by level; ``leaves`` are kept (code points, tokens) of the segments."""

    def __init__(self, text: str, vocab: Vocabulary, size: int = SEGMENT, leaves: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.vocab, self.size = vocab, size
        self.encoded = 0
        if leaves is None:
            self.parts = segments(text, size)
            leaves = np.array([len(p) for p in self.parts], np.int64), self._counts(self.parts)
        else:
            ends = np.cumsum(leaves[0]).tolist()
            self.parts = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self.chars, self.sums = self._tree(leaves[0]), self._tree(leaves[1])

    def _counts(self, parts: list[str]) -> np.ndarray:
        self.encoded += sum(map(len, parts))
        return np.array([count_tokens(p, self.vocab) for p in parts], np.int64)

    @staticmethod
    def _tree(leaves: np.ndarray) -> list[np.ndarray]:
        out = [leaves]
        while len(out[-1]) > 1:
            out.append(np.add.reduceat(out[-1], np.arange(0, len(out[-1]), FAN)))
        return out

    @property
    def tokens(self) -> int:
        return int(self.sums[-1].sum())

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def _find(self, place: int) -> tuple[int, int]:
        """The segment that holds the code point ``place`` (the last one at the end) and the place in it, going down the tree."""
        i = 0
        for level in range(len(self.chars) - 1, -1, -1):
            row = self.chars[level]
            to = min((i + 1) * FAN, len(row)) if level < len(self.chars) - 1 else len(row)
            i = i * FAN if level < len(self.chars) - 1 else 0
            while i + 1 < to and place >= row[i]:
                place -= int(row[i])
                i += 1
        return i, place

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the code points from ``start`` to ``end`` (exclusive)."""
        n = int(self.chars[-1].sum())
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        if not self.parts:
            self._replace(0, 0, segments(replacement, self.size))
            return
        a, x = self._find(start)
        b, y = self._find(end)
        lo, hi = max(a - 1, 0), min(b + 2, len(self.parts))
        fresh = "".join(self.parts[lo:a]) + self.parts[a][:x] + replacement + self.parts[b][y:] + "".join(self.parts[b + 1 : hi])
        # the run's ends stay boundaries: its first segment starts the text or begins as before, and the next one too
        while lo > 0 and not _START.match(fresh):
            lo -= 1
            fresh = self.parts[lo] + fresh
        self._replace(lo, hi, segments(fresh, self.size))

    def _replace(self, lo: int, hi: int, parts: list[str]) -> None:
        same = len(parts) == hi - lo
        self.parts[lo:hi] = parts
        counts, chars = self._counts(parts), np.array([len(p) for p in parts], np.int64)
        for tree, new in ((self.sums, counts), (self.chars, chars)):
            if same:  # only the paths above the run
                tree[0][lo:hi] = new
                a, b = lo, hi
                for below, level in zip(tree, tree[1:], strict=False):
                    a, b = a // FAN, -(-b // FAN)
                    for k in range(a, b):
                        level[k] = below[k * FAN : (k + 1) * FAN].sum()
            else:  # the nodes from the run on move
                tree[:] = self._tree(np.concatenate((tree[0][:lo], new, tree[0][hi:])))


TREE = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))
TREES = "doc_id long, text string, n_tokens long, tree array<struct<chars:int,tokens:int>>, chars_encoded long"


def _kept(trees: list[Tree]) -> pa.ListArray:
    """The leaves of trees as a column."""
    offsets = np.concatenate(([0], np.cumsum([len(t.parts) for t in trees])))
    chars, tokens = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([t.chars[0] for t in trees], [t.sums[0] for t in trees]))
    leaves = pa.StructArray.from_arrays([pa.array(chars, pa.int32()), pa.array(tokens, pa.int32())], names=["chars", "tokens"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), leaves)


def _build(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(name)
    for batch in bounded(batches, 1):
        trees = [Tree(t or "", vocab) for t in batch.column(1).to_pylist()]
        cols = [batch.column(0), batch.column(1), pa.array([t.tokens for t in trees], pa.int64()), _kept(trees), pa.array([t.encoded for t in trees], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "n_tokens", "tree", "chars_encoded"])


def token_trees(docs: DataFrame, vocab: str = VOCABULARY) -> DataFrame:
    """(doc_id, text, n_tokens, tree, chars_encoded) of each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: tidied(_build(it, vocab)), TREES)


def _apply(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, n_tokens, tree, edits) to the edited ones."""
    vocab = vocabulary(name)
    for batch in bounded(batches, 1):
        ids, texts, before, kept, edits = batch.columns
        flat, offsets = kept.flatten(), kept.offsets.to_numpy() - kept.offsets[0].as_py()
        leaves = [flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("chars", "tokens")]
        first, held, trees = 0, 0, []
        for i in range(batch.num_rows):
            tree = Tree(texts[i].as_py() or "", vocab, leaves=tuple(x[offsets[i] : offsets[i + 1]] for x in leaves))
            for e in edits[i].as_py() or ():
                tree.edit(0 if e["start"] is None else e["start"], (1 << 62) if e["end"] is None else e["end"], e["replacement"] or "")
            trees.append(tree)
            held += int(tree.chars[-1].sum())
            if held > SLICE or i + 1 == batch.num_rows:
                n = len(trees)
                numbers = [[t.tokens for t in trees], [t.encoded for t in trees], [len(x or ()) for x in edits.slice(first, n).to_pylist()]]
                cols = [ids.slice(first, n), pa.array([t.text for t in trees], pa.string()), before.slice(first, n), pa.array(numbers[0], pa.int64()), _kept(trees), *[pa.array(x, pa.int64()) for x in numbers[1:]]]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "n_tokens_before", "n_tokens", "tree", "chars_encoded", "n_edits"])
                first, held, trees = i + 1, 0, []


def edit_trees(trees: DataFrame, edits: DataFrame | None = None, vocab: str = VOCABULARY) -> DataFrame:
    """(doc_id, text, n_tokens_before, n_tokens, tree, chars_encoded, n_edits): ``trees`` after the edits, which the next edits may follow.

    ``edits`` has doc_id, seq, start, end, replacement; or ``trees`` has them already, in a
    column ``edits`` (array of struct seq, start, end, replacement).  A document's edits
    are gathered with it, as they apply one after another.
    """
    if edits is not None:
        one = F.struct(F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("replacement").cast("string").alias("replacement"))
        lists = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(one).alias("edits"))
        trees = trees.select("doc_id", "text", "n_tokens", "tree").join(lists, "doc_id", "left")
    rows = trees.select("doc_id", "text", "n_tokens", "tree", F.array_sort(F.col("edits").cast(EDITS)).alias("edits"))
    schema = "doc_id long, text string, n_tokens_before long, n_tokens long, tree array<struct<chars:int,tokens:int>>, chars_encoded long, n_edits long"
    return rows.mapInArrow(lambda it: tidied(_apply(it, vocab)), schema)


def stated_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits of each text: a word put in at a third, ten code points taken out at the middle, and the last one doubled."""
    n = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    def edit(seq, start, end, replacement):
        return F.struct(F.lit(seq).cast("long").alias("seq"), start.cast("long").alias("start"), end.cast("long").alias("end"), replacement.alias("replacement"))
    third, half = F.floor(n / 3), F.floor(n / 2)
    last = F.right(F.coalesce(F.col("text"), F.lit("")), F.lit(1))
    return docs.withColumn("edits", F.array(
        edit(1, third, third, F.concat(F.lit(" edit"), F.col("doc_id").cast("string"))), edit(2, half, half + 10, F.lit("")), edit(3, F.lit(1 << 40), F.lit(1 << 40), last),
    ))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, before and after the stated edits of its kept tree."""
    trees = token_trees(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = edit_trees(stated_edits(trees))
    return found.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), F.col("chars_encoded").alias("chars_reencoded"))
