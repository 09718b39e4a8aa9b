"""Merkle manifest of a dataset (operator 12): contiguous digest matrices in aligned blocks.

A row's leaf is the SHA-256 of its fields, and every node is the SHA-256 of its members'
lowercase hex texts side by side.  The leaves of a group (ascending by the order column) make
a tree of runs of ``fanout`` nodes; the last run of a level may be shorter, even one node,
which is hashed as well.  The groups' roots, in the order of the groups' names (null first,
then bytewise), make one more tree of the same kind, whose root is the manifest's.

Leaves are numbered inside their group by a range partitioning and the counts of its
partitions, so no task orders a whole group.  A block is an aligned run of at most
``BLOCK`` leaves, so it is a whole subtree: its leaves are one matrix of 64-byte hex rows,
each level reshapes it by the fanout and hashes its rows.  The blocks' roots are the leaves of
the next pass, until every group is one block; then the paths come down, and a leaf's
siblings are found by index arithmetic in its block's levels.  What a task holds is a block
and one path.

Defined results: null fields are ``-``; empty and very long texts are hashed whole; rows tied
in the order column go by leaf, and equal rows are rows of their own (each has a leaf and a
proof); a null order value comes first; an empty table gives an empty manifest; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from popnet.llm.shared import released, table, written
from popnet.operators.ordering import numbered

#: Leaves of a block, at most: what one task holds as a matrix.
BLOCK = 4096
HEX = 64
MANIFEST = "grp string, tag string, leaf string, subroot string, root string, siblings string, shape binary, folded string"
_PATHS = "grp string, tag string, pos long, siblings string, shape binary, subroot string, root string"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value; integers are decimal."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields, as hex text."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


@dataclass(frozen=True)
class Shape:
    """The fanout, and how many levels and leaves an aligned block has."""

    fanout: int
    depth: int

    @classmethod
    def of(cls, fanout: int, block: int = BLOCK) -> Shape:
        if not 2 <= fanout <= HEX or fanout > block:
            raise ValueError(f"the fanout must lie between 2 and {min(HEX, block)}")
        depth = 1
        while fanout ** (depth + 1) <= block:
            depth += 1
        return cls(fanout, depth)

    @property
    def leaves(self) -> int:
        return self.fanout**self.depth


def _matrix(digests: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Hex digests (raw bytes in Arrow) as rows of 64 bytes."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), np.uint8)
    return np.frombuffer(raw.tobytes().hex().encode(), np.uint8).reshape(-1, HEX)


def _hashed(data: bytes, starts: Sequence[int], ends: Sequence[int]) -> np.ndarray:
    """A row for the digest of each slice of ``data``."""
    return np.frombuffer("".join([sha256(data[a:b]).hexdigest() for a, b in zip(starts, ends, strict=True)]).encode(), np.uint8).reshape(-1, HEX)


def levels(leaves: np.ndarray, shape: Shape, alone: bool) -> list[np.ndarray]:
    """A block's levels from its leaves up; ``alone`` ends at one node, other blocks have all their levels."""
    out = [leaves]
    while len(out[-1]) > 1 if alone else len(out) <= shape.depth:
        m, wide = len(out[-1]), shape.fanout * HEX
        starts = np.arange(0, m * HEX, wide)
        out.append(_hashed(out[-1].tobytes(), starts.tolist(), np.minimum(starts + wide, m * HEX).tolist()))
    return out


def _climb(key: tuple, rows: pa.Table, shape: Shape) -> pa.Table:
    """A block's root as a node of the next pass."""
    rows = rows.sort_by("pos")
    n = rows.column("n")[0].as_py()
    top = levels(_matrix(rows.column("digest")), shape, n <= shape.leaves)[-1]
    return pa.table({"grp": pa.array([key[0].as_py()], pa.string()), "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // shape.leaves)], pa.int64()), "digest": pa.array([bytes.fromhex(top[0].tobytes().decode())], pa.binary())})


def _siblings(tiers: list[np.ndarray], shape: Shape) -> tuple[pa.Array, list[bytes]]:
    """Each leaf's siblings in its block (hex texts, level by level, left to right), and how many stand left and right of its own node on each level."""
    n, f, own = len(tiers[0]), shape.fanout, np.arange(len(tiers[0]))
    wide, there = np.zeros((n, len(tiers) - 1, f - 1, HEX), np.uint8), np.zeros((n, len(tiers) - 1, f - 1), bool)
    counts = np.zeros((n, len(tiers) - 1, 2), np.uint8)
    for at, nodes in enumerate(tiers[:-1]):
        first = own // f * f
        left, right = own - first, np.minimum(first + f, len(nodes)) - own - 1
        slot = np.arange(f - 1)[None, :]
        index = first[:, None] + slot + (slot >= left[:, None])  # the own node is stepped over
        there[:, at] = slot < (left + right)[:, None]
        wide[:, at] = nodes[np.minimum(index, len(nodes) - 1)]
        counts[:, at, 0], counts[:, at, 1] = left, right
        own = own // f
    ends = np.concatenate(([0], there.sum(axis=(1, 2)).cumsum() * HEX))
    texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(wide[there].tobytes()))
    return texts, [c.tobytes() for c in counts]


def _folded(claimed: np.ndarray, tiers: list[np.ndarray], shape: Shape, above: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The roots that the leaves ``claimed`` lead to with the siblings of ``tiers`` and, above the block, of one path."""
    f, own, now = shape.fanout, np.arange(len(claimed)), claimed
    for nodes in tiers[:-1]:
        first = own // f * f
        runs = nodes[np.minimum(first[:, None] + np.arange(f), len(nodes) - 1)]
        runs[np.arange(len(own)), own - first] = now
        starts = np.arange(len(own)) * f * HEX
        now = _hashed(runs.tobytes(), starts.tolist(), (starts + np.minimum(f, len(nodes) - first) * HEX).tolist())
        own = own // f
    data = now.tobytes()
    mine = [data[i : i + HEX] for i in range(0, len(data), HEX)]
    for left, right in above:
        mine = [sha256(left + x + right).hexdigest().encode() for x in mine]
    return np.frombuffer(b"".join(mine), np.uint8).reshape(-1, HEX)


def steps(siblings: str, shape: bytes) -> list[tuple[bytes, bytes]]:
    """A path as the hex texts left and right of the own node, level by level."""
    out, at, text = [], 0, siblings.encode()
    for left, right in zip(shape[::2], shape[1::2], strict=True):
        middle, end = at + left * HEX, at + (left + right) * HEX
        out.append((text[at:middle], text[middle:end]))
        at = end
    return out


def _texts(nodes: np.ndarray) -> pa.Array:
    ends = np.arange(len(nodes) + 1, dtype=np.int64) * HEX
    return pa.LargeStringArray.from_buffers(len(nodes), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(nodes).tobytes())).cast(pa.string())


def _descend(key: tuple, rows: pa.Table, paths: pa.Table, shape: Shape, kind: str) -> pa.Table:
    """The paths of a block's leaves from the path of its root: of ``nodes`` inside a tree, of the groups' ``subroots``, or, for ``rows``, the manifest."""
    rows = rows.sort_by("pos")
    n, size = rows.num_rows, rows.column("n")[0].as_py()
    above = {c: paths.column(c)[0].as_py() for c in ("siblings", "shape", "subroot", "root")}
    tiers = levels(_matrix(rows.column("digest")), shape, size <= shape.leaves)
    texts, counts = _siblings(tiers, shape)
    joined = pc.binary_join_element_wise(texts, pa.scalar(above["siblings"], pa.large_string()), pa.scalar("", pa.large_string())).cast(pa.string())
    same = lambda v: pa.array([v] * n, pa.string())
    out = {"grp": same(key[0].as_py()), "tag": rows.column("tag").combine_chunks(), "siblings": joined, "shape": pa.array([c + above["shape"] for c in counts], pa.binary())}
    if kind != "rows":
        subroot = _texts(tiers[0]) if kind == "subroots" else same(above["subroot"])
        return pa.table(out | {"pos": rows.column("pos").combine_chunks(), "subroot": subroot, "root": same(above["root"])}).select([c.split()[0] for c in _PATHS.split(", ")])
    own = rows.column("digest")
    claimed = _matrix(pc.coalesce(rows.column("other"), own))
    folded = _folded(claimed, tiers, shape, steps(above["siblings"], above["shape"]))
    return pa.table(out | {"leaf": _texts(tiers[0]), "subroot": same(above["subroot"]), "root": same(above["root"]), "folded": _texts(folded)}).select([c.split()[0] for c in MANIFEST.split(", ")])


def _block(shape: Shape) -> Column:
    return F.floor(F.col("pos") / F.lit(shape.leaves)).cast("long").alias("block")


def _grown(leaves: DataFrame, shape: Shape) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each pass from ``leaves`` (grp, pos, n, digest) up, and the groups' roots."""
    passes, nodes, schema = [leaves], leaves, "grp string, pos long, n long, digest binary"
    while True:
        up = nodes.select("grp", "pos", "n", "digest", _block(shape)).groupBy("grp", "block")
        nodes = written(up.applyInArrow(lambda key, rows: _climb(key, rows, shape), schema), "nodes")
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return passes, nodes
        passes.append(nodes)


def _lowered(nodes: DataFrame, paths: DataFrame, shape: Shape, kind: str = "nodes") -> DataFrame:
    """The paths of ``nodes`` from those of their blocks' roots (grp, pos)."""
    for c, type_ in (("tag", "string"), ("other", "binary")):
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast(type_))
    left = nodes.select("grp", "pos", "n", "digest", "tag", "other", _block(shape)).groupBy("grp", "block")
    right = paths.groupBy("grp", "pos")
    return left.cogroup(right).applyInArrow(lambda key, rows, above: _descend(key, rows, above, shape, kind), MANIFEST if kind == "rows" else _PATHS)


def manifest(rows: DataFrame, group: Column, order: Column, digest: Column, tag: Column, claimed: Column | None = None, fanout: int = 2, block: int = BLOCK) -> DataFrame:
    """A row for each of ``rows``: grp, tag, leaf, subroot, root, siblings, shape, folded.

    ``digest`` is a row's leaf (see ``leaf``) and ``tag`` names it in the result.  ``siblings``
    are the hex texts beside the path, level by level and left to right; ``shape`` has two
    bytes a level, the siblings left and right of the own node, so that ``steps`` gives the
    proof.  ``folded`` is the root that the proof leads to from ``claimed`` (null: the leaf).
    ``grp`` is the group's name behind ``=``, or ``-`` for null.
    """
    shape = Shape.of(fanout, block)
    name = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))
    other = F.lit(None).cast("string") if claimed is None else claimed
    leaves = rows.select(name.alias("grp"), order.alias("key"), F.unhex(digest).alias("digest"), tag.cast("string").alias("tag"), F.unhex(other).alias("other"))
    leaves = written(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")  # equal rows are told apart by it
    placed = written(numbered(leaves, ["key", "digest", "row"], ["grp"], "pos", "n").drop("key", "row"), "placed")
    released(leaves)
    passes, subroots = _grown(placed, shape)
    # the groups' roots are the leaves of one more tree
    tops = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("tag"), "digest")
    tops = written(numbered(tops, ["tag"], ["grp"], "pos", "n"), "groups")
    upper, root = _grown(tops, shape)
    empty = F.lit("").alias("siblings"), F.lit(b"").cast("binary").alias("shape")
    paths = root.select("grp", F.lit(None).cast("string").alias("tag"), "pos", *empty, F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    for nodes in reversed(upper[1:]):
        paths = written(_lowered(nodes, paths, shape), "paths")
    paths = written(_lowered(tops, paths, shape, "subroots"), "paths")
    paths = paths.select(F.col("tag").alias("grp"), "tag", F.lit(0).cast("long").alias("pos"), "siblings", "shape", "subroot", "root")
    for nodes in reversed(passes[1:]):
        paths = written(_lowered(nodes, paths, shape), "paths")
    return _lowered(placed, paths, shape, "rows")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and check, where a seventh of the rows have been tampered with."""
    docs = table(spark, sf_dir, "documents")
    c = {x: F.col(x) for x in ("doc_id", "source", "lang", "n_chars", "text")}
    tampered = leaf(c["doc_id"], c["source"], c["lang"], c["n_chars"].cast("decimal(20,0)") + 1, c["text"])
    hit = F.crc32(c["doc_id"].cast("string")) % 7 == 0
    found = manifest(docs, c["lang"], c["doc_id"], leaf(*c.values()), c["doc_id"], F.when(hit, tampered))
    return found.select(
        F.col("tag").cast("long").alias("doc_id"), "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


#: The same by recursion over levels; CRC-32 bit by bit, as DuckDB has no function for it.
OP12_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail, CAST(doc_id AS VARCHAR) AS s
  FROM documents
), marked AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 7 = 0 AS hit
  FROM rows_
), leaves AS MATERIALIZED (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS claimed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM marked
), lower_tree AS (
  SELECT lang, 0 AS lvl, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM lower_tree WHERE n > 1 GROUP BY lang, lvl, pos // 2
), subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lower_tree WHERE n = 1
), upper_tree AS (
  SELECT 0 AS lvl, pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper_tree WHERE n > 1 GROUP BY lvl, pos // 2
), lower_steps AS (
  SELECT l.doc_id, a.lvl AS step, (l.pos >> a.lvl) & 1 AS behind, b.digest
  FROM leaves l JOIN (SELECT DISTINCT lang, lvl FROM lower_tree WHERE n > 1) a ON a.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN lower_tree b ON b.lang IS NOT DISTINCT FROM l.lang AND b.lvl = a.lvl AND b.pos = xor(l.pos >> a.lvl, 1)
), upper_steps AS (
  SELECT l.doc_id, 1000 + a.lvl AS step, (s.pos >> a.lvl) & 1 AS behind, b.digest
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT DISTINCT lvl FROM upper_tree WHERE n > 1) a ON true
  LEFT JOIN upper_tree b ON b.lvl = a.lvl AND b.pos = xor(s.pos >> a.lvl, 1)
), steps AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS k, behind, digest FROM (SELECT * FROM lower_steps UNION ALL SELECT * FROM upper_steps)
), folds AS (
  SELECT doc_id, 0 AS k, coalesce(claimed, leaf) AS digest FROM leaves
  UNION ALL
  SELECT f.doc_id, f.k + 1, sha256(CASE WHEN s.behind = 1 THEN coalesce(s.digest, '') || f.digest ELSE f.digest || coalesce(s.digest, '') END)
  FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.k = f.k + 1
)
SELECT l.doc_id, l.leaf, s.subroot, (SELECT digest FROM upper_tree WHERE n = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
  f.digest AS folded_root, f.digest = (SELECT digest FROM upper_tree WHERE n = 1) AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
LEFT JOIN (SELECT doc_id, string_agg(digest, '' ORDER BY k) AS proof FROM steps GROUP BY doc_id) p ON p.doc_id = l.doc_id
JOIN (SELECT doc_id, arg_max(digest, k) AS digest FROM folds GROUP BY doc_id) f ON f.doc_id = l.doc_id
"""
