"""The Merkle manifest against a plain tree."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from popnet.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# other columns have the names that the operator uses itself
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, pos long, n int, key string, row long, tag string, digest string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    values = dict(zip(("doc_id", "text", "lang", "source", "n_chars"), row, strict=True))
    if values["n_chars"] is not None:
        values["n_chars"] += add
    return h(*["-" if values[c] is None else f"{len(str(values[c]).encode())}:{values[c]}" for c in COLUMNS])


def tree(leaves, fanout):
    """The root, and each leaf's path: (left, right) lists of digests a level."""
    paths, own, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for i, at in enumerate(own):
            run = runs[at // fanout]
            paths[i].append((run[: at % fanout], run[at % fanout + 1 :]))
            own[i] = at // fanout
        nodes = [h(*r) for r in runs]
    return nodes[0] if nodes else None, paths


def brute(rows, fanout):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    kept = {g: sorted(by_lang[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in order}
    trees = {g: tree([leaf(r) for r in kept[g]], fanout) for g in order}
    root, tops = tree([trees[g][0] for g in order], fanout)
    out = []
    for g, top in zip(order, tops, strict=True):
        for r, path in zip(kept[g], trees[g][1], strict=True):
            claimed = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            now = claimed
            for left, right in path + top:
                now = h(*left, now, *right)
            siblings = "".join(x for left, right in path + top for x in (*left, *right))
            out.append((str(r[0]) if r[0] is not None else None, leaf(r), trees[g][0], root, siblings, now))
    return sorted(out, key=repr)


ROWS = [
    *[(i, f"text {i} ø", ("de", "en", "en", "en", None, "f")[i % 6], "a" if i % 5 else None, i) for i in range(150)],
    (7, "text 7 ø", "en", "a", 7), (7, "other", "en", "a", 7), (7, "other", "en", "a", 7), (None, "no id", "en", "b", None), (None, "no id", "en", "b", None),
    (1000, None, "only", None, None), (1001, "", "", "", 0), (1002, "long " * 200_000, "en", "x", 1_000_000), (1003, "top", "de", "x", 2**63 - 1), (14, None, "en", None, None),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "g", 1, 2, "k", 3, "t", "d") for r in rows], SCHEMA)


def found(docs, fanout, block):
    c = [F.col(x) for x in COLUMNS]
    changed = merkle.leaf(*c[:3], F.col("n_chars").cast("decimal(20,0)") + 1, c[4])
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, changed)
    return merkle.manifest(docs, F.col("lang"), F.col("doc_id"), merkle.leaf(*c), F.col("doc_id"), claimed, fanout, block)


@pytest.mark.parametrize(("fanout", "block"), [(2, 4), (2, 4096), (3, 9)])
def test_plain_tree(spark, fanout, block):
    rows = found(table(spark, ROWS), fanout, block).collect()
    assert sorted([(r["tag"], r["leaf"], r["subroot"], r["root"], r["siblings"], r["folded"]) for r in rows], key=repr) == brute(ROWS, fanout)
    for r in rows:  # the proof leads from the leaf to the root
        now = r["leaf"].encode()
        for left, right in merkle.steps(r["siblings"], r["shape"]):
            now = sha256(left + now + right).hexdigest().encode()
        assert now.decode() == r["root"]


def test_few_rows(spark):
    assert found(table(spark, []), 2, 4096).collect() == []
    (one,) = found(table(spark, ROWS[:1]), 2, 4096).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == leaf(ROWS[0]) and one["siblings"] == "" and one["shape"] == b""


def test_query(spark):
    rows = merkle.op12_merkle(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and len({r["root"] for r in rows}) == 1
    tampered = {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0}
    assert tampered and {r["doc_id"] for r in rows if not r["verified"]} == tampered


def test_fanout_is_checked():
    with pytest.raises(ValueError, match="fanout"):
        merkle.Shape.of(1)
