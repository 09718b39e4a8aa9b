"""The near-copy stage's SimHash round against all pairs of fingerprints."""

import numpy as np
from pyspark.sql import functions as F

from popnet.llm import nearcopies, simhash
from tests.llm.test_nearcopies import COLUMNS, edited, plain_kept


def plain_fingerprint(hashes):
    counts = [sum(h >> bit & 1 for h in hashes) for bit in range(64)]
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(hashes))


def lightly_edited(n, copies, words=1500, seed=21):
    rng = np.random.default_rng(seed)
    bases = [[f"t{k}w{i}" for i in range(words)] for k in range(n)]
    return [edited(base, e, rng) for base in bases for e in range(copies)]


def test_fingerprint_of_a_set(monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 7)
    for text in ("", "one", "one two three", "a b c d e f g h i j k l m n o p q r s t"):
        found = nearcopies.shingles(text.encode())
        assert nearcopies.fingerprint(found) == plain_fingerprint(found.tolist())


def test_pigeonhole_blocks_lose_no_pair_of_fingerprints(spark):
    """Components of the pairs equal those of all pairs within the distance; equal fingerprints of different sets are pairs too."""
    rng = np.random.default_rng(22)
    prints = rng.integers(0, 1 << 64, 40, np.uint64)
    near = [int(prints[i % 10]) ^ sum(1 << int(b) for b in rng.choice(64, i % 4, replace=False)) for i in range(60)]
    values = [nearcopies._signed(int(x)) for x in [*prints.tolist(), *near]]
    rows = list(enumerate(values))
    close, roots = nearcopies.simhash_pairs(spark.createDataFrame(rows, "fp long, simhash long"))
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count() <= simhash.DISTANCE and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    got = {r["fp"]: r["root"] for r in roots.collect()}
    assert dict(enumerate(range(len(values)))) | got == dict(enumerate(label)) and len(set(label)) < 60
    pairs = [tuple(r) for r in close.collect()]
    assert len(pairs) < len(values) * 2 and all(a < b and label[a] == label[b] for a, b in pairs)


def test_round_of_minimum_hashes_tries_only_pairs_of_other_components(spark):
    texts = lightly_edited(6, 12)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS).repartition(3)
    classes = nearcopies.signatures(docs)
    close, roots = nearcopies.simhash_pairs(classes)
    root = {r["fp"]: r["fp"] for r in classes.collect()} | {r["fp"]: r["root"] for r in roots.collect()}
    assert close.count() and len(set(root.values())) < len(texts)
    tried, members = nearcopies.first_pairs(classes, roots)
    alone, same = nearcopies.first_pairs(classes)
    pairs = tried.collect()
    assert all(root[r["a"]] != root[r["b"]] for r in pairs) and len(pairs) < alone.count()
    assert sorted(map(tuple, members.collect())) == sorted(map(tuple, same.collect()))


def test_stage_keeps_what_fingerprints_join_and_shingles_do_not(spark, monkeypatch):
    """Pairs within the distance are verified on the sets, and links that they hide are found all the same."""
    rng = np.random.default_rng(23)
    rows = [(i + 1, t) for i, t in enumerate(lightly_edited(3, 5))]
    base = [f"v{i}" for i in range(200)]
    rows += [(100 + i, edited(base, n, rng)) for i, n in enumerate((0, 2, 4, 12, 30))]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], COLUMNS).repartition(3)
    want = plain_kept(rows)
    assert sorted(r["doc_id"] for r in nearcopies.representatives(docs).collect()) == want
    monkeypatch.setattr(nearcopies, "simhash_pairs", lambda c: (c.groupBy().agg(F.min("fp").alias("a"), F.max("fp").alias("b")), c.select("fp", F.lit(0).cast("long").alias("root"))))
    assert sorted(r["doc_id"] for r in nearcopies.representatives(docs).collect()) == want
