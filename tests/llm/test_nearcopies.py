"""Near copies by shingles against all pairs."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from popnet.llm import nearcopies

DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_shingles(text):
    words = [w for w in (text or "").encode().lower().split()]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """The least doc_id of each component of pairs at 0.8 or more."""
    sets = [plain_shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if label[i] != label[j] and (not union or len(sets[i] & sets[j]) >= 0.8 * union):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return sorted(min(rows[i][0] for i in range(len(rows)) if label[i] == k) for k in set(label))


def edited(words, n, rng):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"x{rng.integers(10**9)}"
    return " ".join(out)


def test_stage_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for length in (100, 300, 800, 2000):
        base = list(rng.choice(vocabulary, length))
        for share in (0, 0.003, 0.01, 0.02, 0.03, 0.2):
            rows.append((len(rows) + 1, edited(base, int(length * share), rng)))
    rows += [(100, "one two three"), (101, "ONE  two\nthree"), (102, "one two"), (103, ""), (104, " \t")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], COLUMNS).repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, DIR)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == plain_kept(rows)


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect())
    assert got == plain_kept([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_second_round_joins_what_the_tree_misses(spark):
    """A chain whose ends are no near copies, in a bucket whose tree tries other pairs."""
    rng = np.random.default_rng(6)
    names = np.unique(rng.integers(0, 1 << 64, 500, np.uint64))
    a, b = nearcopies.tree(names)
    assert len(a) == len(names) - 1 and max(np.unique(b, return_counts=True)[1]) < 100 and (b < a).all()
    base = [f"v{i}" for i in range(400)]
    rows = [(1 + i, " ".join(base[i * 20 : i * 20 + 300])) for i in range(6)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], COLUMNS)
    assert [r["doc_id"] for r in nearcopies.representatives(docs).collect()] == plain_kept(rows) == [1]


def test_copies_of_one_text_meet_it_and_not_each_other(spark):
    """A star: each copy is near the middle, and few copies are near each other; the first round finds the middle."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(300)]
    rows = [(1, " ".join(base))]
    for i in range(60):
        words = list(base)
        for at in rng.choice(300, 5, replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((2 + i, " ".join(words)))
    least = [nearcopies.minima(nearcopies.shingles(t.encode())) for _, t in rows]
    sketches = np.stack([(x >> np.uint64(20)).astype(np.uint8) for x in least])
    a, b = nearcopies.nearest(sketches, np.arange(61), np.arange(61))
    assert sum(j == 0 for i, j in zip(a, b, strict=True) if i) == 60 and len(a) <= 61 * nearcopies.NEAREST
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], COLUMNS).repartition(3)
    assert [r["doc_id"] for r in nearcopies.representatives(docs).collect()] == plain_kept(rows) == [1]


def test_parts_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "PART", 4)
    rng = np.random.default_rng(9)
    base = [[f"g{g}w{i}" for i in range(200)] for g in range(4)]
    rows = [(i + 1, edited(base[i % 4], int(rng.integers(0, 5)), rng)) for i in range(80)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], COLUMNS).repartition(3)
    assert sorted(r["doc_id"] for r in nearcopies.representatives(docs).collect()) == plain_kept(rows)


def sets_of(spark, texts, roots):
    rows = [(i, roots[i], len(x), bytearray(x.tobytes())) for i, x in enumerate(nearcopies.shingles(t.encode()) for t in texts)]
    return spark.createDataFrame(rows, "fp long, root long, size long, shingles binary")


def test_rare_pairs_lose_no_link_of_different_roots(spark):
    """Sets around the bound, of all sizes, many of equal similarity to each other, against all pairs."""
    rng = np.random.default_rng(12)
    texts = ["", "one two", "one two three", "a b c d e f g"]
    for length in (6, 14, 40, 150, 400):
        base = [f"l{length}w{i}" for i in range(length)]
        for share in (0, 0.01, 0.02, 0.025, 0.03, 0.04, 0.05, 0.06):
            texts += [edited(base, int(length * share), rng), " ".join(base[: int(length * (1 - 4 * share))])]
    texts = [t for i, t in enumerate(texts) if t not in texts[:i]]
    plain = [plain_shingles(t) for t in texts]
    for roots in (list(range(len(texts))), [i % 3 for i in range(len(texts))], [0] * len(texts)):
        want = {(i, j) for j in range(len(texts)) for i in range(j) if roots[i] != roots[j] and len(plain[i] & plain[j]) * 5 >= 4 * len(plain[i] | plain[j]) > 0}
        sets = sets_of(spark, texts, roots)
        pairs = nearcopies.rare_pairs(sets)
        tried = [tuple(r) for r in pairs.collect()]
        assert len(set(tried)) == len(tried) and want <= set(tried) and bool(want) == (len(set(roots)) > 1)
        assert {tuple(r) for r in nearcopies._verify(pairs, sets.select("fp", "shingles")).collect()} == want


def test_pages_of_one_template_cost_no_square(spark, monkeypatch):
    """300 shared words of 360 (similarity 0.71): pairs and copied sets grow with the pages, and no page goes."""
    monkeypatch.setattr(nearcopies, "PART", 64)  # so that all buckets here are large ones
    shared = [f"t{i}" for i in range(300)]
    tried, met = {}, {}
    for n in (500, 1000, 2000):
        texts = [" ".join(shared[:150] + [f"p{k}w{i}" for i in range(60)] + shared[150:]) for k in range(n)]
        docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], COLUMNS).repartition(4)
        hashed = nearcopies.signatures(docs)
        pairs, members = nearcopies.first_pairs(hashed.select("fp", "keys", "sketch"))
        tried[n], met[n] = pairs.count(), members.count()
        assert members.groupBy("key").count().agg(F.max("count")).first()[0] > n / 4
        assert tried[n] <= (1 + nearcopies.NEAREST) * met[n] and met[n] <= nearcopies.BANDS * n
        assert nearcopies.rare_pairs(sets_of(spark, texts, list(range(n)))).count() == 0
    # a square grows four times; pairs that several buckets try are fewer in small tables, so growth nears two from above
    assert met[2000] < 2.2 * met[1000] < 2.2 * 2.2 * met[500] and tried[2000] < 2.6 * tried[1000] < 2.6 * 2.6 * tried[500], (tried, met)
    assert nearcopies.representatives(docs.limit(700)).count() == 700


def test_the_bitmap_loses_no_name_and_lets_few_others_through(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    rows = nearcopies._keyed(docs)
    names = rows.where("doc_id % 7 = 0").select(*nearcopies.KEY)
    got = nearcopies._maybe(rows, names).groupBy((F.col("doc_id") % 7 == 0).alias("named"), "__dup_maybe").count().collect()
    found = {(r["named"], r["__dup_maybe"]): r["count"] for r in got}
    assert (True, False) not in found and found[True, True] == 2858 and found.get((False, True), 0) < 200
    assert nearcopies._maybe(rows, names.where(F.lit(False))).where("__dup_maybe").count() == 0


def test_null_ids_and_copies(spark):
    long = "alpha beta gamma delta " * 5000
    rows = [(5, long), (3, long), (3, long), (7, "other text here now"), (None, "null id one two"), (None, "null id one two"), (8, None), (9, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], COLUMNS)
    assert sorted(str(r["doc_id"]) for r in nearcopies.representatives(docs).collect()) == ["3", "7", "8", "None"]
    assert nearcopies.representatives(docs.where(F.lit(False))).count() == 0
