"""SimHash, language identification, personal data, mixing and licences against plain versions."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from popnet.llm import graph, langid, licenses, mixing, pii, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, component_id string, spans int"
LONG = "alpha beta gamma delta " * 5000


def docs(spark, rows):
    """Rows of (doc_id, text[, source]) among columns whose names clash with results."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, 1, "c", 2) for r in rows], DOCS)


# ---- SimHash


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    ids = {k: min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=None) for k in set(label)}
    return sorted((str(r[0]), f"{fps[i]:016x}", str(ids[label[i]])) for i, r in enumerate(rows))


def test_simhash_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words, 150)) for _ in range(6)]
    rows = []
    for i in range(120):
        w = base[i % 6].split()
        for _ in range(i % 4):
            w[rng.integers(len(w))] = str(rng.choice(words))
        rows.append((i + 10, " ".join(w)))
    rows += [(3, None), (4, ""), (5, " \t\x0b\n"), (6, "one"), (7, "One"), (8, "one two"), (9, "É one two three"), (None, "one"), (None, None), (8, "one two"), (1, LONG), (2, LONG)]
    got = simhash.near_duplicates(docs(spark, rows).repartition(4))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got.collect()) == plain_components(rows)


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(docs(spark, [(1, "a")]).where("false")).count() == 0
    assert [r["component_id"] for r in simhash.near_duplicates(docs(spark, [(None, "a b")])).collect()] == [None]


@pytest.mark.parametrize("direct", [4, 1024])
def test_forest_has_the_components_of_all_links(direct, monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = np.random.default_rng(9)
    values = np.unique(rng.integers(0, 1 << 9, 80).astype(np.uint64) << np.uint64(3))
    edges = simhash.forest(values, list(range(3, 12)), 2)
    close = [(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 2]

    def groups(pairs):
        label = list(range(len(values)))
        for _ in values:
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
        return label

    assert groups(edges) == groups(close) and set((max(e), min(e)) for e in edges) <= set(close)


def test_every_close_pair_shares_a_key():
    masks = simhash.block_masks()
    for i in range(64):
        for j in range(i):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_components_of_a_long_path(spark):
    rng = np.random.default_rng(3)
    names = rng.permutation(300)
    pairs = [(int(names[i]), int(names[i + 1])) for i in range(299)] + [(900, 901), (901, 900), (7, 7)]
    got = dict((r["node"], r["component"]) for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect())
    assert {got[int(n)] for n in names} == {0} and got[901] == 900 and len(got) == 302
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_query_equals_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = simhash.op9_simhash(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got.collect()) == plain_components(rows)


# ---- language identification

WORDS = {"aa": "zork blim tarn vosk quil".split(), "bb": "ünde späth größe müde föhn".split(), "cc": "çedil élan façon où naïve".split()}


def say(lang, n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS[lang], n))


def test_languages_and_mixtures(spark):
    train = spark.createDataFrame([(say(k, 40, i), k, "x") for k in WORDS for i in range(20)] + [(None, "aa", "x"), ("zork", None, "x"), ("123", "aa", "x")], "text string, lang string, lang_pred string")
    mixed = say("aa", 300, 1) + " " + say("bb", 100, 2)
    rows = [(1, say("aa", 30, 90)), (2, say("bb", 30, 91)), (3, say("cc", 30, 92)), (4, None), (5, ""), (6, "123 !? 4"), (7, mixed), (7, mixed), (None, say("cc", 9, 3)), (8, say("bb", 30000, 5))]
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["mixture"]) for r in langid.identify(docs(spark, rows), train).collect()]
    assert [g[1] for g in got] == ["aa", "bb", "cc", "und", "und", "und", "aa", "aa", "cc", "bb"]
    assert all(g[2] == 0 for g in got[3:6]) and all(g[2] > 0.95 for g in got[:3]) and 0.6 < got[6][2] < 0.9
    assert {m["lang"] for m in got[6][3]} == {"aa", "bb"} and all(0 <= g[2] <= 1 for g in got)
    kept = langid.speaking(docs(spark, rows), train)
    assert kept.columns == docs(spark, rows).columns and kept.count() == 7


def test_language_without_labels(spark):
    none = spark.createDataFrame([(None, None)], "text string, lang string")
    assert [r["lang_pred"] for r in langid.identify(docs(spark, [(1, "zork")]), none).collect()] == ["und"]
    assert langid.identify(docs(spark, [(1, "a")]).where("false"), none).count() == 0


def test_sample_is_bounded_and_ignores_ids(spark):
    train = spark.createDataFrame([(say("aa", 8, i) + f" v{i}", "aa") for i in range(400)] + [(say("bb", 8, 1), "bb")], "text string, lang string")
    langs, model = langid.learn(train, sample=50)
    assert langs == ["aa", "bb"] and model.shape == (langid.BUCKETS, 2) and np.allclose(np.exp(model.astype(float)).sum(axis=0), 1, atol=1e-3)


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = langid.op10_langid(spark, "/root/testdata/sf0.001").where("held_out").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert out and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in out)


def plain_grams(text):
    """Hashed 4-grams of the bytes of a text's letters, by the definition."""
    import unicodedata

    lower = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (" " + text.lower() + " "))
    data = re.sub(" +", " ", lower).encode()
    return [(int.from_bytes(data[i : i + 4], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for i in range(len(data) - 3)]


def plain_em(p, langs):
    pi = [1 / len(langs)] * len(langs)
    for _ in range(langid.ROUNDS):
        total = [0.0] * len(langs)
        for row in p:
            mass = sum(a * row[k] for a, k in zip(pi, langs))
            for i, k in enumerate(langs):
                total[i] += pi[i] * row[k] / mass
        pi = [t / len(p) for t in total]
    return pi, sum(math.log(sum(a * row[k] for a, k in zip(pi, langs))) for row in p)


def plain_language(grams, model):
    """(language, share): sets grow by the language whose addition the penalised likelihood takes, in the order of their shares in all."""
    rows = [[math.exp(float(x)) for x in model[g]] for g in grams]
    n = len(model[0])
    single = [sum(math.log(r[k]) for r in rows) for k in range(n)]
    best = max(range(n), key=lambda k: (single[k], -k))
    need = langid.PENALTY * math.log(max(len(rows), 2)) * langid.GRAM / 2
    pi = [1 / n] * n
    for _ in range(langid.ROUNDS // 3):
        total = [0.0] * n
        for r in rows:
            mass = sum(a * x for a, x in zip(pi, r))
            for k in range(n):
                total[k] += pi[k] * r[k] / mass
        pi = [t / len(rows) for t in total]
    chosen, shares, reached = [best], [1.0], single[best]
    for k in sorted(range(n), key=lambda k: -pi[k]):
        if k not in chosen:
            more, likelihood = plain_em(rows, [*chosen, k])
            if likelihood - reached <= need:
                break
            chosen, shares, reached = [*chosen, k], more, likelihood
    return max(zip(shares, [-k for k in chosen]))


def test_language_query_equals_plain_mixture(spark):
    """The query's languages and scores by plain arithmetic: counts, smoothing, expectation maximisation and penalty."""
    d = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    train = [r for i, r in d.items() if zlib.crc32(str(i).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None]
    langs = sorted({r["lang"] for r in train})
    counts = np.zeros((langid.BUCKETS, len(langs)))
    for r in train:
        if any(c.isalpha() for c in r["text"]):
            np.add.at(counts[:, langs.index(r["lang"])], plain_grams(r["text"]), 1)
    all_ = counts.sum(axis=1)
    base = (all_ + 0.05) / (all_.sum() + 0.05 * langid.BUCKETS)
    model = np.log((counts + 2000 * base[:, None]) / (counts.sum(axis=0) + 2000)).tolist()
    got = {r["doc_id"]: r for r in langid.op10_langid(spark, "/root/testdata/sf0.001").collect()}
    assert sorted(got) == sorted(d)
    for i in sorted(d, key=lambda i: (len(d[i]["text"] or ""), i))[:60]:
        grams = plain_grams(d[i]["text"] or "")
        if not any(c.isalpha() for c in d[i]["text"] or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        share, k = plain_language(grams, model)
        assert got[i]["lang_pred"] == langs[-k] and got[i]["score"] == pytest.approx(share, abs=2e-3)


def test_ties_go_to_the_first_language(spark):
    train = spark.createDataFrame([("zork blim tarn", "bb"), ("zork blim tarn", "aa"), ("zork blim tarn", "cc")], "text string, lang string")
    assert [r["lang_pred"] for r in langid.identify(docs(spark, [(1, "zork tarn"), (2, "blim")]), train).collect()] == ["aa", "aa"]


# ---- personal data


def plain_base(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_plain_patterns():
    rng = np.random.default_rng(4)
    alphabet = [*"0123456789", *"0123456789", ".", "-", " ", "@", "+", "(", ")", "a", "b.", "é", "٣", "_", "a@b.c", "1.2.3.4", "4111111111111111", "\n", "x@y", "%"]
    for _ in range(4000):
        t = "".join(rng.choice(alphabet, rng.integers(0, 120)))
        assert pii.base_spans(t) == plain_base(t), t


def test_long_texts_take_linear_time():
    for t in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "@" * 100_000, "+" * 100_000, "a.b@" * 80_000, "+1" + " " * 300_000, "1-" * 150_000):
        pii.spans(t)


def test_personal_data(spark):
    text = "héllo mail bob@corp.com or jane (at) corp [dot] com, call +1 (415) 555-2671, card 4111 1111 1111 1111, ip 10.0.0.1 ssn: 078-05-1120."
    rows = [(1, text), (2, None), (3, ""), (None, text), (1, text), (4, "no data 12 here 1.2.3"), (5, "x " * 60000 + "a@b.org")]
    found = {}
    for r in pii.find_personal_data(docs(spark, rows)).collect():
        found.setdefault(r["doc_id"], []).append([(s["kind"], text[s["start"] : s["end"]]) for s in r["spans"]])
    want = [("email", "bob@corp.com"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (415) 555-2671")]
    assert len(found[1]) == 2 and found[1][0][:4] == want and found[1] == found[None] * 2 and ("ssn", "078-05-1120") in found[1][0]
    assert found[2] == found[3] == found[4] == [[]] and found[5] == [[("email", "")]]
    masked = pii.mask(docs(spark, rows))
    assert masked.columns == docs(spark, rows).columns
    texts = [r["text"] for r in masked.collect()]
    assert "<EMAIL>" in texts[0] and "bob@" not in texts[0] and texts[1] is None and texts[5] == rows[5][1]
    assert pii.find_personal_data(docs(spark, rows).where("false")).count() == 0


def test_personal_data_query(spark):
    d = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in pii.op2_pii(spark, "/root/testdata/sf0.001").collect():
        base = plain_base(d[r["doc_id"]])
        names = [f"{pii.BASE[k]}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest() and set(names) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == i for x in base) for i in range(4)]


def test_reliabilities_find_a_bad_labeler():
    rng = np.random.default_rng(6)
    truth = rng.random(4000) < 0.5
    v = np.stack([np.where(rng.random(4000) < acc, truth, ~truth) * 2 for acc in (0.9, 0.85, 0.9, 0.5, 0.8, 0.9)], axis=1)
    codes = v @ (3 ** np.arange(5, -1, -1))
    kinds = np.full(4000, 5)
    post, rel = pii.reliabilities(kinds, codes, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.95 and rel[0, 2, 1] > 0.85 and abs(rel[3, 2, 1] - 0.5) < 0.1
    seen = np.where(rng.random(4000) < 0.97, truth, ~truth).astype(int)  # a feature that no labeler reads
    w = pii.classifier([[x] for x in seen], post)
    assert ((w[seen] > 0) == truth).mean() > 0.95


def test_zero_padded_parts_of_any_length():
    for t, n in (("0" * 5000 + "1.1.1.1", 1), ("1.0.0." + "0" * 9000, 1), ("1.1.1." + "0" * 5000 + "256", 0), ("9" * 6000 + ".1.1.1", 0)):
        assert len([x for x in pii.base_spans(t) if x[0] == 1]) == n


def test_a_zero_padded_address_does_not_end_a_job(spark):
    t = "0" * 5000 + "1.1.1.1"
    (row,) = pii.find_personal_data(docs(spark, [(1, t)])).collect()
    assert [(s["kind"], s["start"], s["end"]) for s in row["spans"]] == [("ip", 0, len(t))]
    assert pii.mask(docs(spark, [(1, t)])).first()["text"] == "<IP>"


def test_the_classifier_tells_equal_votes_apart(spark):
    """Held out: numbers whose votes tie, told apart by the words around them."""
    rng = np.random.default_rng(3)
    good = lambda: f"{rng.integers(200, 999)}-{rng.integers(210, 999)}-{rng.integers(1024, 9876)}"
    rows = []
    for _ in range(400):  # one in ten of each kind of surroundings has the votes that the tie below has
        odd = rng.random() < 0.1
        rows.append(f"please ring {good() if odd else '(' + good().replace('-', ') ', 1)} tonight")
        rows.append(f"the big lot {good()} shipped" if odd else f"serial big lot {'222-222-2222'.replace('2', str(rng.integers(2, 10)))} shipped")
    table = docs(spark, list(enumerate(rows)))
    w = pii.trained(pii.candidates(table))
    for _ in range(20):
        n = good()
        texts = (f"please ring {n} tonight", f"the big lot {n} shipped")
        (a,), (b,) = (pii.spans(t) for t in texts)
        assert a[3] == b[3] and pii.masked(texts[0], w) == "please ring <LOCAL> tonight" and pii.masked(texts[1], w) == texts[1]


# ---- mixing


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0] and sum(mixing.targets([10, 1000, 5, 7])) == pytest.approx(1.5 * 1022)
    assert mixing.targets([10]) == [15]


def best_sum(sizes, counts, budget):
    """The best subset sum at or under the budget, of all documents one by one."""
    reach = 1
    for s, c in zip(sizes, counts, strict=True):
        for _ in range(c):
            reach |= reach << s
    return (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1


def test_fit_is_the_best_subset_sum():
    rng = np.random.default_rng(7)
    cases = [([8, 9, 12, 13, 49], [1, 3, 2, 3, 3], 155), ([3, 7, 11], [1, 1, 1], 13), ([5], [4], 0), ([], [], 3)]
    for _ in range(2000):
        sizes = np.unique(rng.integers(1, 60, rng.integers(1, 8))).tolist()
        counts = rng.integers(0, 5, len(sizes)).tolist()
        cases.append((sizes, counts, int(rng.integers(0, max(1, sum(s * c for s, c in zip(sizes, counts))) + 5))))
    for sizes, counts, budget in cases:
        took = mixing.fit(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(took, counts, strict=True))
        assert sum(t * s for t, s in zip(took, sizes, strict=True)) == best_sum(sizes, counts, budget), (sizes, counts, budget)


def test_fit_with_a_proportional_part():
    rng = np.random.default_rng(9)
    for _ in range(200):  # the same sums while most of the budget is shared out
        sizes = np.unique(rng.integers(3, 60, 6)).tolist()
        counts = rng.integers(5, 40, len(sizes)).tolist()
        budget = int(rng.integers(200, sum(s * c for s, c in zip(sizes, counts))))
        took = mixing.fit(sizes, counts, budget, slack=1500)
        assert all(0 <= t <= c for t, c in zip(took, counts, strict=True))
        assert sum(t * s for t, s in zip(took, sizes, strict=True)) == best_sum(sizes, counts, budget)
    sizes, counts = list(range(1, 20000, 7)), [3] * 2857
    budget = sum(s * c for s, c in zip(sizes, counts)) * 2 // 3
    took = mixing.fit(sizes, counts, budget)
    assert sum(t * s for t, s in zip(took, sizes, strict=True)) == budget


def test_fit_is_proportional_at_any_number_of_documents():
    for n in (10**9, 10**10, 10**13):
        sizes, counts = [100, 1000, 10_000], [n] * 3
        budget = sum(sizes) * n // 2
        took = mixing.fit(sizes, counts, budget)
        assert sum(t * s for t, s in zip(took, sizes, strict=True)) == budget
        assert all(abs(t / n - 0.5) < 0.001 for t in took)


def test_mixing_query_equals_plain_sums(spark):
    """The query itself: sizes, targets by the loop over sources, and words that no choice of documents brings nearer from below."""
    d = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in d.items()}
    names = sorted({r["source"] for r in d.values()}, key=lambda x: (x is None, x or ""))
    by = {n: [size[i] for i, r in d.items() if r["source"] == n] for n in names}
    goal = dict(zip(names, mixing.targets([sum(by[n]) for n in names]), strict=True))
    taken = dict.fromkeys(names, 0)
    got = mixing.op5_mixing(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d)
    for r in got:
        source = d[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sum(by[source])) and r["target"] == pytest.approx(goal[source])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source] += r["taken"]
    for n in names:
        whole = sum(by[n])
        passes = int(goal[n] // whole) if whole else 0
        assert taken[n] == passes * whole + best_sum(by[n], [1] * len(by[n]), min(whole, round(goal[n] - passes * whole)))


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(0, 10**6, 300)] + [10**9]
    names = [f"s{i:04d}" for i in range(300)] + [None]
    rows = [(n is None, n or "", s) for n, s in zip(names, sizes, strict=True)]
    table = spark.createDataFrame(rows, "__mix_null boolean, __mix_source string, source_size long").repartition(7)
    got = {(r["__mix_null"], r["__mix_source"]): r["goal"] for r in mixing.settled(table).collect()}
    assert [got[a, b] for a, b, _ in rows] == pytest.approx(mixing.targets(sizes))


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), ["a", "b", None, "Z", "é"][i % 5]) for i in range(600)]
    rows += [(i, "five words are in here", "b") for i in range(600, 1400)] + [(3, None, "a"), (None, "x y\x0bz", "a"), (601, "five words are in here", "b")]
    d = docs(spark, rows)
    got = mixing.mix(d.repartition(5))
    again = {(r["doc_id"], r["text"]): r["__mix_copies"] for r in mixing.mix(d.repartition(2)).where("doc_id < 500").collect()}
    data = got.collect()
    assert all(again[r["doc_id"], r["text"]] == r["__mix_copies"] for r in data if r["doc_id"] is not None and r["doc_id"] < 500 and r["doc_id"] != 3)
    assert len(data) == len(rows) and got.columns[: len(d.columns)] == d.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {}
    for r in data:
        assert r["__mix_size"] == size(r["text"]) and 0 <= r["__mix_copies"] <= 2
        s = sums.setdefault(r["source"], [0, 0, r["__mix_target"], r["__mix_source_size"]])
        s[0] += r["__mix_size"]
        s[1] += r["__mix_size"] * r["__mix_copies"]
    names = [*sorted(k for k in sums if k is not None), None]
    assert [sums[k][2] for k in names] == pytest.approx(mixing.targets([sums[k][0] for k in names]))
    assert all(s[0] == s[3] and abs(s[1] - s[2]) <= 1 for s in sums.values())


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [(1, "a")]).where("false")).count() == 0
    only = mixing.mix(docs(spark, [(1, None, "a"), (2, "", "a")])).collect()
    assert all(r["__mix_size"] == 0 and r["__mix_target"] == 0 for r in only)
    with pytest.raises(ValueError, match="__mix_size"):
        mixing.mix(docs(spark, [(1, "a")]).withColumnRenamed("size", "__mix_size"))


# ---- licences


def test_licence_rules(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at"
    rows = [
        (1, "Text here.\nReleased under the MIT License.\nMore."), (2, apache), (3, None), (4, ""), (5, "licensed under  CC-BY-NC 4.0"), (6, "Licensed under CC BY-NC 4.0! x. Released under the MIT License"),
        (7, "You may obtain a copy of the License at"), (8, "LICENSED UNDER THE APACHE LICENSE VERSION 2.0"), (9, "x. " * 20000 + "All rights reserved."), (9, "nothing"),
        (10, "This work is licensed under the GNU General Public License, version 3.\nan other line\neither version 3 of the License, or any later version."),
    ]
    got = [(r["sentence_ids"], r["rules"], r["licenses"], r["unmatched"]) for r in licenses.scan(docs(spark, rows)).collect()]
    assert got[0] == ("D", ["mit-line"], ["MIT"], 0) and got[1] == ("ABC", ["apache-header"], ["Apache-2.0"], 0)
    assert got[2] == got[3] == got[9] == ("", [], [], 0) and got[4][1] == ["cc-by-nc"] and got[5][2] == ["CC-BY-NC-4.0", "MIT"]
    assert got[6] == ("C", [], [], 1) and got[7][1] == ["apache-line"] and got[8][1] == ["reserved"] and got[10][1] == ["gpl-later"]
    assert licenses.scan(docs(spark, rows).where("false")).count() == 0


def test_native_operators_have_no_python(spark, capsys):
    from popnet.llm import chat

    for f in (licenses.op8_licenses, chat.op7_chat):
        f(spark, "/root/testdata/sf0.001").explain()
        assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_null_columns_everywhere(spark):
    one = docs(spark, [(1, "a")]).select(*[F.lit(None).cast(t).alias(c) for c, t in docs(spark, [(1, "a")]).dtypes])
    assert mixing.mix(one).first()["__mix_copies"] == 0 and licenses.scan(one).first()["rules"] == [] and simhash.near_duplicates(one).first()["fingerprint"] == "0" * 16
