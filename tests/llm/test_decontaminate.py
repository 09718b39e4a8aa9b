"""Benchmark decontamination against plain windows."""

import re

import pytest

from popnet.llm import decontaminate as dec

DOCS = "doc_id long, text string, n int, at int, w string, gram string, hits string, items string"
ITEMS = "item_id long, text string, n int, place long, lead int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(docs, items, size=10):
    windows = set()
    for i, text in items:
        w = words(text)
        n = min(size, len(w))
        windows |= {(tuple(w[a : a + n]), i) for a in range(len(w) - n + 1) if n}
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for g, i in windows:
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a : a + len(g)]) == g:
                    hit |= set(range(a, a + len(g)))
                    found |= {str(i)} if i is not None else set()
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


PASSAGE = "The Quick brown fox-jumps over 13 LAZY dogs, and then é sleeps in the Éclair shop. So it goes."
ITEMS_ = [
    (1, PASSAGE), (2, PASSAGE), (2, PASSAGE), (10, "Hello World"), (11, "K"), (12, None), (13, ""), (14, "..."), (None, "secret words that no item names but that count as hits anyway"),
    (15, "a a a a a a a a a a a a"), (16, "one two three four five six seven eight nine ten"),
]
LOUD = PASSAGE.translate({c: c - 32 for c in range(ord("a"), ord("z") + 1)})  # no letter beyond ASCII changes
DOCS_ = [
    (1, f"Before it. {LOUD} After it."), (2, "the quick brown fox jumps over 13 lazy dogs and é"), (3, "the quick brown fox jumps over 13 lazy dogs, AND; then. é sleeps"),
    (4, "Hello, world hello_world helloworld"), (5, "k K \u212a"), (6, None), (7, ""), (8, " ,;"), (9, "a " * 11), (10, "a " * 9), (None, "secret words that no item names but that count as hits anyway"),
    (1, f"Before it. {LOUD} After it."), (11, "clean text of more than ten words that nothing in the list of items has at all"), (12, "x" * 300_000 + " hello world " + "y " * 20_000),
    (13, "one two three four five six seven eight nine ten one two three four five six seven eight nine ten eleven"), (14, "É ELAIR hello\x00world"),
]


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "w", "g", "h", "i") for r in rows], DOCS).repartition(3)


def items(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], ITEMS)


def found(spark, d, i):
    rows = dec.scan(docs(spark, d), items(spark, i), ["doc_id"]).collect()
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows], key=repr)


@pytest.mark.parametrize("bound", [dec.BROADCAST_BYTES, 0])
def test_plain_windows(spark, monkeypatch, bound):
    monkeypatch.setattr(dec, "BROADCAST_BYTES", bound)
    assert found(spark, DOCS_, ITEMS_) == brute(DOCS_, ITEMS_)
    assert found(spark, DOCS_, ITEMS_[:2]) == brute(DOCS_, ITEMS_[:2])


def test_full_set(spark, monkeypatch):
    """With two places nearly all starts go to the join; results stay."""
    monkeypatch.setattr(dec, "BITS", 1)
    assert found(spark, DOCS_, ITEMS_) == brute(DOCS_, ITEMS_)


def test_empty_tables(spark):
    assert found(spark, [], ITEMS_) == []
    assert found(spark, DOCS_, []) == brute(DOCS_, [])
    assert found(spark, DOCS_, [(1, None)]) == brute(DOCS_, [])


def test_spans_are_taken_out(spark):
    got = {r["doc_id"]: r for r in dec.decontaminated(docs(spark, DOCS_), items(spark, ITEMS_)).collect()}
    assert set(got[4].asDict()) == {"doc_id", "text", "n", "at", "w", "gram", "hits", "items"} and got[4]["hits"] == "h"
    assert got[1]["text"] == "Before it. . After it."  # the full stop stands behind the last word that is hit
    assert got[4]["text"] == " helloworld" and got[5]["text"] == " \u212a"  # spans side by side go as one
    assert got[12]["text"] == "x" * 300_000 + "  " + "y " * 20_000 and got[8]["text"] == " ,;"
    assert got[13]["text"] == " eleven" and got[3]["text"] == "" and got[2]["text"] == " é"
    assert got[11]["text"] == DOCS_[12][1] and got[6]["text"] is None and got[7]["text"] == ""
    assert sum(1 for _ in got) == len({d for d, _ in DOCS_})
    left = [(r["doc_id"], r["text"]) for r in dec.decontaminated(docs(spark, DOCS_), items(spark, ITEMS_)).collect()]
    assert len(left) == len(DOCS_)


def test_documents_are_taken_out(spark):
    got = [r["doc_id"] for r in dec.decontaminated(docs(spark, DOCS_), items(spark, ITEMS_), whole=True).collect()]
    assert sorted(got) == sorted(d for d, _, n, _ in brute(DOCS_, ITEMS_) if not n)


def test_own_names_are_refused(spark):
    with pytest.raises(ValueError, match="__dec_"):
        dec.scan(docs(spark, DOCS_).withColumnRenamed("n", "__dec_n"), items(spark, ITEMS_), ["doc_id"])
