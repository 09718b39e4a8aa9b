"""Operators 7, 9 and 10 on very long texts and on columns with the names that they use themselves."""

import xxhash
from pyspark.sql import functions as F

from popnet.llm import chat, langid, simhash

CLASHING = "fp string, k long, root long, u long, v long, component_id long, fingerprint string, score double, h long, lang_pred string, text_ string"


def with_clashes(spark, rows):
    names = [c.split()[0] for c in CLASHING.split(", ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kinds = dict(c.split() for c in CLASHING.split(", "))
    return docs, docs.select("*", *[F.lit("1").cast(kinds[n]).alias(n) for n in names])


def plain_fingerprint(text):
    words = text.lower().split()
    counts = [0] * 64
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    for g in grams:
        value = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for b in range(64):
            counts[b] += value >> b & 1
    return f"{sum(1 << b for b in range(64) if 2 * counts[b] > len(grams)):016x}"


def test_simhash(spark):
    long = " ".join(f"w{i * i % 977}x{i % 13}" for i in range(60_000))  # more shingles than are counted at once
    rows = [(1, long, "en"), (2, "a b c d", "en"), (3, long, "fr"), (4, "y" * 500_000, None)]
    plain, clashing = with_clashes(spark, rows)
    one, two = (sorted(map(tuple, simhash.fingerprints(d).select("doc_id", "fp").collect())) for d in (plain, clashing))
    assert one == two
    found = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(clashing).collect()}
    assert found[1] == found[3] == plain_fingerprint(long)


def test_langid(spark):
    rows = [(i, ("the cat and the hat that sat " if i % 2 else "le chat et le chapeau de la ville ") * 20, "en" if i % 2 else "fr") for i in range(40)] + [(100, "the cat and the hat " * 60_000, None)]
    plain, clashing = with_clashes(spark, rows)
    known = plain.where("lang is not null").select("text", "lang")
    one, two = (sorted(map(tuple, langid.identify(d.drop("lang"), known).select("doc_id", "lang_pred").collect())) for d in (plain, clashing))
    assert one == two and dict(one)[100] == "en" and dict(one)[2] == "fr"


def test_chat(spark):
    long = "</s> " * 100_000
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "x")], "conv_id long, turn int, role string, text string")
    parts = turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"), *[F.lit(1).alias(c) for c in ("body", "others", "piece", "at", "t", "formatted", "head")])
    (back,) = chat.read_back(chat.format_chats(parts)).collect()
    assert [t["text"] for t in back["turns"]] == [long, "x"] and back["loss"] == ["x"]
