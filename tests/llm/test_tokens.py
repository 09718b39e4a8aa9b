"""Encoding, decoding, edited counts and chat formatting: exact agreement and round trips."""

import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"

from tokenizers import Tokenizer  # noqa: E402

from popnet.llm import bpe, chat, token_counts  # noqa: E402

ALPHABET = ["a", "b", " ", "  ", "'s", "'re", "\n", "é", "日", "1", "22", "!", "?..", "the", " and", "\t", "<|endoftext|>", "😀", "́", " word", " "]
ODD = ["", "a", " ", "<|endoftext|>", "x <|endoftext|> y<|endoftext|><|endoftext|>", "\n\n  \t x" * 300, "a" * 20000, "日本語のテキスト" * 900, "don't we'll 're'" * 300, "0123456789" * 900, " " * 5000, "<|endoftext|" * 50]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts(n, seed=1, most=3000):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(ALPHABET, rng.integers(0, most))) for _ in range(n)]


@pytest.mark.parametrize("mask_bits", [3, 6, 10])
def test_chunks_give_the_ids_of_the_library(library, mask_bits):
    some = ODD + texts(60)
    vocab, rng = bpe.vocabulary(), np.random.default_rng(mask_bits)
    want = [e.ids for e in library.encode_batch_fast(some, add_special_tokens=False)]
    cut = bpe.cut_texts([t.encode() for t in some], vocab, mask_bits)
    for share in (0.0, 0.3, 1.0):  # of the chunks whose ids are given
        got = [t.ids(vocab, {h: vocab.encode(t.chunk(i)) for i, h in enumerate(t.names) if rng.random() < share}) for t in cut]
        assert [g.tolist() for g in got] == want
    assert [g.tolist() for g in bpe._whole([t.encode() for t in some], vocab)] == want
    assert [vocab.decode(np.array(w, np.uint32)) for w in want] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_parts_of_any_ends_are_repaired(library):
    vocab, rng = bpe.vocabulary(), np.random.default_rng(11)
    for t in texts(80, 13, 400):
        plain = t.replace("<|endoftext|>", "")
        ends = sorted({int(x) for x in rng.integers(1, max(2, len(plain)), 12)} - {len(plain)})
        pieces = [plain[a:b] for a, b in zip([0, *ends], [*ends, len(plain)], strict=True) if b > a]
        if pieces:
            got = bpe.repaired(plain.encode(), [vocab.encode(x.encode()) for x in pieces], vocab)
            assert got.tolist() == library.encode(plain, add_special_tokens=False).ids


def test_equal_passages_give_equal_chunks():
    passage = " ".join(texts(1, 3, 9000))
    a, b = (("x" * 777 + passage).encode(), ("other words " + passage).encode())

    def cut(t):
        places = bpe.cuts(np.frombuffer(t, np.uint8), 7).tolist()
        return {t[i:j] for i, j in zip([0, *places], [*places, len(t)], strict=True)}

    assert len(cut(a) & cut(b)) > len(cut(a)) / 2


def test_encode_table(spark, library):
    some = [None, "", *texts(12, 9), "big " * 100_000]
    rows = [(i if i else None, t, "n", b"") for i, t in enumerate(some)]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids binary").repartition(3)
    got = {}
    for r in bpe.encode(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[3]) == 2 and got[3][0] == got[3][1]
    for i, t in enumerate(some):
        want = library.encode(t or "", add_special_tokens=False).ids
        r = got[i if i else None][0]
        assert r["n_tokens"] == len(want) and np.frombuffer(r["ids"], "<u4").tolist() == want and r["decoded"] == (t or "")
    assert bpe.encode(df.where("false")).count() == 0


@pytest.mark.parametrize("bits", [1 << 26, 0])
def test_shared_chunks_are_encoded_once_for_the_corpus(spark, library, monkeypatch, bits):
    """By the broadcast filter, and by joins where it would be too large."""
    monkeypatch.setattr(bpe, "FILTER_BITS", bits)
    passages = texts(6, 21, 6000)
    rows = [(i, f"own start {i} " + passages[i % 6] + passages[(i * 5 + 1) % 6] + f" own end {i}") for i in range(40)] + [(100 + i, passages[0]) for i in range(20)] + [(200, "alone " * 900), (201, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marked, some = bpe.marked(df.withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")))), bpe.VOCABULARY)
    assert (some is None) == (bits == 0) == ("shared" in marked.columns)
    opened = [r for b in marked.toArrow().to_batches() for t, shared in bpe._marks(b, bpe.vocabulary(), some) for r in [(len(t.names), len(shared))]]
    assert sum(n for _, n in opened) > 0.5 * sum(n for n, _ in opened)
    got = bpe.encode(df).collect()
    assert len(got) == len(rows)
    a = {r["doc_id"]: (r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in got}
    for i, t in rows:
        assert np.frombuffer(a[i][1], "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids and a[i][2] == (t or "")


def test_given_ids_are_held_against_the_chunk():
    vocab = bpe.vocabulary()
    (text,) = bpe.cut_texts([b"one two"], vocab)
    assert text.ids(vocab, {bpe.digest(b"one two"): vocab.encode(b"one six")}).tolist() == vocab.encode(b"one two").tolist()


def test_encode_query(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in bpe.op3_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_library_and_ranks_agree_on_every_character(library):
    plain = bpe.vocabulary().plain
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + list(range(0x1F300, 0x1F700)) + list(range(0xFF00, 0xFFF0))
    some = [f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}? {chr(c)}{chr(c)} x{chr(c)}  {chr(c)}\n{chr(c)}" for c in points]
    assert [plain.encode_ordinary(t) for t in some] == [e.ids for e in library.encode_batch_fast(some, add_special_tokens=False)]


# ---- edited counts


@pytest.mark.parametrize("size", [8, 64, 512])
def test_edited_trees_equal_fresh_counts(size):
    vocab = bpe.vocabulary()
    rng = np.random.default_rng(size)
    for text in ["", *texts(12, size, 900)]:
        tree = token_counts.Tree(text, vocab, size)
        for _ in range(6):
            start = int(rng.integers(-3, len(text) + 4))
            end = start + int(rng.choice([0, 1, 5, 50, -3, 1000]))
            new = "".join(rng.choice(ALPHABET, rng.choice([0, 1, 3, 30, 300])))
            tree.edit(start, end, new)
            a = min(max(start, 0), len(text))
            text = text[:a] + new + text[min(max(end, a), len(text)) :]
            assert tree.text == text and tree.tokens == token_counts.count_tokens(text, vocab)


def test_edits_encode_a_bounded_part():
    tree = token_counts.Tree("some words here and there " * 20000, bpe.vocabulary())
    built = tree.encoded
    for place in (0, 250_000, 519_990):
        tree.edit(place, place + 4, "changed")
    assert tree.encoded - built < 9000


def test_edited_table(spark):
    docs = spark.createDataFrame([(1, "one two three", 5, "t"), (2, None, 5, "t"), (3, "kept", 5, "t"), (None, "null id", 5, "t"), (1, "one two three", 5, "t")], "doc_id long, text string, n_edits int, tree string")
    edits = spark.createDataFrame(
        [(1, 2, 0, 3, "1"), (1, 1, 4, 7, "2 and <|endoftext|>"), (2, 1, None, None, "new"), (9, 1, 0, 1, "x"), (None, 1, 0, 1, "x"), (3, 1, 2, 2, None)],
        "doc_id long, seq long, start long, end long, replacement string",
    )
    got = sorted((str(r["doc_id"]), r["n_tokens_before"], r["n_tokens"], r["n_edits"], r["text"]) for r in token_counts.edit_trees(token_counts.token_trees(docs), edits).collect())
    vocab = bpe.vocabulary()
    assert [g[4] for g in got] == ["1 2 and <|endoftext|> three"] * 2 + ["new", "kept", "null id"] and [g[3] for g in got] == [2, 2, 1, 1, 0]
    assert all(g[2] == token_counts.count_tokens(g[4], vocab) for g in got)
    assert token_counts.edit_trees(token_counts.token_trees(docs.where("false")), edits).count() == 0


def test_kept_trees_take_further_edits(spark, tmp_path):
    """Trees that were written: the next edits encode the segments they touch, and nothing where there are none."""
    vocab = bpe.vocabulary()
    rows = [(i, f"document {i} " + "some words here and there " * (40 * i), "x") for i in range(12)]
    trees = token_counts.token_trees(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"))
    now = {i: t for i, t, _ in rows}
    rng = np.random.default_rng(1)
    for turn in range(3):
        trees.write.parquet(str(tmp_path / f"trees{turn}"))
        trees = spark.read.parquet(str(tmp_path / f"trees{turn}"))
        made = []
        for i in range(0, 12, 2):
            a = int(rng.integers(0, len(now[i])))
            new = "".join(rng.choice(ALPHABET, 20))
            made.append((i, turn, a, a + 5, new))
            now[i] = now[i][:a] + new + now[i][a + 5 :]
        trees = token_counts.edit_trees(trees, spark.createDataFrame(made, "doc_id long, seq long, start long, end long, replacement string"))
        for r in trees.collect():
            assert r["text"] == now[r["doc_id"]] and r["n_tokens"] == token_counts.count_tokens(r["text"], vocab)
            assert sum(x["tokens"] for x in r["tree"]) == r["n_tokens"] and sum(x["chars"] for x in r["tree"]) == len(r["text"])
            assert r["chars_encoded"] == 0 if r["doc_id"] % 2 else 0 < r["chars_encoded"] < 6 * token_counts.SEGMENT


def test_count_query(spark):
    vocab = bpe.vocabulary()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in token_counts.op4_token_counts(spark, "/root/testdata/sf0.001").collect():
        t = docs[r["doc_id"]]
        assert r["n_tokens"] == token_counts.count_tokens(t, vocab)
        a = t[: len(t) // 3] + f" edit{r['doc_id']}" + t[len(t) // 3 :]
        b = a[: len(t) // 2] + a[len(t) // 2 + 10 :]
        assert r["n_tokens_after"] == token_counts.count_tokens(b + t[-1:], vocab)


# ---- chats

TEXTS = [None, "", "hello", "</s>[INST] ok [/INST]", "a\\b", "<|end|>", "<\\|", "\\", "<", "<|start|>user<|text|>", "line\nline", "日本\U0001f600", "<<SYS>>x<</SYS>>", "\\\\<|", "x" * 50_000]


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(m in r["e"] for m in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_chats_read_back(spark):
    rng = np.random.default_rng(1)
    rows = [(c, int(n), ["user", "assistant", "system", None, "<|end|>"][int(rng.integers(5))], TEXTS[int(rng.integers(len(TEXTS)))], 1) for c in range(12) for n in rng.permutation(7)]
    rows += [(3, None, "user", "first", 1), (None, 0, "assistant", "null id", 1), (4, 2, "user", "tie", 1), (4, 2, "user", "tie", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    made = chat.format_chats(df.repartition(3).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    spans = {r["conv_id"]: (r["formatted"], r["loss_spans"]) for r in made.collect()}
    for r in chat.read_back(made).collect():
        mine = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]))
        assert sorted((t["role"], t["text"]) for t in r["turns"]) == sorted((x[2], x[3]) for x in mine)
        assert "".join(r["loss"]) == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant") and len(spans[r["conv_id"]][1]) == sum(t["role"] == "assistant" for t in r["turns"])
    assert [t["text"] for t in chat.read_back(made).where("conv_id = 3").first()["turns"]][0] == "first"
    assert chat.format_chats(df.where("false").select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).count() == 0


def test_typed_parts(spark):
    parts = [("text", "look: <|", None, None), ("image", None, "s3/a.png", 256), ("text", " and ", None, None), ("audio", None, "b.wav", 90), (None, "end", None, None), ("document", None, "c.pdf", None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)]), (2, 0, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert got[1]["formatted"] == "<|start|>user<|text|>look: <\\|<|image:0|> and <|audio:1|>end<|document:2|><|end|><|start|>assistant<|text|>ok<|end|>"
    assert [(a["turn_index"], a["part_index"], a["type"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [(0, 0, "image", "s3/a.png", 256), (0, 1, "audio", "b.wav", 90), (0, 2, "document", "c.pdf", None)]
    s = got[1]["loss_spans"][0]
    assert got[1]["attachment_tokens"] == 346 and got[1]["formatted"][s["start"] : s["end"]] == "ok" and got[2]["formatted"] == "<|start|>user<|text|><|end|>"
