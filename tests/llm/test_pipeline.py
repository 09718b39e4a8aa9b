"""The pipeline against a plain version of each stage, and its rules."""

import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from popnet.llm import mixing, pii
from popnet.llm.shared import written
from tests.llm.test_nearcopies import plain_kept

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "personal_data", "source_mix", "token_ids"]
    odd = spark.createDataFrame([(10**6, "1234 !!", "en", "src0", 7), (10**6 + 1, None, "fr", None, 0), (10**6 + 2, docs.first()["text"], None, None, 1)], docs.schema)
    steps = [docs.unionByName(odd)]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], DIR), name))
    raw, spoken, unique, clean, mixed, ids = [s.collect() for s in steps]
    assert all(s.columns == columns for s in steps[:-1])
    # language ID: the two rows without a letter go, nothing else
    assert {r["doc_id"] for r in raw} - {r["doc_id"] for r in spoken} == {10**6, 10**6 + 1} and all(r in raw for r in spoken)
    # near-duplicates: the smallest id of each group
    assert sorted(r["doc_id"] for r in unique) == plain_kept([(r["doc_id"], r["text"]) for r in spoken]) and all(r in spoken for r in unique)
    # personal data: no base span is left, texts without any are unchanged
    before = {r["doc_id"]: r for r in unique}
    assert sorted(before) == sorted(r["doc_id"] for r in clean)
    for r in clean:
        spans = pii.spans(before[r["doc_id"]]["text"])
        assert not pii.base_spans(r["text"]) and (spans or r["text"] == before[r["doc_id"]]["text"]) and r["n_chars"] == len(r["text"])
    # mixing: each source near its target, nothing above two copies
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    have = {}
    for r in clean:
        have.setdefault(r["source"], 0)
        have[r["source"]] += size(r["text"])
    took = dict.fromkeys(have, 0)
    copies = {}
    for r in mixed:
        took[r["source"]] += size(r["text"])
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    order = [*sorted(k for k in have if k is not None), *([None] if None in have else [])]
    for k, goal in zip(order, mixing.targets([have[k] for k in order]), strict=True):
        assert abs(took[k] - goal) <= 1 + 0.02 * have[k]
    assert max(copies.values()) <= 2
    # ids: those of the library
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in mixed}
    assert len(ids) == len(mixed)
    for r in ids:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(text[r["doc_id"]], add_special_tokens=False).ids


def test_run_reruns_alike(spark):
    a, b = (sorted(tuple(r) for r in corpus_pipeline.run(spark, DIR).select("doc_id", "ids_sha256").collect()) for _ in range(2))
    assert a and a == b and corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DIR), name)
    assert docs.count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, size long, component_id string, spans int, key long, h binary"
TEXT = "The quick brown fox jumps over the lazy dog and runs into the forest before the hunters arrive, mail ann@corp.com now. "


def odd_tables(spark):
    """Null-only, repeated, tied and long rows among columns whose names clash with results."""
    rest = ("en", "s", 3, 1, "c", 2, 4, b"x")
    yield "nulls", spark.createDataFrame([(None, None, None, None, None, None, None, None, None, None)] * 3, ODD)
    yield "repeated", spark.createDataFrame([(1, TEXT * 3, *rest)] * 5 + [(2, TEXT * 3, *rest)], ODD)
    yield "tied", spark.createDataFrame([(i, TEXT + f"word{i} " * 40, *rest) for i in range(6)] + [(None, TEXT * 2, *rest), (None, TEXT * 2, *rest), (9, "", *rest)], ODD)
    yield "long", spark.createDataFrame([(1, TEXT * 20_000, *rest), (2, "a" * 300_000, *rest), (3, "0" * 5000 + "1.1.1.1 and words here", *rest)], ODD)


def test_stages_on_odd_tables(spark):
    """Each stage alone: columns stay, rows are the stage's input, and what the docstrings state holds."""
    for what, docs in odd_tables(spark):
        have = [tuple(r) for r in docs.collect()]
        by = {name: (docs.columns, [tuple(r) for r in stage(spark, docs, DIR).collect()]) if name == "token_ids" else _stage(spark, stage, docs) for name, stage in corpus_pipeline.STAGES}
        for name in ("language_id", "near_duplicates", "personal_data", "source_mix"):
            assert by[name][0] == docs.columns, (what, name)
        assert all(r in have for r in by["language_id"][1] + by["near_duplicates"][1] + by["source_mix"][1])
        assert len(by["personal_data"][1]) == len(have) and len(by["token_ids"][1]) == len(have)
        if what == "nulls":
            assert by["language_id"][1] == [] and len(by["near_duplicates"][1]) == 1 and by["source_mix"][1] == []
            assert all(r[1] is None for r in by["personal_data"][1]) and all(r[1] == 0 for r in by["token_ids"][1])
        if what == "repeated":
            assert [r[0] for r in by["near_duplicates"][1]] == [1] and all("<EMAIL>" in r[1] for r in by["personal_data"][1])
            assert len(by["source_mix"][1]) == 9  # half as many words again as six equal rows have
        if what == "tied":
            assert len([r for r in by["near_duplicates"][1] if r[0] is None]) == 1
        if what == "long":
            assert any(r[1].startswith("<IP>") for r in by["personal_data"][1])


def _stage(spark, stage, docs):
    out = stage(spark, docs, DIR)
    return out.columns, [tuple(r) for r in out.collect()]


def test_names_that_a_stage_uses_itself_are_refused(spark):
    docs = spark.createDataFrame([(1, TEXT, "en", "s", 3, 1)], "doc_id long, text string, lang string, source string, n_chars long, __dup_id int")
    with pytest.raises(ValueError, match="__dup_id"):
        corpus_pipeline.near_duplicates(spark, docs, DIR)
    with pytest.raises(ValueError, match="__mix_size"):
        corpus_pipeline.source_mix(spark, docs.withColumnRenamed("__dup_id", "__mix_size"), DIR)
