"""Language identification by mixture inference (operator 10).

Model: counts of letter n-grams (bytes of the lower-cased text whose other characters are
spaces), hashed into ``BUCKETS``, per language, smoothed; learned from whole texts of at
most about ``SAMPLE`` labelled documents per language, chosen by a hash of the text so that
the bound holds at any size (a language with fewer is learned from all).

Prediction: a document's n-grams are drawn from a mixture of languages.  Expectation
maximisation estimates the proportions for a set of languages; sets grow from the best
single language by the language that gains most, and a language is added only when twice
the gain in log-likelihood, over the n-grams' overlap, exceeds ``PENALTY`` times the log of
the n-grams' number.  The predicted language has the largest proportion, which is the score.

Defined cases: null texts and texts without a letter are ``und`` with score 0; ties go to
the language first by code point; no labelled document at all makes every prediction
``und``; repeated rows count again; an empty table gives an empty table; a text of any
length is read whole, its n-grams summed up in parts; further columns are ignored, whatever
their names, and only text and lang of the training rows are read for learning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from popnet.llm.bpe import slices
from popnet.llm.shared import bounded, table, tidied

#: Labelled documents per language that the model is learned from, about.
SAMPLE = 2000
BITS = 16
BUCKETS = 1 << BITS
#: Bytes in an n-gram.
GRAM = 4
PENALTY = 4.0
ROUNDS = 12
#: N-grams whose likelihoods are held at once; longer texts are summed up in parts.
PART = 1 << 16
UND = "und"
#: The proportion of its main language under which a filter rejects a document.
LEAST = 0.4
_MUL = np.uint32(0x9E3779B1)


def letters(texts: pa.Array) -> pa.Array:
    """Lower-cased, runs of other characters than letters as one space, with a space at both ends."""
    lower = pc.utf8_lower(texts)
    return pc.replace_substring_regex(pc.binary_join_element_wise("", lower, "", " "), r"[^\p{L}]+", " ")


def grams(text: bytes) -> np.ndarray:
    """The hashed n-grams of a prepared text."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < GRAM:
        data = np.concatenate((data, np.full(GRAM - len(data), 32, np.uint8)))
    words = np.ndarray((len(data) - GRAM + 1,), np.dtype("<u4"), np.ascontiguousarray(data), strides=(1,))
    with np.errstate(over="ignore"):
        return (words * _MUL) >> np.uint32(32 - BITS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of this task's rows (lang, text)."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for langs, texts in slices(batch):
            clean = letters(pa.array([t.decode() for t in texts], pa.string())).to_pylist()
            for lang, text in zip(langs.to_pylist(), clean, strict=True):
                if text.strip():
                    table_ = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    table_ += np.bincount(grams(text.encode()), minlength=BUCKETS)
    for lang, row in counts.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(row[at])], names=["lang", "gram", "n"])


def learn(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of BUCKETS by languages) from rows with text and a lang.

    What reaches the driver is one number per language and at most BUCKETS counts of each.
    """
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return [], np.zeros((BUCKETS, 0), np.float32)
    # a row is taken when its hash is under its language's share
    keep = F.lit(False)
    for lang, n in totals.items():
        if n <= sample:
            keep |= F.col("lang") == lang
        else:
            keep |= (F.col("lang") == lang) & (F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(sample / n * (1 << 40)))
    counted = rows.where(keep).mapInArrow(lambda it: tidied(_counted(it)), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    langs = sorted(set(got.column(0).unique().to_pylist()))
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    at = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((BUCKETS, len(langs)))
    counts[got.column(1).to_numpy(), [at[x] for x in got.column(0).to_pylist()]] = got.column(2).to_numpy()
    # n-grams are smoothed towards their mean over the languages, and that towards all buckets alike
    share = counts.sum(axis=1, keepdims=True)
    base = (share + 0.05) / (share.sum() + 0.05 * BUCKETS)
    strength = 2000.0
    p = (counts + strength * base) / (counts.sum(axis=0, keepdims=True) + strength)
    return langs, np.log(p).astype(np.float32)


def _proportions(p: np.ndarray, weight: np.ndarray, langs: list[int], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM over a set of languages: proportions, and the log-likelihood.  ``p``: each n-gram's probabilities, scaled by its largest."""
    some = p[:, langs]
    pi = np.full(len(langs), 1 / len(langs), np.float32)
    total = weight.sum()
    for _ in range(rounds):
        mass = some @ pi
        pi = pi * (some.T @ (weight / mass)) / total
    return pi, float(weight @ np.log(some @ pi))


def infer(ids: np.ndarray, model: np.ndarray) -> tuple[int, float, list[tuple[int, float]]]:
    """(best language, its proportion, the set with proportions) of a text's n-grams."""
    if len(ids) > PART:
        weight = np.bincount(ids, minlength=BUCKETS)
        ids = np.flatnonzero(weight)
        weight = weight[ids].astype(np.float32)
    else:
        weight = np.ones(len(ids), np.float32)
    logs = model[ids]
    single = weight @ logs
    best = int(np.argmax(single))
    n = float(weight.sum())
    need = PENALTY * np.log(max(n, 2)) * GRAM / 2  # neighbouring n-grams share letters
    if model.shape[1] == 1:
        return best, 1.0, [(best, 1.0)]
    top = logs.max(axis=1, keepdims=True)
    # the most that any mixture can gain over the best language
    if float(weight @ (top[:, 0] - logs[:, best])) <= need:
        return best, 1.0, [(best, 1.0)]
    p = np.exp(logs - top)
    chosen, pi = [best], np.ones(1, np.float32)
    reached = float(weight @ (logs[:, best] - top[:, 0]))
    everyone, _ = _proportions(p, weight, list(range(model.shape[1])), ROUNDS // 3)  # for their order only
    for lang in np.argsort(-everyone, kind="stable").tolist():
        if lang in chosen:
            continue
        shares, likelihood = _proportions(p, weight, [*chosen, lang])
        if likelihood - reached <= need:
            break
        chosen, pi, reached = [*chosen, lang], shares, likelihood
    mix = sorted(zip(chosen, pi.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return mix[0][0], min(1.0, max(0.0, mix[0][1])), mix


def _predicted(batches: Iterator[pa.RecordBatch], langs: list[str], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in slices(batch):
            clean = letters(pa.array([t.decode() for t in texts], pa.string())).to_pylist()
            names, scores, mixes = [], [], []
            for text in clean:
                if not langs or not text.strip():
                    names.append(UND)
                    scores.append(0.0)
                    mixes.append([])
                    continue
                best, score, mix = infer(grams(text.encode()), model)
                names.append(langs[best])
                scores.append(score)
                mixes.append([{"lang": langs[i], "share": s} for i, s in mix])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, kind)], names=["doc_id", "lang_pred", "score", "mixture"])


def identify(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, lang_pred, score, mixture) for each row of ``docs`` (doc_id, text); ``labelled`` (text, lang) is learned from."""
    model = learn(labelled, sample)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>"
    return rows.mapInArrow(lambda it: tidied(_predicted(it, *held.value)), schema)


def speaking(docs: DataFrame, labelled: DataFrame, least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose language is known with a proportion of at least ``least``; all columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(learn(labelled, sample))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, at):
            rows = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["doc_id", "text"])
            found = [x for part in _predicted(iter([rows]), *held.value) for x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield batch.filter(pa.array([lang != UND and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(lambda it: tidied(run(it)), docs.schema)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
