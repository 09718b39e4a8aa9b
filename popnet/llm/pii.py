"""Personal data by weak supervision (operator 2).

Base spans come from fixed patterns and always stay.  Wider patterns give further
candidates (``handle``: spelled-out e-mail addresses, ``local``: phone numbers without a
plus, ``ssn``, ``iban``).  Six labelers vote (1, 0 or -1) on every candidate: the pattern
itself, a check of its value, gazetteers (domains, given names and role mailboxes, calling
codes, card issuers, address blocks, IBAN lengths), the words before it, what it touches,
and how varied its characters are.  Expectation maximisation over the counts of (kind,
votes) of all candidates estimates each labeler's reliability without labels.

Its posteriors are the soft labels of the span classifier: a logistic model of hashed
features of the span and its surroundings (shape, length, separators, the signs next
to it, the two words before, the word behind), which sees of the votes the value's check
alone.  It decides about the candidates that aren't base spans, so spans with equal votes
may be told apart.  The
classifier is fitted to at most about ``SAMPLE`` candidates of each kind, chosen by a hash;
the counts that the expectation maximisation reads are those of all candidates, at most
len(KINDS) * 3^6 rows at any size of the corpus.

Defined cases: null text is empty and has no spans; offsets are code points, ends
exclusive; a candidate that overlaps a base span or an earlier candidate is dropped; a
null doc_id and repeated rows get rows of their own; an empty table gives an empty table;
further columns, whatever their names, are ignored by ``find_personal_data`` and kept by
``mask``; long texts are read whole, in time linear in their length, numbers of any number
of digits included.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from popnet.llm.bpe import slices
from popnet.llm.shared import bounded, released, table, tidied, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "handle", "local", "ssn", "iban")
LABELERS = ("pattern", "check", "gazetteer", "context", "touch", "variety")
CODES = 3 ** len(LABELERS)
#: Code points before a candidate in which the context labeler reads.
CONTEXT = 32
KEEP_FROM = 0.5
#: Rows that a labeler's counts start from: by vote (-1, 0, 1), of the classes no and yes.
BELIEF = np.array([[12.0, 4.0], [10.0, 10.0], [4.0, 12.0]])
#: Candidates of each kind that the classifier is fitted to, about, and the number of its weights.
SAMPLE, WIDTH = 4000, 4096
SPANS = "array<struct<kind:int,start:bigint,end:bigint,code:int,feats:array<int>>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit before can't begin a match that the digits' start doesn't
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HANDLE = re.compile(r"[ ]?[\[(](?:at|AT)[\])][ ]?([A-Za-z0-9-]{1,63}(?:(?:\.|[ ]?[\[(](?:dot|DOT)[\])][ ]?)[A-Za-z0-9-]{1,63})+)")
_NUMBER = re.compile(r"(?<![0-9])(?:\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}))(?![0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

#: Top-level domains, given names, role mailboxes and calling codes of the gazetteers, and context words.
DOMAINS = frozenset("com org net edu gov int info biz io dev app ai co uk de fr es it nl eu us ca au jp cn in br ru ch at be se no dk fi pl pt".split())
NAMES = frozenset("alice ana andrea anna antonio ben carlos chen claire daniel david elena emma eva frank hans ivan jack james jan jane jean john jorge jose juan julia karl laura li lisa lucas luis maria marie mark martin mary max michael miguel nina olga omar pablo paul peter pierre rosa sara sofia thomas tom wei yuki".split())
ROLES = frozenset("abuse admin billing contact help hello hostmaster info jobs mail marketing news newsletter noreply office orders postmaster press root sales security service support team webmaster".split())
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "351", "353", "358", "420")
#: Number ranges of card issuers, as first and last prefix.
ISSUERS = (("4", "4"), ("51", "55"), ("2221", "2720"), ("34", "34"), ("37", "37"), ("6011", "6011"), ("644", "659"), ("3528", "3589"), ("36", "36"), ("38", "39"), ("300", "305"), ("62", "62"), ("50", "50"), ("56", "58"))
#: The length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
#: Beginnings of IPv4 addresses that name no host of the public net.
UNROUTED = ("0.", "127.", "255.", "192.0.2.", "198.51.100.", "203.0.113.", "1.0.0.")
FOR = {
    "email": ("mail", "contact", "write to", "kontakt", "correo", "courriel"), "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"), "phone": ("tel", "phone", "call", "fax", "mobile", "cell"),
    "handle": ("mail", "contact", "write to", "reach"), "local": ("tel", "phone", "call", "fax", "mobile", "cell", "reach"),
    "ssn": ("ssn", "social security", "social-security"), "iban": ("iban", "account", "konto", "compte", "cuenta"),
}
AGAINST = ("version", "isbn", "issn", "order", "invoice", "page", "figure", "section", "part no", "serial", "doi", "build", "ticket")


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _byte(digits: str) -> bool:
    """Whether digits, however many zeros begin them, are 255 at most."""
    short = digits.lstrip("0") or "0"
    return len(short) <= 3 and int(short) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start; matches that fail their check are dropped."""
    out: list[tuple[int, int, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        if found:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, found.end()))
                last = found.end()
        at = text.find("@", max(at + 1, last))
    out.extend((1, m.start(), m.end()) for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split(".")))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out.extend((3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15)
    return out


def further(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the other kinds that overlap no base span and no earlier candidate."""
    found: list[tuple[int, int, int]] = []
    if "at" in text or "AT" in text:
        for m in _HANDLE.finditer(text) if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text else ():
            start = m.start()
            while start > 0 and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((4, start, m.end()))
    for m in _NUMBER.finditer(text):
        found.append((6 if m["ssn"] else 5, m.start(), m.end()))
    found.extend((7, m.start(), m.end()) for m in _IBAN.finditer(text))
    found.sort(key=lambda x: (x[1], x[0]))
    taken = sorted((a, b) for _, a, b in base)
    out, i, last = [], 0, 0
    reach = 0  # the furthest end of base spans that start before
    for kind, a, b in found:
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if a >= reach and a >= last:
            out.append((kind, a, b))
            last = b
    return out


def _iban(value: str) -> bool:
    flat = value.replace(" ", "")
    if not 15 <= len(flat) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def votes(kind: int, text: str, start: int, end: int) -> int:
    """The labelers' votes on a candidate as one number in base 3 (each vote plus 1)."""
    name, value = KINDS[kind], text[start:end]
    digits = _digits(value)
    pattern = 1 if kind < len(BASE) or name in ("ssn", "iban") else 0
    check = gazetteer = 0
    if name in ("email", "handle"):
        parts = re.split(r"[^A-Za-z0-9]+", value.lower())
        check = 1 if parts[-1].isalpha() and len(parts[-1]) >= 2 else -1
        gazetteer = -1 if parts[0] in ROLES else 1 if parts[-1] in DOMAINS or not NAMES.isdisjoint(parts) else 0
    elif name == "ip":
        parts = value.split(".")
        check = -1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
        gazetteer = -1 if value.startswith(UNROUTED) else 0
    elif name == "card":
        check, gazetteer = 1, 1 if any(a <= digits[: len(a)] <= b for a, b in ISSUERS) else -1
    elif name == "phone":
        check, gazetteer = 1, 1 if digits.startswith(CALLING) else -1
    elif name == "local":
        check = 1 if digits[0] not in "01" and digits[3] not in "01" else -1
        gazetteer = 1 if value[0] == "(" else 0
    elif name == "ssn":
        check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    else:
        check = 1 if _iban(value) else -1
        length = IBAN_LENGTHS.get(value[:2])
        gazetteer = 0 if length is None else 1 if length == len(value.replace(" ", "")) else -1
    before = text[max(0, start - CONTEXT) : start].lower()
    context = 1 if any(w in before for w in FOR[name]) else -1 if any(w in before for w in AGAINST) else 0
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    touch = -1 if left.isalnum() or right.isalnum() or left in ("_", "/", "=") and left or right == "_" else 1
    variety = 1 if len(set(value if name in ("email", "handle", "iban") else digits)) >= 4 else -1
    code = 0
    for v in (pattern, check, gazetteer, context, touch, variety):
        code = code * 3 + v + 1
    return code


_WORD = re.compile(r"[^\W\d_]+|\d+")


def features(kind: int, text: str, start: int, end: int, code: int) -> list[int]:
    """The classifier's hashed features of a span and its surroundings: distinct weights' numbers."""
    check = code // 3 ** (len(LABELERS) - 2) % 3
    value = text[start : min(end, start + 80)]
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", value))[:40]
    before = _WORD.findall(text[max(0, start - CONTEXT) : start].lower())
    behind = _WORD.search(text, end, end + CONTEXT)
    said = (
        f"kind {kind} {check}", f"shape {kind} {shape}", f"length {kind} {min(end - start, 64) // 4}", f"left {kind} {text[start - 1 : start] if start else ''}",
        f"right {kind} {text[end : end + 1]}", f"before {before[-1] if before else ''}", f"second {before[-2] if len(before) > 1 else ''}", f"behind {behind[0].lower() if behind else ''}",
    )
    return sorted({zlib.crc32(x.encode("utf-8", "replace")) % WIDTH for x in said})


def spans(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, code) of all candidates, base spans first, each part by kind and start."""
    base = base_spans(text)
    more = sorted(further(text, base))
    return [(k, a, b, votes(k, text, a, b)) for k, a, b in [*base, *more]]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("code", pa.int32()), ("feats", pa.list_(pa.int32()))]))
    names = ("kind", "start", "end", "code", "feats")
    for batch in batches:
        for ids, texts in slices(batch):
            found = [[dict(zip(names, (*s, features(s[0], t, *s[1:])), strict=True)) for s in spans(t)] for t in (x.decode() for x in texts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, kind)], names=["doc_id", "spans"])


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): all candidates of each row with their votes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: tidied(_spans(it)), f"doc_id long, spans {SPANS}")


def unpack(code: np.ndarray) -> np.ndarray:
    """Votes plus 1 (0, 1, 2) by labeler."""
    return np.stack([code // 3 ** (len(LABELERS) - 1 - i) % 3 for i in range(len(LABELERS))], axis=1)


def reliabilities(kinds: np.ndarray, codes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM: each row's posterior of being personal data, and P(vote | class) as (labelers, 3, 2).

    Starts from the sum of the votes; the counts start from ``BELIEF``, so that a labeler is
    taken for better than chance until the candidates say otherwise.
    """
    v = unpack(codes)
    post = 1 / (1 + np.exp(-1.0 * (v - 1).sum(axis=1)))
    table_ = np.zeros((len(LABELERS), 3, 2))
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post], axis=1)
        for j in range(len(LABELERS)):
            for k in range(3):
                table_[j, k] = w[v[:, j] == k].sum(axis=0) + BELIEF[k]
            table_[j] /= table_[j].sum(axis=0)
        prior = np.ones((len(KINDS), 2))
        np.add.at(prior, kinds, w)
        prior /= prior.sum(axis=1, keepdims=True)
        logs = np.log(prior[kinds]) + sum(np.log(table_[j, v[:, j]]) for j in range(len(LABELERS)))
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
    return post, table_


def _logit(weights: np.ndarray, feats: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The classifier's score of spans, whose features (one at least) lie flat from offset to offset."""
    return np.add.reduceat(weights[feats], offsets[:-1]) if len(offsets) > 1 else np.zeros(0)


def _yes(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def classifier(feats: list[list[int]], post: np.ndarray, ridge: float = 1e-3, rounds: int = 300, rate: float = 0.3) -> np.ndarray:
    """Weights of the logistic classifier, fitted to the posteriors by adaptive gradient steps over all given spans."""
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in feats]))).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *map(np.asarray, feats)]).astype(np.int64)
    row = np.repeat(np.arange(len(feats)), np.diff(offsets))
    weights, seen = np.zeros(WIDTH), np.full(WIDTH, 1e-8)
    for _ in range(rounds):
        miss = _yes(_logit(weights, flat, offsets)) - post
        grad = np.bincount(flat, miss[row], WIDTH) / max(1, len(feats)) + ridge * weights
        seen += grad * grad
        weights -= rate * grad / np.sqrt(seen)
    return weights


def trained(found: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The classifier of a table of ``candidates``: expectation maximisation over all of them, then the fit to a sample of each kind."""
    one = found.select(F.col("doc_id"), F.explode("spans").alias("s")).select("doc_id", "s.*")
    got = one.groupBy("kind", "code").agg(F.count("*").alias("n")).orderBy("kind", "code").toPandas()
    if got.empty:
        return np.zeros(WIDTH)
    kinds, codes, n = (got[c].to_numpy() for c in ("kind", "code", "n"))
    post, _ = reliabilities(kinds, codes, n.astype(float))
    known = dict(zip(zip(kinds.tolist(), codes.tolist(), strict=True), post.tolist(), strict=True))
    total = np.bincount(kinds, n, len(KINDS))
    share = F.element_at(F.array(*[F.lit(int(min(1.0, sample / max(t, 1)) * (1 << 40))) for t in total]), F.col("kind") + 1)
    h = F.xxhash64("doc_id", "kind", "start", "feats")
    some = one.where(F.pmod(h, F.lit(1 << 40)) < share).select("kind", "code", "feats", h.alias("h")).orderBy("kind", "code", "h", "feats").collect()
    labels = np.array([known[r["kind"], r["code"]] for r in some])
    return classifier([r["feats"] for r in some], labels)


def _stays(weights: np.ndarray, spans_: pa.StructArray) -> np.ndarray:
    """Whether each span is a base span or taken by the classifier."""
    feats = spans_.field("feats")
    offsets = feats.offsets.to_numpy()
    score = _yes(_logit(weights, feats.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]))
    return (spans_.field("kind").to_numpy(zero_copy_only=False) < len(BASE)) | (score >= KEEP_FROM)


def _kept(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        flat, offsets = column.flatten(), column.offsets.to_numpy()
        stays = _stays(weights, flat)
        to = np.concatenate(([0], np.cumsum(stays)))[offsets - offsets[0]]
        lists = pa.ListArray.from_arrays(pa.array(to, pa.int32()), flat.filter(pa.array(stays)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=batch.schema.names)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): array of kind (name), start, end, by kind as listed, then start."""
    found = written(candidates(docs), "pii")
    held = docs.sparkSession.sparkContext.broadcast(trained(found))
    kept = found.mapInArrow(lambda it: tidied(_kept(it, held.value)), found.schema)
    names = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform("spans", lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return kept.select("doc_id", named.alias("spans"))


def masked(text: str, weights: np.ndarray) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become one, under the first one's kind."""
    out, last = [], 0
    for a, b, k, code in sorted((a, b, k, code) for k, a, b, code in spans(text)):
        if k >= len(BASE):
            some = np.array(features(k, text, a, b, code))
            if _yes(_logit(weights, some, np.array([0, len(some)])))[0] < KEEP_FROM:
                continue
        if a >= last:
            out += [text[last:a], f"<{KINDS[k].upper()}>"]
            last = b
        elif b > last:
            last = b
    return "".join([*out, text[last:]])


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; nothing else changes (a null text stays null).

    Two passes over the texts instead of a join with them: the first one counts votes.
    """
    found = written(candidates(docs), "pii")
    held = docs.sparkSession.sparkContext.broadcast(trained(found))
    released(found)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, at):
            cols = list(batch.columns)
            cols[at] = pa.array([None if t is None else masked(t, held.value) for t in batch.column(at).to_pylist()], batch.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(lambda it: tidied(run(it)), docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: the base spans' counts and digest, and all spans."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
