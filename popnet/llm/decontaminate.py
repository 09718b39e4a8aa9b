"""Benchmark decontamination (operator 13, DataFrame functions only).

Texts are lower-cased (A-Z only) and cut into words: runs of ASCII letters and digits and of
characters beyond ASCII.  A benchmark item's windows are its runs of ``size`` words; an item
of fewer words, but not none, is one window.  A document word inside any occurrence of a
window is hit.

The windows' first words (up to ``LEAD``) are hashed into a set of ``2 ** BITS`` places at
most, whatever the benchmark's size, which is broadcast.  Every window start of a document is
looked up in it where it is made, in generated code; the few that are in the set are
verified by a join on the windows' whole texts, which are broadcast only while their counted
bytes are at most ``BROADCAST_BYTES`` (else Spark joins them by a shuffle).  A larger
benchmark makes the set fuller, so more starts go to the join; results are the same.

One row per document comes out of the verification: its number of words, its hit words and
its windows, at most one a word.  Items are joined to the windows of documents that have any,
so an item that many windows or documents share is spread over them.

Defined results: null and empty texts, and texts without a word, have no words and no hits;
an item without words has no window; repeated rows, ids and items are rows of their own
(an item's id counts once); null item ids take no part in the list of ids, their windows do in the hits; an empty
benchmark hits nothing; texts of any length are read whole; other columns are kept, whatever
their names (but those that begin with __dec_, which raise ValueError).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from popnet.llm.shared import table, written

SIZE = 10
#: Words that the set is keyed by, at most.
LEAD = 3
BITS = 20
BROADCAST_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case; a text of ASCII alone by the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The normalised words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(lowered(text), F.lit("")), BETWEEN), "")


def _place(w: Column, at: Column, lead: int) -> Column:
    """The place in the set of the ``lead`` words of ``w`` from ``at`` (from 0) on."""
    return F.xxhash64(*[F.get(w, at + j) for j in range(lead)]).bitwiseAND(F.lit((1 << BITS) - 1))


def windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(gram, n, lead, place, item): each window of each item once, with the number of its first words and their place in the set."""
    cut = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    cut = cut.withColumn("n", F.least(F.size("w"), F.lit(size)))
    starts = cut.select("item", "w", "n", F.least("n", F.lit(LEAD)).alias("lead"), F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("at"))
    place = F.lit(None).cast("long")
    for lead in range(1, LEAD + 1):
        place = F.when(F.col("lead") == lead, _place(F.col("w"), F.col("at"), lead)).otherwise(place)
    return starts.select(F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("gram"), "n", "lead", place.alias("place"), "item").distinct()


def candidates(cut: DataFrame, grams: DataFrame) -> DataFrame:
    """The rows of ``cut`` (__dec_w and others), each with __dec_n, its number of words, and a window start in the set as __dec_at, __dec_size and __dec_gram.

    Starts are from 0.  A row without any comes once, with null in their place.  ``grams`` is
    (gram, n, lead, place).  Starts that aren't in the set go where they are made, but for
    each row's first.
    """
    sizes = sorted(r["n"] for r in grams.select("n").distinct().collect())  # at most ``size`` numbers
    rows = cut.select("*", F.size("__dec_w").alias("__dec_n"), F.posexplode_outer("__dec_w").alias("__dec_at", "__dec_x")).drop("__dec_x")
    hit = {lead: f"__dec_hit{lead}" for lead in sorted({min(n, LEAD) for n in sizes})}
    for lead, name in hit.items():
        known = grams.where(F.col("lead") == lead).select(F.col("place").alias(name)).distinct()  # 2 ** BITS numbers at most
        rows = rows.join(F.broadcast(known), _place(F.col("__dec_w"), F.col("__dec_at"), lead) == F.col(name), "left")
    some = F.coalesce(F.col("__dec_at") == 0, F.lit(True))
    for name in hit.values():
        some |= F.col(name).isNotNull()
    gram = lambda n: F.array_join(F.slice("__dec_w", F.col("__dec_at") + 1, F.lit(n)), " ")
    fits = lambda n: F.col(hit[min(n, LEAD)]).isNotNull() & (F.col("__dec_at") + n <= F.col("__dec_n"))
    each = [F.when(fits(n), F.struct(F.lit(n).alias("n"), gram(n).alias("gram"))) for n in sizes]
    met = F.array(*each) if each else F.array().cast("array<struct<n:int,gram:string>>")
    kept = [c for c in rows.columns if c not in (*hit.values(), "__dec_w")]
    rows = rows.where(some).select(*kept, met.alias("__dec_m"))  # the words stay behind
    rows = rows.select(*kept, F.explode_outer("__dec_m").alias("__dec_m"))
    return rows.withColumn("__dec_size", F.col("__dec_m.n")).withColumn("__dec_gram", F.col("__dec_m.gram")).drop("__dec_m")


def _merged(hits: Column) -> Column:
    """Hits (start, end, ...) in order as spans (start, end) that neither meet nor overlap."""
    one = "struct<start:int,end:int>"
    zero = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.lit(None).cast(one).alias("last"))
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    closed = lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"])))
    longer = lambda s, x: F.struct(s["done"].alias("done"), span(s["last"]["start"], F.greatest(s["last"]["end"], x["end"])).alias("last"))
    step = lambda s, x: F.when(x["start"] <= s["last"]["end"], longer(s, x)).otherwise(F.struct(closed(s).alias("done"), span(x["start"], x["end"]).alias("last")))
    return F.aggregate(hits, zero, step, closed)


def scan(docs: DataFrame, items: DataFrame, keep: list[str], size: int = SIZE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each of ``docs``: the columns ``keep``, n_words, n_hit, spans (array of start, end: words from 0, end exclusive, in order, apart from each other) and items (array of ids, sorted)."""
    _checked(docs)
    found = written(windows(items, size, item_id, item_text), "windows")
    grams = found.select("gram", "n", "lead", "place").distinct()
    kept = [F.col(c).alias(f"__dec_k{i}") for i, c in enumerate(keep)]
    cut = docs.select(*kept, words(F.col(text_col)).alias("__dec_w"), F.monotonically_increasing_id().alias("__dec_row"))
    named = grams.select(F.col("gram").alias("__dec_known"))
    if grams.agg(F.coalesce(F.sum(F.octet_length("gram") + 64), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        named = F.broadcast(named)
    met = candidates(cut, grams).join(named, F.col("__dec_gram") == F.col("__dec_known"), "left")
    end = F.col("__dec_at") + F.col("__dec_size")
    span = F.when(F.col("__dec_known").isNotNull(), F.struct(F.col("__dec_at").alias("start"), end.alias("end"), F.col("__dec_gram").alias("gram")))
    keys = [f"__dec_k{i}" for i in range(len(keep))]
    one = met.groupBy("__dec_row").agg(*[F.first(c).alias(c) for c in keys], F.first("__dec_n").alias("n"), F.array_sort(F.collect_list(span)).alias("hits"))
    one = written(one, "contaminated")  # rows keep their number from here on
    at_items = one.select("__dec_row", F.explode(F.array_distinct(F.transform("hits", lambda h: h["gram"]))).alias("gram"))
    listed = at_items.join(found.where("item is not null").select("gram", "item"), "gram").select("__dec_row", "item").distinct()
    listed = listed.groupBy("__dec_row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = one.join(listed, "__dec_row", "left").withColumn("spans", _merged(F.col("hits")))
    none = F.array().cast("array<string>")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select(*[F.col(f"__dec_k{i}").alias(c) for i, c in enumerate(keep)], F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), "spans", F.coalesce("items", none).alias("items"))


def _checked(docs: DataFrame) -> None:
    taken = [c for c in docs.columns if c.startswith("__dec_")]
    if taken:
        raise ValueError(f"columns that begin with __dec_ are used here: {taken}")


def decontaminated(docs: DataFrame, items: DataFrame, whole: bool = False, size: int = SIZE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without hit words and what stands between them, or (``whole``) without the documents that have any.

    Hits depend on the text alone, so they are found once for each contaminated text and
    brought back by its digest: only contaminated texts are joined.
    """
    _checked(docs)
    keyed = docs.withColumn("__dec_key", F.sha2(text_col, 256))
    texts = keyed.select(F.col("__dec_key").alias("key"), F.col(text_col).alias("text")).where("text is not null")
    hits = scan(texts, items, ["key"], size, "text", item_id, item_text).where("n_hit > 0").groupBy("key").agg(F.first("spans").alias("__dec_spans"))
    hits = written(hits, "hits").withColumnRenamed("key", "__dec_key")
    if whole:
        return keyed.join(hits.select("__dec_key"), "__dec_key", "left_anti").select(*docs.columns)
    joined = keyed.join(hits, "__dec_key", "left").withColumn("__dec_pieces", F.when(F.col("__dec_spans").isNotNull(), F.regexp_extract_all(text_col, F.lit(f"{_GAP}*{_WORD}+"), F.lit(0))))
    rest = _without(F.col(text_col), F.col("__dec_pieces"), F.col("__dec_spans"))
    return joined.withColumn(text_col, F.when(F.col("__dec_spans").isNotNull(), rest).otherwise(F.col(text_col))).select(*docs.columns)


_WORD, _GAP = r"[0-9A-Za-z[^\x00-\x7F]]", r"[\x00-\x7F&&[^0-9A-Za-z]]"


def _without(text: Column, pieces: Column, spans: Column) -> Column:
    """A text without the words of ``spans`` and what stands between them; a piece is a word with what stands before it."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.size(pieces)))
    before = lambda at: F.coalesce(F.regexp_extract(F.get(pieces, at), f"^{_GAP}+", 0), F.lit(""))
    kept = F.zip_with(ends, starts, lambda a, b: F.concat(F.array_join(F.slice(pieces, a + 1, b - a), ""), before(b)))
    return F.concat(F.array_join(kept, ""), F.regexp_extract(text, f"{_GAP}*$", 0))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's hits by the benchmark's windows of ten words."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The same by all windows of all documents.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM grams
), met AS (
  SELECT d.r, i, s.n, g.item_id FROM d CROSS JOIN sizes s CROSS JOIN unnest(range(1, len(d.w) - s.n + 2)) t(i)
  JOIN grams g ON g.n = s.n AND g.gram = array_to_string(d.w[i:i + s.n - 1], ' ')
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM met, unnest(range(i, i + n)) t(p) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h USING (r) LEFT JOIN named i USING (r)
"""
