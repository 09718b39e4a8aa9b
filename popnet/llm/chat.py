"""Chat formatting from typed content parts (operator 7, DataFrame functions only).

A turn is a row (conversation, turn, role, parts); a part is ``struct<type string, text
string, ref string, tokens long>`` with type text, image, audio or document.  The visitor
flattens the parts in order: text is escaped; any other part becomes a placeholder
``<|type:k|>``, k counting the turn's attachments from 0, and its reference and expanded
token count are recorded in ``attachments``.

Template: ``<|start|>role<|text|>body<|end|>`` for each turn.  Escaping is reversible: a
backslash is doubled, and a backslash goes behind the first character of each control
string (``<|`` of this template; ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``,
``<</SYS>>`` of other public ones), so no control string is left in a text.

Turns are ordered by turn (nulls first), ties by role and content, and repeated rows stay
as turns.  A conversation becomes one row, so its turns meet in one task; that row is the
operator's result.  Null text and null parts are empty; a null role is the empty role; a
null conversation id is a conversation of its own; an empty table gives an empty table;
texts of any length are formatted whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from popnet.llm.shared import table

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: Roles whose text is under the loss mask.
LEARNED = ("assistant",)
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    """Reversible: no control string is left."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])", r"$0\\")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A turn's parts when it has a text alone."""
    none = F.lit(None)
    return F.array(
        F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("tokens"))
    )


def format_chats(turns: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, parts).

    Returns conv_id, formatted, n_turns, loss_spans (array of start, end in code points,
    end exclusive: the learned roles' bodies), attachments (array of turn_index, part_index,
    type, ref, tokens) and attachment_tokens.
    """
    parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    rows = turns.select(F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    is_text = lambda p: F.coalesce(p["type"] == "text", F.lit(True))
    others = F.filter("parts", lambda p: ~is_text(p))
    # the visitor: text as it is, any other part as the placeholder of its number
    numbered = F.transform(
        "parts",
        lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(
                F.lit("<|"), escape(p["type"]), F.lit(":"),
                F.size(F.filter(F.slice(F.col("parts"), F.lit(1), i), lambda q: ~is_text(q))).cast("string"), F.lit("|>"),
            )
        ),
    )
    plain = F.size("parts") == 1
    body = F.when(plain & is_text(F.col("parts")[0]), escape(F.coalesce(F.col("parts")[0]["text"], F.lit("")))).otherwise(F.array_join(numbered, ""))
    rows = rows.select("conv_id", "turn", "role", body.alias("body"), others.alias("others"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(TEXT))
    piece = F.concat(head, "body", F.lit(END))
    rows = rows.select(
        "conv_id", "turn", "role", "body", "others", piece.alias("piece"), F.length(piece).cast("long").alias("chars"), F.length(head).cast("long").alias("head")
    )
    order = ("turn", "role", "body")
    w = Window.partitionBy("conv_id").orderBy(*order)
    placed = rows.select(
        "conv_id", "piece", "others", "role", F.row_number().over(w).alias("at"),
        (F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars") + F.col("head")).alias("start"),
        F.length("body").cast("long").alias("body_chars"),
    )
    one = F.struct(
        "at", "piece", F.col("role").isin(*learned).alias("learned"), "start", (F.col("start") + F.col("body_chars")).alias("end"), "others"
    )
    got = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    span = F.transform(F.filter("t", lambda x: x["learned"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    attached = F.flatten(
        F.transform(
            "t",
            lambda x: F.transform(
                x["others"],
                lambda p, i: F.struct(
                    (x["at"] - 1).alias("turn_index"), i.alias("part_index"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")
                ),
            ),
        )
    )
    out = got.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), F.size("t").cast("long").alias("n_turns"),
        span.alias("loss_spans"), attached.alias("attachments"),
    )
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + F.coalesce(a["tokens"], F.lit(0)).cast("long"))
    return out.withColumn("attachment_tokens", tokens)


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text, unescaped) and loss (array of texts under the mask), from ``formatted`` alone."""
    ended = F.split("formatted", r"<\|end\|>")
    records = F.slice(ended, F.lit(1), F.size(ended) - 1)

    def turn(record: Column) -> Column:
        role = F.substring_index(record, TEXT, 1)
        text = F.substr(record, F.length(role) + F.lit(len(TEXT) + 1))
        return F.struct(
            unescape(F.substr(role, F.lit(len(START) + 1))).alias("role"), unescape(text).alias("text")
        )

    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return chats.select("conv_id", "formatted", F.transform(records, turn).alias("turns"), masked.alias("loss"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and -1 whose texts are control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = rows.unionByName(probe).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    back = read_back(format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("loss", "")
    return back.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same by plain string aggregation.  Only ``formatted_chars`` needs the template: its
#: marks are 24 characters a turn, and escaping adds one for each backslash and control string.
OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<\||</?s>|<</?SYS>>|\[/?INST\])', '\1_', 'g'))
    + length(regexp_replace(replace(role, '\', '\\'), '(<\||</?s>|<</?SYS>>|\[/?INST\])', '\1_', 'g')) + 24 AS chars
  FROM turns
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
