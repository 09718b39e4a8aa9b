"""Operations of a training-data pipeline; nothing else in the library imports this."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The query of each operator."""
    from popnet.llm import ann, bpe, chat, decontaminate, langid, licenses, merkle, mixing, pii, simhash, token_counts, topk, yinyang

    return {
        "op1_ann": ann.op1_ann,
        "op2_pii": pii.op2_pii,
        "op3_bpe": bpe.op3_bpe,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_mixing": mixing.op5_mixing,
        "op6_topk": topk.op6_topk,
        "op7_chat": chat.op7_chat,
        "op8_licenses": licenses.op8_licenses,
        "op9_simhash": simhash.op9_simhash,
        "op10_langid": langid.op10_langid,
        "op11_yinyang": yinyang.op11_yinyang,
        "op12_merkle": merkle.op12_merkle,
        "op13_decontaminate": decontaminate.op13_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express the operator."""
    from popnet.llm import ann, chat, decontaminate, licenses, merkle, topk, yinyang

    return {"op1_ann": ann.OP1_SQL, "op6_topk": topk.OP6_SQL, "op7_chat": chat.OP7_SQL, "op8_licenses": licenses.op8_sql(), "op11_yinyang": yinyang.op11_sql(), "op12_merkle": merkle.OP12_SQL, "op13_decontaminate": decontaminate.OP13_SQL}
