"""The queries of this subpackage and the SQL that states the same rows."""

from __future__ import annotations

from . import ann, decontaminate, exactdedup, html, lexical, licences, linededup, lm, neardup, pack, repair, toxicity, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_nearest": ann.op2_nearest,
        "op3_neardup": neardup.op3_neardup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_pack": pack.op6_pack,
        "op7_lm": lm.op7_lm,
        "op8_linededup": linededup.op8_linededup,
        "op9_licences": licences.op9_licences,
        "op10_extract": html.op10_extract,
        "op11_repair": repair.op11_repair,
        "op12_lexical": lexical.op12_lexical,
        "op13_exactdedup": exactdedup.op13_exactdedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.OP1_SQL, "op5_decontaminate": decontaminate.OP5_SQL, "op11_repair": repair.OP11_SQL, "op12_lexical": lexical.OP12_SQL, "op13_exactdedup": exactdedup.OP13_SQL}
