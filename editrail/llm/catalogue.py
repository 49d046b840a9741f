"""Named queries of the llm operators and their SQL checks."""

from __future__ import annotations

from editrail.llm import canon, components, languages, neardup, packing, textform, tokenize


def queries() -> dict:
    return {"p2_found": neardup.p2_found, "p3_found": components.p3_found, "p4_found": canon.p4_found, "p5_found": textform.p5_found, "p6_ids": tokenize.p6_ids, "p7_containers": packing.p7_containers, "p8_found": languages.p8_found, "p8_languages": languages.p8_languages}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": neardup.P2_SQL, "p3_found": components.P3_SQL, "p5_found": textform.P5_SQL}
