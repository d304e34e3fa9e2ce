"""The queries of this subpackage, by name."""

from __future__ import annotations

from folioscope.llm import bpe, decontaminate, language, licenses, quality, sharding, simhash, substrings, urls, warc


def queries() -> dict:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_simhash": simhash.op2_simhash,
        "op3_substrings": substrings.op3_substrings,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_sharding": sharding.op5_sharding,
        "op6_warc": warc.op6_warc,
        "op7_urls": urls.op7_urls,
        "op8_language": language.op8_language,
        "op9_byte_bpe": bpe.op9_byte_bpe,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": warc.OP6_SQL}
