"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from vecspark.llm import decontaminate, html_extract, license_scan, quality, sentencepiece_codec, simhash, substring, token_output, url_filter, warc


def queries() -> dict:
    return {
        "op1_token_output": token_output.op1_token_output,
        "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
        "op3_simhash": simhash.op3_simhash,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_substring": substring.op5_substring,
        "op6_warc_revisits": warc.op6_warc_revisits,
        "op7_html_extract": html_extract.op7_html_extract,
        "op8_license_scan": license_scan.op8_license_scan,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_quality": quality.op10_quality,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return own | url_filter.SQL | substring.SQL | warc.SQL | license_scan.SQL | quality.SQL
