"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat_format, conversations, decontaminate, html_extract, licenses, media, passage_dedup, quality, simhash_dedup, spelling, suffix_dedup, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_passage_dedup": passage_dedup.op2_passage_dedup,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_simhash_dedup": simhash_dedup.op5_simhash_dedup,
    "op6_media": media.op6_media,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_bpe": bpe.op8_bpe,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_warc": warc.op10_warc,
    "op11_spelling": spelling.op11_spelling,
    "op12_conversations": conversations.op12_conversations,
    "op13_chat_format": chat_format.op13_chat_format,
}
SQL: dict[str, str] = {
    "op2_passage_dedup": passage_dedup.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op9_suffix_dedup": suffix_dedup.SQL,
    "op10_warc": warc.SQL,
    "op11_spelling": spelling.SQL,
    "op12_conversations": conversations.SQL,
    "op13_chat_format": chat_format.SQL,
}
