"""Registry of this subpackage's queries and of the SQL that checks them."""

from __future__ import annotations

from corpusq.llm import decontaminate, middle, mixing, negatives, url_filter
from corpusq.llm.decontaminate import op5_decontaminate
from corpusq.llm.language import op9_language
from corpusq.llm.media import op8_media
from corpusq.llm.middle import op11_fill_in_middle
from corpusq.llm.mixing import op10_mixing
from corpusq.llm.negatives import op13_hard_negatives
from corpusq.llm.packing import op12_packing
from corpusq.llm.paragraphs import op2_paragraphs
from corpusq.llm.quality import op6_quality
from corpusq.llm.simhash import op7_simhash
from corpusq.llm.suffixes import op3_suffixes
from corpusq.llm.token_records import op4_token_records
from corpusq.llm.url_filter import op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_paragraphs": op2_paragraphs,
    "op3_suffixes": op3_suffixes,
    "op4_token_records": op4_token_records,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_media": op8_media,
    "op9_language": op9_language,
    "op10_mixing": op10_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_packing": op12_packing,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_fill_in_middle": middle.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
