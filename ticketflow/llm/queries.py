"""Registry of this subpackage's queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from ticketflow.llm.chat import op7_chat_format
from ticketflow.llm.html_text import op1_html_text
from ticketflow.llm.langid import op2_langid
from ticketflow.llm.mixing import op10_mixing
from ticketflow.llm.near_dup import op5_near_dup
from ticketflow.llm.pieces import op3_sentencepiece
from ticketflow.llm.quality import op9_quality_rules
from ticketflow.llm.secret_scan import op8_secret_scan
from ticketflow.llm.spelling import op12_spelling
from ticketflow.llm.token_counts import op11_token_counts
from ticketflow.llm.topk import op4_topk
from ticketflow.llm.toxicity import op6_toxicity
from ticketflow.llm.vector_codes import op13_vector_codes

REGISTRY = {
    "op1_html_text": op1_html_text,
    "op2_langid": op2_langid,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_topk": op4_topk,
    "op5_near_dup": op5_near_dup,
    "op6_toxicity": op6_toxicity,
    "op7_chat_format": op7_chat_format,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_token_counts": op11_token_counts,
    "op12_spelling": op12_spelling,
    "op13_vector_codes": op13_vector_codes,
}
