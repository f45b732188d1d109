"""The queries of this package, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import audit, base, conversations, differencing, gif, html, langid, neardup, packing, pii, ppm, quality, tokens, urls

QUERIES = {f.__name__: f for f in (ppm.op1_ppm_score, packing.op2_best_fit_packing, html.op3_html_text, pii.op4_pii, urls.op5_url_filter, neardup.op6_ngram_jaccard, quality.op7_quality_rules, gif.op8_gif_media, tokens.op9_byte_bpe, langid.op10_language_id, conversations.op11_conversation_repair, audit.op12_filter_audit, differencing.op13_differencing_packing)}
ORACLES: dict[str, str] = {"op5_url_filter": urls.oracle(), "op6_ngram_jaccard": neardup.oracle(), "op11_conversation_repair": conversations.oracle(), "op12_filter_audit": audit.oracle()}
#: Columns of operators that SQL can express.
PART_QUERIES, PART_ORACLES = base.QUERIES, base.ORACLES
