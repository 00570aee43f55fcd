"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

import public_tokenizers

from ..session import table
from .bpe import op6_bpe
from .chat_format import SQL as CHAT_SQL
from .chat_format import op2_format
from .language_id import op12_language
from .mixing import SQL as MIX_SQL
from .mixing import op7_mix
from .near_dedup import op4_near
from .phrases import SQL as PHRASE_SQL
from .phrases import op13_phrases
from .quality import op5_quality
from .suffix_dedup import op1_suffix
from .token_files import op3_tokens
from .topk import SQL as TOPK_SQL
from .topk import op8_topk
from .toxicity import op9_toxic
from .warc import SQL as WARC_SQL
from .warc import op10_warc
from .whitening import op11_whiten

QUERIES = {
    "op1_suffix": lambda spark, d: op1_suffix(table(spark, d, "documents")),
    "op2_format": lambda spark, d: op2_format(table(spark, d, "conversations")),
    "op3_tokens": lambda spark, d: op3_tokens(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json")),
    "op4_near": lambda spark, d: op4_near(table(spark, d, "documents")),
    "op5_quality": lambda spark, d: op5_quality(table(spark, d, "documents")),
    "op6_bpe": lambda spark, d: op6_bpe(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
    "op8_topk": lambda spark, d: op8_topk(table(spark, d, "embeddings")),
    "op9_toxic": lambda spark, d: op9_toxic(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_mix": lambda spark, d: op7_mix(table(spark, d, "documents")),
    "op10_warc": lambda spark, d: op10_warc(table(spark, d, "pages")),
    "op11_whiten": lambda spark, d: op11_whiten(table(spark, d, "embeddings")),
    "op12_language": lambda spark, d: op12_language(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    "op13_phrases": lambda spark, d: op13_phrases(table(spark, d, "documents")),
}
ORACLES = {"op10_warc": WARC_SQL, "op8_topk": TOPK_SQL, "op2_format": CHAT_SQL, "op7_mix": MIX_SQL, "op13_phrases": PHRASE_SQL}
