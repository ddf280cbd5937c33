"""Queries of the llm operators and the SQL of those that SQL can express."""

from __future__ import annotations

from .conversations import op13_conversations
from .decontaminate import op4_decontaminate
from .embeddings import OP3_SQL, op3_embeddings
from .language import op10_language
from .licenses import op1_licenses
from .mixing import op2_mix
from .ngram_join import op9_ngram_join
from .quality import op5_quality
from .runs import op11_runs
from .sharding import op7_shard
from .substrings import OP6_SQL, op6_substrings
from .tokens import op8_tokens
from .urlrules import OP12_SQL, op12_urls

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_mix": op2_mix,
    "op3_embeddings": op3_embeddings,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_substrings": op6_substrings,
    "op7_shard": op7_shard,
    "op8_tokens": op8_tokens,
    "op9_ngram_join": op9_ngram_join,
    "op10_language": op10_language,
    "op11_runs": op11_runs,
    "op12_urls": op12_urls,
    "op13_conversations": op13_conversations,
}
ORACLES = {
    "op3_embeddings": OP3_SQL,
    "op6_substrings": OP6_SQL,
    "op12_urls": OP12_SQL,
}
