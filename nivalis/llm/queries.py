"""The queries of this subpackage, by name, and their DuckDB equivalents."""

from __future__ import annotations

from nivalis.llm.conversations import op11_prefix_trie
from nivalis.llm.decontaminate import op1_decontaminate
from nivalis.llm.fingerprints import op9_fingerprints
from nivalis.llm.language import op5_language
from nivalis.llm.licenses import op12_licenses
from nivalis.llm.merkle import op13_merkle
from nivalis.llm.mixing import op10_mixing
from nivalis.llm.neardup import op3_jaccard
from nivalis.llm.oracles import ORACLE
from nivalis.llm.phrases import op7_phrases
from nivalis.llm.quality import op4_quality
from nivalis.llm.secrets import op8_secrets
from nivalis.llm.sharding import op6_sharding
from nivalis.llm.suffixes import op2_suffixes

__all__ = ["ORACLE", "QUERIES"]

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_suffixes": op2_suffixes,
    "op3_jaccard": op3_jaccard,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_sharding": op6_sharding,
    "op7_phrases": op7_phrases,
    "op8_secrets": op8_secrets,
    "op9_fingerprints": op9_fingerprints,
    "op10_mixing": op10_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_licenses": op12_licenses,
    "op13_merkle": op13_merkle,
}
