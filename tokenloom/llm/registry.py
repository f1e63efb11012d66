"""The queries of this package and the SQL they are held against."""

from __future__ import annotations

from tokenloom.llm.chunks import op3_chunk_dedup
from tokenloom.llm.decontaminate import OP6_SQL, op6_decontamination
from tokenloom.llm.importance import OP12_SQL, op12_importance_resampling
from tokenloom.llm.katz import op11_lm_scoring
from tokenloom.llm.langid import op10_language_id
from tokenloom.llm.licenses import op2_license_scan
from tokenloom.llm.pieces import op1_sentencepiece
from tokenloom.llm.quality import OP5_SQL, op5_quality_rules
from tokenloom.llm.secrets import op8_secret_scan
from tokenloom.llm.sharding import OP9_SQL, op9_sharding
from tokenloom.llm.simhash import op7_simhash_golay
from tokenloom.llm.suffixes import op4_suffix_dedup
from tokenloom.llm.tries import OP13_SQL, op13_conversation_trie


def queries() -> dict:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_license_scan": op2_license_scan,
        "op3_chunk_dedup": op3_chunk_dedup,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_decontamination": op6_decontamination,
        "op7_simhash_golay": op7_simhash_golay,
        "op8_secret_scan": op8_secret_scan,
        "op9_sharding": op9_sharding,
        "op10_language_id": op10_language_id,
        "op11_lm_scoring": op11_lm_scoring,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": OP5_SQL, "op6_decontamination": OP6_SQL, "op9_sharding": OP9_SQL, "op12_importance_resampling": OP12_SQL, "op13_conversation_trie": OP13_SQL}
