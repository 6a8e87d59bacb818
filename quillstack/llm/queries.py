"""The queries of this package, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm.conversation_trie import OP13_SQL, op13_conversation_trie
from quillstack.llm.jaccard_join import op12_jaccard_join
from quillstack.llm.line_dedup import op9_line_dedup
from quillstack.llm.lz_fingerprint import op6_lz_fingerprints
from quillstack.llm.mixing import OP10_SQL, op10_mixing
from quillstack.llm.pii import op1_personal_data
from quillstack.llm.quality import op7_quality_rules
from quillstack.llm.sentencepiece_codec import op2_sentencepiece
from quillstack.llm.secrets import op5_secret_scan
from quillstack.llm.sharding import OP8_SQL, op8_jump_sharding
from quillstack.llm.simhash import op3_simhash
from quillstack.llm.token_alignment import op11_token_alignment
from quillstack.llm.token_counts import op4_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_personal_data,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_secret_scan": op5_secret_scan,
    "op6_lz_fingerprints": op6_lz_fingerprints,
    "op7_quality_rules": op7_quality_rules,
    "op8_jump_sharding": op8_jump_sharding,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
    "op11_token_alignment": op11_token_alignment,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_conversation_trie": op13_conversation_trie,
}

#: Of the others SQL can't express the method, or is too slow on whole tables; the tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op8_jump_sharding": OP8_SQL, "op10_mixing": OP10_SQL, "op13_conversation_trie": OP13_SQL}
