"""The queries of this package and the SQL for those that SQL can express."""

from __future__ import annotations

from kinsift.llm import audio, bpe, credentials, dialogue, exact, language, licenses, mixing, periodic, sharding, simhash, substring, tokenfiles

QUERIES = {
    "op1_audio": audio.op1_audio,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_token_files": tokenfiles.op3_token_files,
    "op4_shuffle_shards": sharding.op4_shuffle_shards,
    "op5_substring": substring.op5_substring,
    "op6_simhash": simhash.op6_simhash,
    "op7_licenses": licenses.op7_licenses,
    "op8_bpe": bpe.op8_bpe,
    "op9_language": language.op9_language,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_conversations": dialogue.op12_conversations,
    "op13_secrets": credentials.op13_secrets,
}

SQL = {"op2_source_mix": mixing.OP2_SQL, "op5_substring": substring.OP5_SQL, "op10_exact_dedup": exact.OP10_SQL}
