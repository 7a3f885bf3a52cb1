"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from factorspark.llm import bpe, chat, forest, mih, minhash, packing, quality, substring, toxicity, warc
from factorspark.llm.common import settled

QUERIES = {
    "op1_forest": settled(forest.op1_forest),
    "op2_chat_format": chat.op2_chat_format,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_hamming_top_k": settled(mih.op4_hamming_top_k),
    "op5_near_duplicates": settled(minhash.op5_near_duplicates),
    "op6_pack": settled(packing.op6_pack),
    "op7_warc": settled(warc.op7_warc),
    "op8_quality": quality.op8_quality,
    "op9_toxicity": settled(toxicity.op9_toxicity),
    "op10_substring_dedup": settled(substring.op10_substring_dedup),
}
ORACLES = {
    "op2_chat_format": chat.ORACLE,
    "op4_hamming_top_k": mih.ORACLE,
    "op5_near_duplicates": minhash.ORACLE,
    "op7_warc": warc.ORACLE,
    "op10_substring_dedup": substring.ORACLE,
}
