"""The corpus operators' registered queries."""

from tidewater.llm import oracles
from tidewater.llm.decontaminate import op7_decontaminate
from tidewater.llm.hnsw import op5_embedding_dedup
from tidewater.llm.minhash import op1_minhash_dedup
from tidewater.llm.packing import op6_best_fit_pack
from tidewater.llm.pii import op3_pii
from tidewater.llm.quality import op8_quality
from tidewater.llm.sharding import op9_compact_shards
from tidewater.llm.substring import op2_substring_dedup
from tidewater.llm.tokenfiles import op4_token_files
from tidewater.llm.warc import op10_warc

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_pii": op3_pii,
    "op8_quality": op8_quality,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_best_fit_pack": op6_best_fit_pack,
    "op7_decontaminate": op7_decontaminate,
    "op4_token_files": op4_token_files,
    "op9_compact_shards": op9_compact_shards,
    "op10_warc": op10_warc,
}

#: The others rest on trained models or a tokenizer; tests hold them against brute force and held-out labels.
ORACLE_SQL = {
    "op1_minhash_dedup": oracles.MINHASH,
    "op2_substring_dedup": oracles.SUBSTRING,
    "op5_embedding_dedup": oracles.EMBEDDINGS,
    "op7_decontaminate": oracles.DECONTAMINATE,
    "op9_compact_shards": oracles.SHARDING,
    "op10_warc": oracles.WARC,
}
