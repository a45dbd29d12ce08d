"""Queries of this subpackage and the SQL that checks them, where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, decontam, errata, jaccard, langid, merkle, minhash, passages, secrets, shard, tokenfile, warc

QUERIES = {
    "op1_language_id": langid.op1,
    "op2_secret_scan": secrets.op2,
    "op3_two_pass_shuffle": shard.op3,
    "op4_prefix_forest": ann.op4,
    "op5_string_tiling": decontam.op5,
    "op6_ranked_ids": tokenfile.op6,
    "op7_chosen_path_join": jaccard.op7,
    "op8_warc": warc.op8,
    "op9_bpe": bpe.op9,
    "op10_compact_windows": passages.op10,
    "op11_errata_trie": errata.op11,
    "op12_minhash_dedup": minhash.op12,
    "op13_merkle_manifest": merkle.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op8_warc": warc.OP8_SQL,
    "op11_errata_trie": errata.OP11_SQL,
    "op12_minhash_dedup": minhash.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
