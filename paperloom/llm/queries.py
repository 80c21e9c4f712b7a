"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bitpack, chat, decontaminate, fim, kdtree, langid, lexicon, passages, quality, simhash, substrings, trie, warc

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_kdtree_topk": kdtree.op2_kdtree_topk,
    "op3_compact_windows": passages.op3_compact_windows,
    "op4_token_bitpack": bitpack.op4_token_bitpack,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_bpe_lexicon": lexicon.op6_bpe_lexicon,
    "op7_simhash": simhash.op7_simhash,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_langid": langid.op9_langid,
    "op10_warc": warc.op10_warc,
    "op11_quality_rff": quality.op11_quality_rff,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
ORACLE_SQL = {
    "op1_chat_format": chat.ORACLE_SQL,
    "op2_kdtree_topk": kdtree.ORACLE_SQL,
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
    "op12_fill_in_middle": fim.ORACLE_SQL,
    "op13_prefix_trie": trie.ORACLE_SQL,
}
