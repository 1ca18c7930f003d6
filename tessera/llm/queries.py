"""The registered queries of the subpackage, and the SQL that checks them."""

from __future__ import annotations

from . import huffman, langid, mixing, packing, prefix_counts, simhash, topk, url_filter, warc, winnowing

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_topk": topk.op2_topk,
    "op3_mixing": mixing.op3_mixing,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_packing": packing.op5_packing,
    "op6_huffman_tokens": huffman.op6_huffman_tokens,
    "op7_warc_revisits": warc.op7_warc_revisits,
    "op8_langid": langid.op8_langid,
    "op9_token_counts": prefix_counts.op9_token_counts,
    "op10_winnowing": winnowing.op10_winnowing,
}
ORACLE_SQL = {"op7_warc_revisits": warc.ORACLE_SQL, "op2_topk": topk.ORACLE_SQL, "op4_url_filter": url_filter.ORACLE_SQL}
