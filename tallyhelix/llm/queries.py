"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, bpe, divergence, linededup, media, mixing, ngram, quality, sharding, tokenfile, toxicity, urlfilter, vectorcode

QUERIES = {
    "op1_lines": linededup.op1_lines,
    "op2_jpeg": media.op2_jpeg,
    "op3_jaccard": ngram.op3_jaccard,
    "op4_urls": urlfilter.op4_urls,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_tokens": tokenfile.op6_tokens,
    "op7_mix": mixing.op7_mix,
    "op8_shard": sharding.op8_shard,
    "op9_bpe": bpe.op9_bpe,
    "op10_ann": ann.op10_ann,
    "op11_quality": quality.op11_quality,
    "op12_codes": vectorcode.op12_codes,
    "op13_divergence": divergence.op13_divergence,
}

SQL = {
    "op4_urls": urlfilter.op4_sql(),
    "op7_mix": mixing.OP7_SQL,
    "op12_codes": vectorcode.op12_sql(),
    "op13_divergence": divergence.OP13_SQL,
}
