"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from formweave.llm import bpe, decontam, htmltext, lexical, linededup, ngramjoin, quality, resample, sharding, simhash, tokencount, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_ngram_join": ngramjoin.op4_ngram_join,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_token_counts": tokencount.op6_token_counts,
    "op7_warc": warc.op7_warc,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_html_text": htmltext.op9_html_text,
    "op10_sharding": sharding.op10_sharding,
    "op11_simhash": simhash.op11_simhash,
    "op12_lexical": lexical.op12_lexical,
    "op13_resample": resample.op13_resample,
}
ORACLES: dict[str, str] = {
    "op5_quality_rules": quality.OP5_SQL,
    "op7_warc": warc.OP7_SQL,
    "op12_lexical": lexical.OP12_SQL,
}
