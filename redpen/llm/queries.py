"""The registered queries of this package, one per operator."""

from redpen.llm import alignment, decontaminate, divergence, jaccard_join, lines, minhash, mixing, quality, secret_scan, substring, token_files, toxicity, warc

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_query,
    "op2_warc": warc.op2_query,
    "op3_mixing": mixing.op3_query,
    "op4_substring": substring.op4_query,
    "op5_secrets": secret_scan.op5_query,
    "op6_toxicity": toxicity.op6_query,
    "op7_decontaminate": decontaminate.op7_query,
    "op8_tokens": token_files.op8_query,
    "op9_lines": lines.op9_query,
    "op10_quality": quality.op10_query,
    "op11_alignment": alignment.op11_query,
    "op12_minhash": minhash.op12_query,
    "op13_divergence": divergence.op13_query,
}
