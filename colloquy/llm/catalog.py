"""The queries of this subpackage and the SQL of those that SQL can express."""

from colloquy.llm import (
    decontaminate,
    embedding_dedup,
    html_extract,
    lexical_search,
    licenses,
    lines,
    order_minhash,
    packing,
    pii,
    suffix_runs,
    toxicity,
    url_rules,
    whitening,
)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_licenses": licenses.op3_licenses,
    "op4_url_rules": url_rules.op4_url_rules,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_order_minhash": order_minhash.op6_order_minhash,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_pii": pii.op9_pii,
    "op10_pack": packing.op10_pack,
    "op11_suffix_dedup": suffix_runs.op11_suffix_dedup,
    "op12_ranked_search": lexical_search.op12_ranked_search,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op3_licenses": licenses.ORACLE,
    "op8_line_dedup": lines.ORACLE,
    "op11_suffix_dedup": suffix_runs.ORACLE,
    "op12_ranked_search": lexical_search.ORACLE,
}
