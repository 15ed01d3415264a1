"""The registered queries of this subpackage and their SQL."""

from quantpanel.llm import conversations, decontaminate, exact_dedup, language, license_scan, line_dedup, merkle, secrets, sentencepiece, sharding, simhash, suffix_dedup, toxicity

QUERIES = {
    "op1_sentencepiece": sentencepiece.query,
    "op2_license_scan": license_scan.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_decontamination": decontaminate.query,
    "op6_sharding": sharding.query,
    "op7_line_dedup": line_dedup.query,
    "op8_simhash": simhash.query,
    "op9_toxicity": toxicity.query,
    "op10_language": language.query,
    "op11_secret_scan": secrets.query,
    "op12_conversation_repair": conversations.query,
    "op13_merkle": merkle.query,
}
SQL = {
    "op4_exact_dedup": exact_dedup.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op11_secret_scan": secrets.SQL,
    "op12_conversation_repair": conversations.SQL,
    "op13_merkle": merkle.SQL,
}
