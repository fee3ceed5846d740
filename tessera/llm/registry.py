"""The corpus queries and their SQL."""

from __future__ import annotations

from tessera.llm import balls, bpe, chat, decontaminate, errata, html, minhash, ngram, pieces, quality, sharding, suffix, tokenfile

QUERIES = {
    "op1_kneser_ney": ngram.op1_kneser_ney,
    "op2_tokenfile": tokenfile.op2_tokenfile,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_bpe": bpe.op4_bpe,
    "op5_chat": chat.op5_chat,
    "op6_suffix": suffix.op6_suffix,
    "op7_sharding": sharding.op7_sharding,
    "op8_html": html.op8_html,
    "op9_quality": quality.op9_quality,
    "op10_minhash": minhash.op10_minhash,
    "op11_balls": balls.op11_balls,
    "op12_errata": errata.op12_errata,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}
ORACLE_SQL = {"op7_sharding": sharding.oracle_sql(), "op9_quality": quality.oracle_sql(), "op10_minhash": minhash.oracle_sql(), "op11_balls": balls.oracle_sql(), "op12_errata": errata.oracle_sql()}
