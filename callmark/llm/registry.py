"""The corpus operators' queries, and their DuckDB SQL where SQL can express them."""

from callmark.llm import bpe, licenses, merkle, mixing, neardup, pieces, quality, ranking, secrets, sharding, spelling, topk, warc

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_ball_tree": topk.op2_ball_tree,
    "op3_merkle": merkle.op3_merkle,
    "op4_external_shuffle": sharding.op4_external_shuffle,
    "op5_quality": quality.op5_quality,
    "op6_mix": mixing.op6_mix,
    "op7_hyperminhash": neardup.op7_hyperminhash,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_license_join": licenses.op9_license_join,
    "op10_warc": warc.op10_warc,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_spelling": spelling.op12_spelling,
    "op13_lexical": ranking.op13_lexical,
}
ORACLES = {"op2_ball_tree": topk.ORACLE, "op6_mix": mixing.ORACLE, "op9_license_join": licenses.oracle(), "op10_warc": warc.ORACLE, "op12_spelling": spelling.ORACLE, "op13_lexical": ranking.ORACLE}
