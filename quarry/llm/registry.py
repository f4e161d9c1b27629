"""The queries of this subpackage and their SQL."""

from . import audit, collocations, fingerprint, language_id, mixing, neighbours, packing, pieces, quality, sharding, simhash, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_simhash": simhash.op3_simhash,
    "op4_sharding": sharding.op4_sharding,
    "op5_language_id": language_id.op5_language_id,
    "op6_warc": warc.op6_warc,
    "op7_mixing": mixing.op7_mixing,
    "op8_packing": packing.op8_packing,
    "op9_fingerprint": fingerprint.op9_fingerprint,
    "op10_quality": quality.op10_quality,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_collocations": collocations.op13_collocations,
}
SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op12_filter_audit": audit.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
