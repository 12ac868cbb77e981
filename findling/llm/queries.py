"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from findling.llm import bytepairs, codes, divergence, fluency, licences, minhash, mixing, packing, personal, product, secrets, toxicity, transport

QUERIES = {
    "op1_transport_streams": transport.op1_transport_streams,
    "op2_weak_supervision": personal.op2_weak_supervision,
    "op3_sainte_lague": mixing.op3_sainte_lague,
    "op4_fuzzy_notices": licences.op4_fuzzy_notices,
    "op5_cumulative_link": toxicity.op5_cumulative_link,
    "op6_conditional_field": secrets.op6_conditional_field,
    "op7_bbit_minhash": minhash.op7_bbit_minhash,
    "op8_cutting_stock": packing.op8_cutting_stock,
    "op9_product_quantisation": product.op9_product_quantisation,
    "op10_kneser_ney": fluency.op10_kneser_ney,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_byte_pairs": bytepairs.op12_byte_pairs,
    "op13_vector_codes": codes.op13_vector_codes,
}
SQL = {"op3_sainte_lague": mixing.OP3_SQL, "op11_source_divergence": divergence.OP11_SQL, "op13_vector_codes": codes.OP13_SQL}
