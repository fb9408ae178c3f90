"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from . import (
    chat_format,
    decontaminate,
    embedding_dedup,
    html_extract,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    near_dedup,
    periodic_runs,
    pii,
    url_filter,
    vector_codes,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_language_id": language_id.op4_language_id,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_pii": pii.op10_pii,
    "op11_license_scan": license_scan.op11_license_scan,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_chat_format": chat_format.OP2_SQL,
    "op3_html_extract": html_extract.OP3_SQL,
    "op5_mix_sources": mixing.OP5_SQL,
    "op6_embedding_dedup": embedding_dedup.OP6_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op9_near_dedup": near_dedup.OP9_SQL,
    "op12_periodic_runs": periodic_runs.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
