"""The registered queries of this subpackage and their DuckDB texts."""

from . import clusters, decontaminate, language, lm, packing, periods, quality, secrets, simhash, suffixes, topk, urls, warc

QUERIES = {
    "op1_suffix_dedup": suffixes.op1_suffix_dedup,
    "op2_quality": quality.op2_quality,
    "op3_url_filter": urls.op3_url_filter,
    "op4_simhash": simhash.op4_simhash,
    "op5_secrets": secrets.op5_secrets,
    "op6_warc": warc.op6_warc,
    "op7_norm_topk": topk.op7_norm_topk,
    "op8_lm": lm.op8_lm,
    "op9_packing": packing.op9_packing,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_runs": periods.op11_runs,
    "op12_clusters": clusters.op12_clusters,
    "op13_language": language.op13_language,
}

SQL = {
    "op1_suffix_dedup": suffixes.SQL,
    "op3_url_filter": urls.SQL,
    "op5_secrets": secrets.SQL,
    "op6_warc": warc.SQL,
    "op7_norm_topk": topk.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op12_clusters": clusters.SQL,
}
