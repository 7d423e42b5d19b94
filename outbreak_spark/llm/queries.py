"""Queries of the training-data operators, and SQL for those that SQL can express."""

from outbreak_spark.llm.ann import op8_anisotropic_ann
from outbreak_spark.llm.cover_dedup import op9_cover_dedup
from outbreak_spark.llm.filter_audit import OP11_SQL, op11_filter_audit
from outbreak_spark.llm.jaccard import op2_grouped_prefix_join
from outbreak_spark.llm.langid import op1_language_id
from outbreak_spark.llm.lblm import op4_log_bilinear_lm
from outbreak_spark.llm.mixing import op7_pivotal_mix
from outbreak_spark.llm.packing import op5_pack_sum_of_squares
from outbreak_spark.llm.sql import OP2_SQL, OP9_SQL, OP10_SQL
from outbreak_spark.llm.suffix_dedup import op10_suffix_dedup
from outbreak_spark.llm.tag_paths import op12_tag_path_ratios
from outbreak_spark.llm.tokenio import op6_token_files
from outbreak_spark.llm.topk import OP3_SQL, op3_cover_tree_top_k

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_grouped_prefix_join": op2_grouped_prefix_join,
    "op3_cover_tree_top_k": op3_cover_tree_top_k,
    "op4_log_bilinear_lm": op4_log_bilinear_lm,
    "op5_pack_sum_of_squares": op5_pack_sum_of_squares,
    "op6_token_files": op6_token_files,
    "op7_pivotal_mix": op7_pivotal_mix,
    "op8_anisotropic_ann": op8_anisotropic_ann,
    "op9_cover_dedup": op9_cover_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_tag_path_ratios": op12_tag_path_ratios,
}

ORACLE_SQL: dict[str, str] = {"op2_grouped_prefix_join": OP2_SQL, "op3_cover_tree_top_k": OP3_SQL, "op9_cover_dedup": OP9_SQL, "op10_suffix_dedup": OP10_SQL, "op11_filter_audit": OP11_SQL}
