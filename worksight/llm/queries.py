"""Queries that apply each operator of this subpackage to its whole table, and SQL for their results."""

from worksight.llm.centroid_clustering import op11_centroid_clustering
from worksight.llm.decontamination import OP9_SQL, op9_decontamination
from worksight.llm.importance_sampling import op13_importance_sampling
from worksight.llm.jaccard_join import op1_jaccard_join
from worksight.llm.language_id import op12_language_id
from worksight.llm.line_dedup import OP2_SQL, op2_line_dedup
from worksight.llm.quality_rules import OP4_SQL, op4_quality_rules
from worksight.llm.secret_scan import OP3_SQL, op3_secret_scan
from worksight.llm.sentencepiece_codec import op10_sentencepiece
from worksight.llm.sharding import OP6_SQL, op6_sharding
from worksight.llm.substring_dedup import op5_substring_dedup
from worksight.llm.suffix_dedup import op7_suffix_dedup
from worksight.llm.training_order import op8_training_order

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_sharding": op6_sharding,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_training_order": op8_training_order,
    "op9_decontamination": op9_decontamination,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_language_id": op12_language_id,
    "op13_importance_sampling": op13_importance_sampling,
}
ORACLE_SQL = {
    "op2_line_dedup": OP2_SQL,
    "op3_secret_scan": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
    "op6_sharding": OP6_SQL,
    "op9_decontamination": OP9_SQL,
}
