"""The queries of this folder, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import OP5_SQL, op5_winnowing
from .lm_scoring import op6_hierarchical_pitman_yor
from .mixing import OP7_SQL, op7_efraimidis_spirakis
from .near_dedup import OP10_SQL, op10_setsketch
from .quality_model import op1_bradley_terry
from .quality_rules import OP3_SQL, op3_threshold_table
from .sharding import op9_balanced_label_propagation
from .substring_dedup import OP4_SQL, op4_seed_and_extend
from .toxicity import op8_classifier_chain
from .url_filter import OP2_SQL, op2_character_model_ratio

QUERIES = {
    f.__name__: f
    for f in (
        op1_bradley_terry,
        op2_character_model_ratio,
        op3_threshold_table,
        op4_seed_and_extend,
        op5_winnowing,
        op6_hierarchical_pitman_yor,
        op7_efraimidis_spirakis,
        op8_classifier_chain,
        op9_balanced_label_propagation,
        op10_setsketch,
    )
}
SQL = {
    "op2_character_model_ratio": OP2_SQL,
    "op3_threshold_table": OP3_SQL,
    "op4_seed_and_extend": OP4_SQL,
    "op5_winnowing": OP5_SQL,
    "op7_efraimidis_spirakis": OP7_SQL,
    "op10_setsketch": OP10_SQL,
}
