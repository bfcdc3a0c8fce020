"""Queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from .op1_shard import op1_shard
from .op2_syncmers import op2_syncmers
from .op3_near_dedup import op3_near_dedup
from .op4_quality_rules import SQL as op4_quality_rules_sql
from .op4_quality_rules import op4_quality_rules
from .op5_pii import op5_pii
from .op6_pack import op6_pack
from .op7_quality_rulefit import op7_quality_rulefit
from .op8_secrets import op8_secrets
from .op9_katz import op9_katz
from .op10_mix import op10_mix


def queries() -> dict:
    every = (op1_shard, op2_syncmers, op3_near_dedup, op4_quality_rules, op5_pii, op6_pack, op7_quality_rulefit, op8_secrets, op9_katz, op10_mix)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": op4_quality_rules_sql}
