"""Registered queries of the ten operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP5_SQL, op5_decontamination
from .license_scan import op7_license_scan
from .near_dups import op10_simhash_near_dedup
from .packing import op1_packing
from .pii import op8_pii
from .quality_rules import op3_quality_rules
from .sharding import op9_sharding
from .token_output import op2_token_output
from .toxicity import op6_toxicity
from .url_reputation import OP4_SQL, op4_url_reputation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_token_output,
        op3_quality_rules,
        op4_url_reputation,
        op5_decontamination,
        op6_toxicity,
        op7_license_scan,
        op8_pii,
        op9_sharding,
        op10_simhash_near_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {"op4_url_reputation": OP4_SQL, "op5_decontamination": OP5_SQL}
