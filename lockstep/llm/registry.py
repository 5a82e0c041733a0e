"""The operators' queries, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_quotes import OP1_SQL, op1_quotes
from .op2_suffix_dedup import op2_suffix_dedup
from .op3_packing import op3_packing
from .op4_quality import OP4_SQL, op4_quality
from .op5_toxicity import op5_toxicity
from .op6_language import op6_language
from .op7_licenses import op7_licenses
from .op8_decontamination import op8_decontamination
from .op9_lz_dedup import op9_lz_dedup
from .op10_simhash import op10_simhash

OPERATORS = (op1_quotes, op2_suffix_dedup, op3_packing, op4_quality, op5_toxicity, op6_language, op7_licenses, op8_decontamination, op9_lz_dedup, op10_simhash)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}
ORACLES: dict[str, str] = {"op1_quotes": OP1_SQL, "op4_quality": OP4_SQL}
