"""The queries of the operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triagelake.llm.clusters import ORACLE as CLUSTERS_SQL
from triagelake.llm.clusters import op13_clusters
from triagelake.llm.codes import ORACLE as CODES_SQL
from triagelake.llm.codes import op12_codes
from triagelake.llm.jaccard import ORACLE as JACCARD_SQL
from triagelake.llm.jaccard import op1_jaccard
from triagelake.llm.language import op9_language
from triagelake.llm.lines import ORACLE as LINES_SQL
from triagelake.llm.lines import op11_lines
from triagelake.llm.mixing import op2_mixing
from triagelake.llm.neardup import ORACLE as NEARDUP_SQL
from triagelake.llm.neardup import op10_neardup
from triagelake.llm.packing import op8_packing
from triagelake.llm.privacy import op3_privacy
from triagelake.llm.sharding import op6_sharding
from triagelake.llm.substrings import ORACLE as SUBSTRINGS_SQL
from triagelake.llm.substrings import op5_substrings
from triagelake.llm.topk import ORACLE as TOPK_SQL
from triagelake.llm.topk import op7_topk
from triagelake.llm.transducer import op4_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_mixing": op2_mixing,
    "op3_privacy": op3_privacy,
    "op4_token_counts": op4_token_counts,
    "op5_substrings": op5_substrings,
    "op6_sharding": op6_sharding,
    "op7_topk": op7_topk,
    "op8_packing": op8_packing,
    "op9_language": op9_language,
    "op10_neardup": op10_neardup,
    "op11_lines": op11_lines,
    "op12_codes": op12_codes,
    "op13_clusters": op13_clusters,
}
ORACLES: dict[str, str] = {
    "op1_jaccard": JACCARD_SQL,
    "op5_substrings": SUBSTRINGS_SQL,
    "op7_topk": TOPK_SQL,
    "op10_neardup": NEARDUP_SQL,
    "op11_lines": LINES_SQL,
    "op12_codes": CODES_SQL,
    "op13_clusters": CLUSTERS_SQL,
}
