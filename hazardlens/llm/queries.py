"""Catalogue of this subpackage: query name -> (spark, sf_dir) -> DataFrame, and DuckDB twins."""

from __future__ import annotations

from . import op1_sentencepiece as o1
from . import op2_secret_scan as o2
from . import op3_minhash_dedup as o3
from . import op4_toxicity as o4
from . import op5_fingerprints as o5
from . import op6_html_extract as o6
from . import op7_substring_dedup as o7
from . import op8_url_filters as o8
from . import op9_source_mixing as o9
from . import op10_ann_search as o10
from . import op11_source_audit as o11
from . import op12_merkle_manifest as o12
from . import op13_warc as o13

QUERIES = {
    "op1_sentencepiece": o1.op1_sentencepiece,
    "op2_secret_scan": o2.op2_secret_scan,
    "op3_minhash_dedup": o3.op3_minhash_dedup,
    "op4_toxicity": o4.op4_toxicity,
    "op5_fingerprints": o5.op5_fingerprints,
    "op6_html_extract": o6.op6_html_extract,
    "op7_substring_dedup": o7.op7_substring_dedup,
    "op8_url_filters": o8.op8_url_filters,
    "op9_source_mixing": o9.op9_source_mixing,
    "op10_ann_search": o10.op10_ann_search,
    "op11_source_audit": o11.op11_source_audit,
    "op12_merkle_manifest": o12.op12_merkle_manifest,
    "op13_warc": o13.op13_warc,
}

# The other queries train models, search lattices or walk graphs; their tests
# hold them against brute force.
ORACLE = {"op3_minhash_dedup": o3.ORACLE_SQL, "op7_substring_dedup": o7.ORACLE_SQL, "op8_url_filters": o8.ORACLE_SQL,
          "op11_source_audit": o11.ORACLE_SQL,
          "op12_merkle_manifest": o12.ORACLE_SQL, "op13_warc": o13.ORACLE_SQL}
