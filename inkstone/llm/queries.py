"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import fill_middle, license_scan, line_dedup, ngram_join, spelling, substring_dedup, topk
from .embedding_dedup import op1_embedding_dedup
from .fill_middle import op12_fill_middle
from .license_scan import op10_license_scan
from .line_dedup import op7_line_dedup
from .mixing import op9_mixing
from .ngram_join import op6_ngram_jaccard_join
from .packing import op2_packing
from .personal_data import op13_personal_data
from .quality import op4_quality_classifier
from .spelling import op11_spelling_variants
from .substring_dedup import op5_substring_dedup
from .topk import op3_topk
from .url_filter import op8_url_filter

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_packing": op2_packing,
    "op3_topk": op3_topk,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_license_scan": op10_license_scan,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_fill_middle": op12_fill_middle,
    "op13_personal_data": op13_personal_data,
}

ORACLE: dict[str, str] = {
    "op3_topk": topk.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op6_ngram_jaccard_join": ngram_join.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op10_license_scan": license_scan.oracle(),
    "op11_spelling_variants": spelling.ORACLE,
    "op12_fill_middle": fill_middle.ORACLE,
}
