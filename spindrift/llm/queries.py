"""The queries of this subpackage, with SQL where it can say the same."""

from __future__ import annotations

from . import infill, jaccard, periodic, quality, suffix, warc
from .attention import op12_attention
from .infill import op13_infill
from .jaccard import op3_jaccard
from .language import op4_language
from .media import op8_media
from .mixing import op9_mixing
from .packing import op2_packing
from .periodic import op11_periodic
from .quality import op6_quality
from .suffix import op5_suffix
from .toxicity import op7_toxicity
from .urls import op10_urls
from .warc import op1_warc


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_packing, op3_jaccard, op4_language, op5_suffix, op6_quality, op7_toxicity, op8_media, op9_mixing, op10_urls, op11_periodic, op12_attention, op13_infill)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE, "op3_jaccard": jaccard.ORACLE, "op5_suffix": suffix.ORACLE, "op6_quality": quality.ORACLE, "op11_periodic": periodic.ORACLE, "op13_infill": infill.ORACLE}
