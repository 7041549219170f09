"""Corpus preparation: ten operators and the queries that apply them to whole tables."""

from __future__ import annotations

from .common import Query


def queries() -> dict[str, Query]:
    from . import decontaminate, exact_dedup, html_main, licences, lm_score, near_join, packing, repeats, toxicity, url_filter

    return {
        "op1_repeats": repeats.op1_repeats,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_html_main": html_main.op3_html_main,
        "op4_packing": packing.op4_packing,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_lm_score": lm_score.op8_lm_score,
        "op9_license_scan": licences.op9_license_scan,
        "op10_near_join": near_join.op10_near_join,
    }


def oracle_sql() -> dict[str, str]:
    from . import exact_dedup, url_filter

    return {"op6_exact_dedup": exact_dedup.SQL, "op7_url_filter": url_filter.SQL}
