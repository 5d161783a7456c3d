"""The registered queries of this package, and their SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    ball_kmeans,
    collocations,
    decontaminate,
    jaccard,
    langid,
    licences,
    mixing,
    packing,
    passages,
    pii,
    pitman_yor,
    quality,
    toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.query,
        "op2_pack": packing.query,
        "op3_language": langid.query,
        "op4_pii": pii.query,
        "op5_quality": quality.query,
        "op6_toxicity": toxicity.query,
        "op7_pitman_yor": pitman_yor.query,
        "op8_licences": licences.query,
        "op9_jaccard": jaccard.query,
        "op10_passages": passages.query,
        "op11_collocations": collocations.query,
        "op12_mixing": mixing.query,
        "op13_ball_kmeans": ball_kmeans.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": collocations.SQL, "op13_ball_kmeans": ball_kmeans.SQL}
