"""The registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

from formloom import queries as _all
from formloom import registry

for _m in pkgutil.iter_modules(_all.__path__):
    importlib.import_module(f"{_all.__name__}.{_m.name}")


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> cues -> SRT text per user -> cues again."""
    return registry.QUERIES["subtitle_srt_roundtrip"](spark, sf_dir)
