"""Settings files as tables: font roles, symbol replacements, corrections."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The replacements where no file gives others.
CHINESE_NUMERALS = "一二三四五六七八九十"


def font_roles(files: DataFrame, column: str) -> DataFrame:
    """A row for each font of a file's JSON that has a role or a style given by other than an old file: font, role, docx_style, mapped_by, and the other columns.

    A value that is a text is an old sample and gives nothing; JSON that cannot be read gives no fonts.
    """
    rest = [c for c in files.columns if c != column]
    rows = files.select(*rest, F.explode(F.from_json(column, "map<string,string>")).alias("font", "value"))
    get = lambda k: F.get_json_object("value", f"$.{k}").alias(k)
    rows = rows.filter(F.col("value").startswith("{")).select(*rest, "font", get("role"), get("docx_style"), get("mapped_by"))
    given = (F.coalesce("role", F.lit("")) != "") | (F.coalesce("docx_style", F.lit("")) != "")
    return rows.filter(given & (F.coalesce("mapped_by", F.lit("")) != "legacy"))


def style_mapping(fonts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The style for each key of a style map (keys, key, style): that of the first font, by order, that names it."""
    from ..functions.rules import style_key

    rows = fonts.filter(F.coalesce("docx_style", F.lit("")) != "").withColumn("key", style_key(F.col("role"), F.col("docx_style"))).filter("key is not null")
    return rows.groupBy(*keys, "key").agg(F.min_by("docx_style", order).alias("style"))


def default_symbols() -> list[tuple[str, str, str]]:
    circled = [("circled_numbers", str(i), chr(0x245F + i)) for i in range(1, 21)]
    return circled + [("chinese_numerals", n, f"（{n}）") for n in CHINESE_NUMERALS] + [("numeric_range_tilde", "~", "～")]


def _read(spark: SparkSession, path: str):
    """A JSON file through Spark, so that any store will do; None where there is none or it cannot be read."""
    try:
        return json.loads(spark.read.option("wholetext", True).text(path).first()[0])
    except Exception as e:  # a missing path is an AnalysisException, bad JSON a ValueError
        if "PATH_NOT_FOUND" in str(e) or isinstance(e, (ValueError, TypeError)):
            return None
        raise


def symbol_map(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(kind, symbol, replacement) of a file of replacements; the defaults where there is none."""
    found = _read(spark, path) if path else None
    if found is None:
        rows = default_symbols()
    else:
        rows = [(k, s, r) for k, v in found.items() for s, r in (v.items() if isinstance(v, dict) else [("~", v)])]
    return spark.createDataFrame(rows, "kind string, symbol string, replacement string")


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """(wrong, right) of a correction dictionary; empty where there is none."""
    found = _read(spark, path) or {}
    return spark.createDataFrame([(str(k), str(v)) for k, v in found.items()], "wrong string, right string")
