"""Section trees as JSON and as Markdown folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SECTION = "book string, section_id string, title string, level int, raw_content string, paragraphs array<struct<para_id:string,raw_text:string,custom_style:string,is_deleted:boolean>>"


def write_json(sections: DataFrame, path: str) -> None:
    """One line of JSON for each section."""
    sections.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SECTION).json(path, mode="FAILFAST")


def write_markdown(sections: DataFrame, path: str) -> None:
    """A folder for each book, a file with its sections' contents in it."""
    sections.select("book", F.concat("raw_content", F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy("book").text(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(book, text): files as wholes."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
