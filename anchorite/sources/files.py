"""Readers and writers of the engine's file formats, as DataFrames over the built-in sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = "SurfaceForm string, Offset int, Length int, ChosenAnnotation string, NumAnnotators int, AnnotatorId string, Annotation string"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; names that start with a dot or end with ~ are skipped, U+FFFD reads as an apostrophe."""
    raw = spark.read.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("path"), "_metadata.file_name", F.col("value").alias("text"))
    return raw.where(~F.col("file_name").rlike(r"^\.|~$")).select("path", F.translate("text", "�", "'").alias("text"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(path, surface, char_start, char_len, title) of gold problem files; the title is null for *null*, values are trimmed."""
    x = spark.read.format("xml").option("rowTag", "ReferenceInstance").schema(GOLD).load(path)
    chosen = F.trim("ChosenAnnotation")
    return x.select(F.col("_metadata.file_path").alias("path"), F.trim("SurfaceForm").alias("surface"), F.col("Offset").alias("char_start"), F.col("Length").alias("char_len"), F.when(chosen != "*null*", F.regexp_extract(chosen, r"([^/]*)$", 1)).alias("title"))


def write_gold(links: DataFrame, path: str, text_name: str = "ReferenceProblem") -> None:
    """Predictions (surface, char_start, char_len, title) as gold problem files."""
    title = F.coalesce("title", F.lit("*null*"))
    links.select(F.col("surface").alias("SurfaceForm"), F.col("char_start").alias("Offset"), F.col("char_len").alias("Length"), title.alias("ChosenAnnotation"), F.lit(1).alias("NumAnnotators"), F.lit("engine").alias("AnnotatorId"), title.alias("Annotation")).write.format("xml").option("rootTag", text_name).option("rowTag", "ReferenceInstance").mode("overwrite").save(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object) of lines of four parts that end in a dot; the last part of an address, or a literal's digits. Comment lines are skipped."""
    part = F.split(F.col("value"), " ")
    last = lambda c: F.regexp_extract(c, r"([^/<>]*)>?$", 1)
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(part.alias("p")).where((F.size("p") == 4) & (F.col("p")[3] == "."))
    literal = F.regexp_extract(F.col("p")[2], r'^"(-?[0-9]+)"', 1)
    return rows.select(last(F.col("p")[0]).alias("subject"), last(F.col("p")[1]).alias("predicate"), F.when(literal != "", literal).otherwise(last(F.col("p")[2])).alias("object"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, title, redirect) of an article dump, plain or compressed by bzip2."""
    x = spark.read.format("xml").option("rowTag", "page").schema("title string, id long, redirect struct<_title string>").load(path)
    return x.select(F.col("id").alias("page_id"), "title", F.col("redirect._title").alias("redirect"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, score, surface) of lines ``file<TAB>title|score|surface<TAB>...``; parts of another shape are skipped."""
    cells = F.split("value", "\t")
    x = spark.read.text(path).select(cells[0].alias("file"), F.explode(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))).alias("cell"))
    p = F.split("cell", r"\|")
    return x.where(F.size(p) == 3).select("file", p[0].alias("title"), p[1].try_cast("double").alias("score"), p[2].alias("surface"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Training samples (label, features as a vector) in the sparse text format."""
    samples.select("label", "features").write.format("libsvm").mode("overwrite").save(path)
