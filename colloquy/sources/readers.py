"""Scans of the formats that corpora come in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import ranges, token_files


def json_lines(spark: SparkSession, path, schema, strict: bool = True) -> DataFrame:
    """Strict: a malformed line ends the scan with an error. Lenient: it is skipped. Blank lines never count."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def optional(spark: SparkSession, path: str, schema, strict: bool = True) -> DataFrame:
    """JSON lines, or no rows if nothing is at ``path``."""
    if exists(spark, path):
        return json_lines(spark, path, schema, strict)
    return spark.createDataFrame([], schema if isinstance(schema, StructType) else StructType.fromDDL(schema))


def json_array(spark: SparkSession, path, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_folder(spark: SparkSession, paths, schema) -> DataFrame:
    """A row for each *.json file that can be decoded, with the file's name."""
    found = [p for p in ([paths] if isinstance(paths, str) else paths) if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], StructType.fromDDL(schema) if isinstance(schema, str) else schema).withColumn("file", F.lit(None).cast("string"))
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(found)
    return df.withColumn("file", F.col("_metadata.file_path"))


def game_replays(spark: SparkSession, path, one_a_line: bool = False) -> DataFrame:
    """file and value, a variant, of each recorded game: a JSON file each, or a line each. What can't be decoded is left out."""
    df = spark.read.option("singleVariantColumn", "value").option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json" if not one_a_line else "*").option("multiLine", not one_a_line).json(path)
    return df.select(F.col("_metadata.file_path").alias("file"), "value").where("value IS NOT NULL")


def book_csv(spark: SparkSession, path) -> DataFrame:
    """title, word_count, content by place; short rows are dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).schema("title string, word_count string, content string").csv(path)
    return df.where(F.col("content").isNotNull())


def replay_csv(spark: SparkSession, path) -> DataFrame:
    """Steps of recorded episodes, whose fields may hold line ends; the escape is a character that texts don't have."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", "˘").option("maxCharsPerColumn", -1).csv(path).withColumn("file", F.col("_metadata.file_path"))


def lines(spark: SparkSession, paths) -> DataFrame:
    """Lines of the files that are there, without characters that didn't decode."""
    found = [p for p in ([paths] if isinstance(paths, str) else paths) if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], "value string, file string")
    return spark.read.text(found).select(F.translate("value", "�", "").alias("value"), F.col("_metadata.file_path").alias("file"))


def blocks(spark: SparkSession, path: str, split: int = ranges.SPLIT) -> DataFrame:
    """Blocks between blank lines of each file, in order: file, start, place, block. Large files are split among tasks."""
    return ranges.blocks(spark, path, split)


def articles(spark: SparkSession, path: str, split: int = ranges.SPLIT) -> DataFrame:
    """title and body: a short block that doesn't start in lower case, and the block after it. Large files are split."""
    return ranges.articles(spark, path, split).select("title", "body")


def episode_arrays(spark: SparkSession, folder: str, schema: str = "file string, step long, action string, reward double, terminated boolean, truncated boolean, long string, short string") -> DataFrame:
    """Steps of *.npz episodes below ``folder``; arrays of objects are refused.

    long and short are an observation's texts: of arrays of these names with _term_context behind, or of an array
    ``text`` of JSON objects with these fields; empty where an episode has neither.
    """
    import io
    import json

    import numpy as np
    import pyarrow as pa

    def contexts(z, n):
        if "text" in z.files:
            found = [json.loads(str(x) or "{}") for x in z["text"]]
            found = [x if isinstance(x, dict) else {} for x in found]
            return [[str(x.get(f"{kind}_term_context") or "") for x in found] for kind in ("long", "short")]
        return [[str(x) for x in z[f"{kind}_term_context"]] if f"{kind}_term_context" in z.files else [""] * n for kind in ("long", "short")]

    def decode(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    n = len(z["action"])
                    long, short = contexts(z, n)
                    columns = {"file": [path] * n, "step": list(range(n)), "action": [str(x) for x in z["action"]], "reward": z["reward"].astype(float), "terminated": z["terminated"].astype(bool), "truncated": z["truncated"].astype(bool), "long": long, "short": short}
                    yield pa.RecordBatch.from_pydict(columns)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(folder)
    return files.select("path", "content").mapInArrow(decode, schema)


def with_suffix_sibling(files: DataFrame, kept: str, needed: str, path: str = "path") -> DataFrame:
    """Of the ``kept`` files those whose ``needed`` sibling exists."""
    stem = lambda df: df.withColumn("stem", F.regexp_replace(path, r"\.[^./]*$", ""))
    return stem(files.where(F.endswith(path, F.lit(kept)))).join(stem(files.where(F.endswith(path, F.lit(needed)))).select("stem"), "stem", "left_semi")


def task_of(path: Column, env: str) -> Column:
    """The folder right below the environment's; null if the file lies there itself."""
    return F.nullif(F.regexp_extract(path, rf"/{env}/([^/]+)/", 1), F.lit(""))


def log_metric(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The first match of a number in a log; null if log or match is missing."""
    if not exists(spark, path):
        return spark.sql("SELECT cast(NULL AS double) AS value")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.regexp_extract("value", pattern, 1).try_cast("double").alias("value"))


def delimited_texts(spark: SparkSession, path: str, separator: str, split: int = ranges.SPLIT) -> DataFrame:
    """Texts between separators, by file and start; a last one that isn't closed is dropped. Large files are split.

    ``separator`` is a literal, or a pattern in which every sign is escaped.
    """
    literal = re.sub(r"\\(\W)", r"\1", separator)
    return ranges.delimited(spark, path, literal, split).select("file", "start", "text")


def token_file(spark: SparkSession, path: str, width: int = 2, split: int = token_files.SPLIT) -> DataFrame:
    """path, position and token of little-endian fixed-width files, read by ranges; bounds on position prune them."""
    return token_files.read(spark, path, width, split)


def must_exist(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path




def episode_returns(spark: SparkSession, folder: str) -> DataFrame:
    """stem and episode_return (zero if missing) of each run's JSON below ``folder``."""
    df = spark.read.schema("episode_return double").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    return df.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.json$", "").alias("stem"), F.coalesce("episode_return", F.lit(0.0)).alias("episode_return"))


def episodes_with_returns(steps: DataFrame, returns: DataFrame, file: str = "file") -> DataFrame:
    """Logged steps with their episode's return; logs without one, and returns without a log, are left out."""
    return steps.withColumn("stem", F.regexp_replace(file, r"\.csv$", "")).join(returns, "stem")


RESULT = "arm string, tag string, seed long, steps long, tokens_seen long, final_val double, best_val double, final_ppl double, wall_seconds double, params struct<core:long,stream:long,table:long,total:long>, history array<struct<step:long,tokens:long,train:double,val:double>>"


def results(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each experiment's result, with its file."""
    return spark.read.schema(RESULT).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).withColumn("file", F.col("_metadata.file_name"))


def holdouts(spark: SparkSession, folder: str) -> DataFrame:
    """file and text of every *_holdout.jsonl in a folder, in the order of their names; an error if there is none."""
    df = spark.read.schema("text string").option("pathGlobFilter", "*_holdout.jsonl").json(folder).select(F.col("_metadata.file_name").alias("file"), "text")
    if df.isEmpty():
        raise FileNotFoundError(f"no *_holdout.jsonl in {folder}")
    return df.orderBy("file")
