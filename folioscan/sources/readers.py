"""Readers of the input files: JSON lines, tag lists, changed keys, chapter lists, payload folders, configurations."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions.text import strip

ENDPOINT = "struct<ok: boolean, url: string, content: string, error: string, duration_ms: int>"
PAYLOAD = f"tag string, full_label string, fetched_at_utc bigint, structure {ENDPOINT}, statement {ENDPOINT}, full {ENDPOINT}, content_hash string"
CORPUS = "id string, tag string, full_label string, chapter_key string, source_tex string, env_type string, reference string, title string, structure_type string, structure_name string, statement_text string, proof_text string, normalized_text string, outgoing_refs array<string>, statement_html string, full_html string, content_hash string, api_content_hash string"
METADATA = "id string, tag string, full_label string, chapter_key string, source_tex string, env_hint string"
EDGES = "source_tag string, target_tag string, edge_type string"
EVAL = "id string, query string, relevant_tags array<string>, category string, env string, chapter string"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines with a given schema; a missing file is empty, blank lines are skipped, a broken line raises."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """``tag, full_label`` of lines ``tag,label``; comments, blanks and lines without comma or with an empty part are dropped, the last line of a tag holds."""
    raw = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    line = strip(F.col("value"))
    rows = raw.filter(~F.startswith(line, F.lit("#")) & F.contains(line, F.lit(","))).select(F.split(line, ",", 2).alias("p"), "n")
    rows = rows.select(strip(F.col("p")[0]).alias("tag"), strip(F.col("p")[1]).alias("full_label"), "n").filter("tag <> '' AND full_label <> ''")
    return rows.groupBy("tag").agg(F.max_by("full_label", "n").alias("full_label"))


def read_changed(spark: SparkSession, path: str) -> DataFrame:
    """``tag`` from a JSON array or an object with ``changed_tags``, ``fetched_tags`` or ``tags`` (the first that is a list)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "tag string")
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    lists = [F.try_variant_get("v", p, "array<string>") for p in ("$", "$.changed_tags", "$.fetched_tags", "$.tags")]
    return doc.select(F.explode(F.coalesce(*lists)).alias("tag")).distinct()


def chapter_keys(text: str, name: str = "LIJST") -> list[str]:
    """Words of the list variable of a makefile: from ``NAME =`` on, comments cut, lines ending in a backslash go on."""
    found = re.search(rf"^{name} =(.*)", text, re.M | re.S)
    if not found:
        return []
    words: list[str] = []
    for line in found[1].splitlines():
        body = line.split("#", 1)[0].strip()
        if not body:
            break
        words += body.rstrip("\\").split()
        if not body.endswith("\\"):
            break
    return words


def read_chapters(spark: SparkSession, path: str) -> list[str]:
    if not path_exists(spark, path):
        return []
    return chapter_keys("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def first_of(readers: list[Callable[[], list]], fallback: bool = True) -> tuple[list, bool]:
    """The first reader with a result; (result, whether it was not the first). Readers that raise count as empty."""
    for n, reader in enumerate(readers):
        try:
            got = reader()
        except OSError:
            got = []
        if got:
            return got, n > 0
        if not fallback:
            break
    return [], True


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document per tag; broken documents are kept with ``is_object`` false and their file's name as tag."""
    if not path_exists(spark, folder):
        return spark.createDataFrame([], f"{PAYLOAD}, is_object boolean")
    docs = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("file"), F.from_json("value", PAYLOAD).alias("p"), F.try_parse_json("value").alias("v"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    fields = [f.name for f in T._parse_datatype_string(PAYLOAD).fields if f.name != "tag"]
    return docs.select(F.coalesce(F.nullif(F.col("p.tag"), F.lit("")), F.col("file")).alias("tag"), *[F.col(f"p.{f}").alias(f) for f in fields], is_object.alias("is_object"))


def cache_state(payloads: DataFrame) -> DataFrame:
    """What the refresh decision needs of each payload."""
    return payloads.select("tag", "full_label", F.col("statement.ok").alias("statement_ok"), F.col("full.ok").alias("full_ok"), "fetched_at_utc", "is_object")


def read_vectors(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """``id, embedding`` with a check of the length in every row."""
    rows = spark.read.parquet(path)
    if dim is not None:
        rows = rows.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector is not of length {dim}"))))
    return rows


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows with a query and relevant tags; the query stands in for a missing id."""
    rows = read_jsonl(spark, path, EVAL).filter("coalesce(query, '') <> '' AND size(relevant_tags) > 0")
    return rows.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.col("query")))


def load_config(path: str) -> dict:
    """A configuration object from JSON or YAML; anything but an object is an error."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML needs PyYAML; use JSON") from e
        got = yaml.safe_load(text) or {}
    else:
        got = json.loads(text)
    if not isinstance(got, dict):
        raise ValueError(f"{path} holds no object")
    return got


def section(config: dict, name: str) -> dict:
    """A section of the configuration, or all of it where there is no such section."""
    part = config.get(name)
    return part if isinstance(part, dict) else config


def options(config: dict, name: str, given: dict) -> dict:
    """File values under the command line's, which win where they are set."""
    return section(config, name) | {k: v for k, v in given.items() if v is not None}


def load_list(path: str | None, fallback: list[dict]) -> list[dict]:
    """Objects of a JSON list, or the fallback without a file; an empty list is an error."""
    rows = fallback
    if path and os.path.exists(path):
        with open(path, encoding="utf-8-sig") as f:
            got = json.load(f)
        if not isinstance(got, list):
            raise ValueError(f"{path} holds no list")
        rows = [x for x in got if isinstance(x, dict)]
    if not rows:
        raise ValueError("no rows")
    return rows


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in an order; 0 stands for all."""
    return df.orderBy(order).limit(n) if n > 0 else df
