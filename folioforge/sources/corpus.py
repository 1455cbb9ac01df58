"""The Markdown corpus: files with front matter to rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from folioforge.functions.text import strip

#: Fixed value: what separates front matter from the body.
FENCE = "---\n"
_FLAT = r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*)$"


def split_front_matter(text: Column) -> tuple[Column, Column]:
    """(front matter, body); an error for a file that does not begin with one or does not close it."""
    parts = F.split(text, FENCE, 3)
    ok = text.startswith(FENCE) & (F.size(parts) == 3)
    bad = F.raise_error(F.lit("front matter is missing or not closed")).cast("string")
    return F.when(ok, parts[1]).otherwise(bad), F.when(ok, parts[2]).otherwise(bad)


def flat_yaml(front: Column) -> Column:
    """``key: value`` lines as a map: quotes are taken off, comments after a space cut, empty values null. Later keys win."""
    keys = F.regexp_extract_all(front, F.lit(_FLAT), F.lit(1))
    values = F.transform(F.regexp_extract_all(front, F.lit(_FLAT), F.lit(2)), _scalar)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: F.array_position(F.transform(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"]), p["k"]) == 0)
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value"))))


def _scalar(v: Column) -> Column:
    v = F.trim(F.regexp_replace(v, "\r$", ""))
    quoted = F.regexp_extract(v, r"""^(?:"(.*)"|'(.*)')\s*(?:#.*)?$""", 1)
    single = F.regexp_extract(v, r"""^'(.*)'\s*(?:#.*)?$""", 1)
    plain = F.trim(F.regexp_replace(v, r"\s+#.*$", ""))
    return F.when(v.startswith('"'), quoted).when(v.startswith("'"), single).when(plain.isin("", "~", "null"), F.lit(None).cast("string")).otherwise(plain)


def general_yaml(rows: DataFrame, front: str, columns: list[str], to: str = "metadata") -> DataFrame:
    """Front matter of any YAML form as a map of strings (nested values as JSON), through the yaml module in the workers."""
    out = T.StructType([*rows.select(*columns).schema.fields, T.StructField(to, T.MapType(T.StringType(), T.StringType()))])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import datetime
        import json

        import yaml

        def text(v: object) -> str | None:
            if v is None or isinstance(v, str):
                return v
            if isinstance(v, (datetime.date, datetime.datetime)):
                return v.isoformat()
            return json.dumps(v, default=str, sort_keys=True, ensure_ascii=False)

        for pdf in batches:
            made = []
            for raw in pdf[front]:
                value = yaml.safe_load(raw)
                if not isinstance(value, dict):
                    raise ValueError("front matter must be a mapping")
                made.append({str(k): text(v) for k, v in value.items()})
            yield pdf[columns].assign(**{to: made})

    return rows.mapInPandas(parse, out)


def read_markdown(spark: SparkSession, root: str, general: bool = False) -> DataFrame:
    """Every *.md file below root as a document: source_path (relative to the parent of root), content and metadata columns."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/").rsplit("/", 1)
    inside = F.element_at(F.split(F.col("_metadata.file_path"), f"/{base[-1]}/", 2), 2)
    front, body = split_front_matter(F.col("value"))
    path = F.concat(F.lit(base[-1] + "/"), F.try_url_decode(inside) if hasattr(F, "try_url_decode") else inside)
    rows = files.select(path.alias("source_path"), F.col("value").alias("raw"), front.alias("front"), body.alias("body"))
    if general:
        rows = general_yaml(rows, "front", ["source_path", "raw", "body"])
    else:
        rows = rows.withColumn("metadata", flat_yaml(F.col("front")))
    return documents_from(rows)


def documents_from(rows: DataFrame) -> DataFrame:
    """Promotes what the engine filters by from metadata to typed columns; the map keeps everything."""
    m = lambda k: F.col("metadata")[k]
    return rows.select(
        "source_path", strip(F.col("body")).alias("content"), m("doc_id").alias("doc_id"), m("version").alias("version"), m("status").alias("status"),
        m("effective_date").try_cast("date").alias("effective_date"), m("expiry_date").try_cast("date").alias("expiry_date"), "metadata",
    )
