"""YAML front matter of Markdown pages, read and written."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PARTS = StructType([StructField(n, StringType()) for n in ("meta", "body", "warning")])


def split_page(raw: str) -> tuple[str, str, str]:
    """(metadata as JSON, body, warning); a malformed head leaves the page as it is and says so."""
    import yaml

    if not raw.startswith("---\n"):
        return "{}", raw, ""
    head, rule, body = raw[4:].partition("\n---\n")
    if not rule:
        return "{}", raw, ""
    try:
        meta = yaml.safe_load(head)
    except yaml.YAMLError as error:
        return "{}", raw, f"malformed_frontmatter: {type(error).__name__}"
    return json.dumps(meta if isinstance(meta, dict) else {}, default=str, sort_keys=True), body.lstrip("\n"), ""


def parse(raw: Column) -> Column:
    """struct(meta, body, warning); read meta with parse_json or from_json."""

    @F.pandas_udf(PARTS)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_page(p) if p is not None else (None, None, None) for p in pages], columns=PARTS.names)

    return run(raw)


def with_head(meta: Column, body: Column) -> Column:
    """A page with the entries of a string map as its head, values quoted, keys in order."""
    line = F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit(": "), F.to_json(F.array(e["value"]))))
    plain = F.transform(line, lambda x: F.regexp_replace(x, r'^([^:]*: )\["(.*)"\]$', '$1"$2"'))
    return F.concat(F.lit("---\n"), F.array_join(plain, "\n"), F.lit("\n---\n\n"), body)
