"""Raw log lines to columns, and lines to templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.sources.templates import Tree, cluster_texts

#: Fixed masks of variable parts: pattern and what stands for it, in this order.
MASKS = (
    (r"0x[0-9a-fA-F]+", "<hex>"),
    (r"[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?", "<ip>"),
    (r"[0-9]+(\.[0-9]+)?", "<num>"),
)


def compile_format(layout: str) -> tuple[str, list[str]]:
    """A regular expression for a layout such as ``<Label> <Time> <Content>``, and its field names; the last takes all."""
    parts = re.split(r"(<[^<>]+>)", layout)
    names = [p[1:-1] for p in parts[1::2]]
    out = [f"({'.*' if p[1:-1] == names[-1] else r'\S+'})" if i % 2 else re.sub(r" +", r"\\s+", re.escape(p).replace(r"\ ", " ")) for i, p in enumerate(parts)]
    return f"^{''.join(out)}$", names


def parse_lines(lines: DataFrame, layout: str, col: str = "value") -> DataFrame:
    """One column for each field of the layout; lines that do not match are left out."""
    pattern, names = compile_format(layout)
    held = lines.where(F.col(col).rlike(pattern))
    return held.select(*[F.regexp_extract(col, pattern, k + 1).alias(n) for k, n in enumerate(names)])


def masked(text: Column) -> Column:
    for pattern, name in MASKS:
        text = F.regexp_replace(text, pattern, name)
    return text


def mine_templates(lines: DataFrame, tree: Tree | None = None, text: str = "content", line_id: str = "line_id") -> DataFrame:
    """(line_id, cluster, template, template_id): lines with the template that their masked text joined; cluster: the first line
    of the template. Lines of equal masked text are clustered once; a line without a text or an id has none and is left out."""
    held = lines.select(line_id, masked(F.col(text)).alias("masked")).where(F.col("masked").isNotNull() & F.col(line_id).isNotNull())
    found = cluster_texts(held.groupBy("masked").agg(F.min(line_id).alias("first")), tree or Tree())
    return held.join(found, "masked").select(line_id, "cluster", "template", F.substring(F.md5("template"), 1, 8).alias("template_id"))


def read_raw(spark, path: str, layout: str) -> DataFrame:
    return parse_lines(spark.read.text(path), layout)


