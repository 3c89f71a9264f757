"""Writers: tables, reports and receipts."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwatch.sources import files


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Spark's commit protocol makes the write atomic: readers see all of it or none."""
    writer = df.write.mode("overwrite").option("compression", "zstd" if form == "parquet" else "none")
    (writer.partitionBy(*partition_by) if partition_by else writer).option("header", "true").format(form).save(path)


def strict_json(value) -> str:
    """Canonical JSON: sorted keys, and null for values that are no finite number."""

    def clean(x):
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [clean(v) for v in x]
        if isinstance(x, float) and not math.isfinite(x):
            return None
        return x.item() if hasattr(x, "item") else x

    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), default=str)


def table_digest(df: DataFrame, order: list[str]) -> str:
    """A digest that does not depend on the order of rows: hashes of rows, added up over partitions."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    sums = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)]
    found = df.agg(F.count("*").alias("n"), *sums).first()
    return hashlib.sha256(strict_json([sorted(df.columns), [str(v) for v in found], order]).encode()).hexdigest()


def receipt(spark: SparkSession, path: str, content: dict) -> str:
    """Write content and its hash, or check them against what is there: a receipt is never overwritten by another."""
    text = strict_json(content)
    digest = hashlib.sha256(text.encode()).hexdigest()
    if files.exists(spark, path):
        if json.loads(files.read_text(spark, path))["sha256"] != digest:
            raise ValueError(f"{path} holds a receipt of other content")
    else:
        files.write_text(spark, path, json.dumps({"sha256": digest, "content": json.loads(text)}))
    return digest


# LaTeX's special characters and what stands for them.
_LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_table(df: DataFrame, most: int = 10_000) -> str:
    """A report table, whole; a report is small by what it is, and one of more than most rows is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    text = lambda v: "--" if v is None else "".join(_LATEX.get(c, c) for c in (f"{v:.4g}" if isinstance(v, float) else str(v)))
    body = [" & ".join(text(v) for v in r) + r" \\" for r in rows]
    head = " & ".join(text(c) for c in df.columns) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])
