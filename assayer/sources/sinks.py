"""Sinks: manifests, strict JSON, appended score logs, split layouts, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.text import finite


def strict(df: DataFrame) -> DataFrame:
    """df with null in place of doubles that JSON can't hold, in columns and in arrays."""
    out = {}
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.when(finite(c), c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.transform(c, lambda x: F.when(finite(x), x))
    return df.withColumns(out) if out else df


def write_manifest(df: DataFrame, path: str) -> None:
    """CSV with a header, which an empty table also gets."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_scores(df: DataFrame, path: str) -> None:
    strict(df).write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    strict(df).coalesce(1).write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder for each split and label."""
    df.write.mode("overwrite").partitionBy("split", "label").parquet(path)


def markdown(df: DataFrame, title: str, rows: int = 200) -> str:
    """A small report table as Markdown; `rows` bounds what the driver holds, and a last line says if there are more."""
    got = df.limit(rows + 1).collect()
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got[:rows]]
    return "\n".join(lines + (["", f"Only the first {rows} rows are shown."] if len(got) > rows else [])) + "\n"


def export_bytes(df: DataFrame, folder: str, per_class: int | None = None) -> DataFrame:
    """Writes (name, label, content) as files <folder>/<label>/<name>, the bytes as they are; (label, n) of what was written.

    With per_class only the first names of each class are written. Folders must be reachable by all tasks; a file that
    is written again after a failure is the same file.
    """
    if per_class is not None:
        w = W.partitionBy("label").orderBy("name")
        df = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_class).drop("_r")

    def put(batches):
        import os

        import pandas as pd

        for b in batches:
            for name, label, content in zip(b["name"], b["label"], b["content"], strict=True):
                at = os.path.join(folder, str(label))
                os.makedirs(at, exist_ok=True)
                safe = os.path.basename(str(name))
                with open(os.path.join(at, safe + ".part"), "wb") as f:
                    f.write(content)
                os.replace(os.path.join(at, safe + ".part"), os.path.join(at, safe))
            yield pd.DataFrame({"label": b["label"].astype(str)})

    return df.select("name", "label", "content").mapInPandas(put, "label string").groupBy("label").agg(F.count("*").alias("n"))
