"""Tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_yaml(value: object, path: str) -> None:
    """A small object, such as settings, as YAML; written by the driver."""
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(value, f, allow_unicode=True, sort_keys=False)


def safe_name(name: str) -> str:
    import re

    return re.sub(r"[^\w\-.]", "_", name)
