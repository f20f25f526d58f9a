"""The engine's own tables: one Parquet table for each kind of thing, in partitions of the field of view, written again without harm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds and the columns that each must have.
KINDS = {
    "candidate_spots": "fov_id cell_id uid bit channel height z x y", "spot_groups": "fov_id cell_id region_id a b c score", "picked": "fov_id cell_id chr region uid copy", "drifts": "fov_id round shift_z shift_x shift_y",
    "cells": "fov_id cell_id", "masks": "fov_id z x y label", "traces": "fov_id cell_id chr homolog region z x y",
}


def save(df: DataFrame, root: str, kind: str, fov: str = "fov_id") -> None:
    """Write rows over the partitions of their fields of view; other fields stay. Missing columns are refused."""
    missing = set(KINDS[kind].split()) - set(df.columns)
    if missing:
        raise ValueError(f"{kind} lacks {sorted(missing)}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(fov).parquet(f"{root}/{kind}")


def load(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """A table without rows of padding: spots have a height over 0."""
    df = spark.read.parquet(f"{root}/{kind}")
    return df.where("height > 0") if kind == "candidate_spots" else df


def missing(spark: SparkSession, root: str, kind: str, wanted: DataFrame, fov: str = "fov_id") -> DataFrame:
    """The wanted fields of view that the table does not hold yet."""
    try:
        have = spark.read.parquet(f"{root}/{kind}").select(fov).distinct()
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return wanted
    return wanted.join(have, fov, "left_anti")


def codebook_wide(codes: DataFrame, bits: list[int]) -> DataFrame:
    """The codebook with a 0/1 column for each bit."""
    return codes.groupBy("region_id").agg(*[F.max(F.when(F.col("bit") == b, 1).otherwise(0)).alias(f"bit_{b}") for b in bits])
