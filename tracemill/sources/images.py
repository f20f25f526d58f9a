"""Raw image stacks: frames of unsigned 16-bit pixels with a text sidecar."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """path (without suffix), height, width, frames, big_endian, stage_x, stage_y from .inf files."""
    rows = spark.read.text(path, wholetext=True).withColumn("path", F.regexp_replace("_metadata.file_path", r"\.inf$", ""))
    number = lambda p, k=1: F.regexp_extract("value", p, k)
    return rows.select(
        "path", number(r"frame dimensions = (\d+) x (\d+)").try_cast("int").alias("height"), number(r"frame dimensions = (\d+) x (\d+)", 2).try_cast("int").alias("width"),
        number(r"number of frames = (\d+)").try_cast("int").alias("frames"), F.col("value").contains("big endian").alias("big_endian"),
        *[F.expr(f"try_cast(regexp_extract(value, 'Stage {a} = ([-0-9.]+)', 1) as double)").alias(f"stage_{a.lower()}") for a in "XY"],
    )


def frames(spark: SparkSession, images: str, infos: str) -> DataFrame:
    """One row a frame: path, frame, height, width, pixels (little-endian bytes)."""
    files = spark.read.format("binaryFile").load(images).select(F.regexp_replace("_metadata.file_path", r"\.dax$", "").alias("path"), "content")
    rows = files.join(sidecars(spark, infos), "path").select("path", "content", "height", "width", "frames", "big_endian")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                n = r.height * r.width * 2
                for k in range(r.frames):
                    raw = r.content[k * n : (k + 1) * n]
                    yield pd.DataFrame({"path": [r.path], "frame": [k], "height": [r.height], "width": [r.width], "pixels": [np.frombuffer(raw, ">u2").astype("<u2").tobytes() if r.big_endian else raw]})

    return rows.mapInPandas(cut, "path string, frame int, height int, width int, pixels binary")


def image_files(spark: SparkSession, root: str, pattern: str = "*.dax") -> DataFrame:
    """Image files under a folder of rounds H<n>...: path, folder, round (its number), fov (the last number of the file's name). Contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return rows.select("path", "length", folder.alias("folder"), F.regexp_extract(folder, r"^H(\d+)", 1).try_cast("int").alias("round"), F.regexp_extract("path", r"(\d+)\.[^./]+$", 1).try_cast("int").alias("fov"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """path (without suffix), channels (the all-digit parts of the shutter file's name), stage_x, stage_y from the microscope's XML files."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_path", r"\.xml$", "").alias("path"), "value")
    shutter = F.expr("xpath_string(value, '/*/illumination/shutters')")
    base = F.regexp_extract(shutter, r"([^/\\\\]*?)(\.[^./\\\\]*)?$", 1)
    stage = F.split(F.expr("xpath_string(value, '/*/acquisition/stage_position')"), ",")
    return rows.select("path", F.filter(F.split(base, "_"), lambda p: p.rlike("^[0-9]+$")).alias("channels"), *[F.trim(F.get(stage, F.lit(k))).try_cast("double").alias(f"stage_{a}") for k, a in enumerate("xy")])


def image_sizes(infos: DataFrame, channels: DataFrame, buffer: int = 10) -> DataFrame:
    """depth, height, width of one channel's stack; depth is null where the frames do not divide evenly."""
    n = F.size("channels")
    depth = (F.col("frames") - 2 * buffer) / F.nullif(n, F.lit(0))
    return infos.join(channels.select("path", "channels"), "path").select("path", "channels", F.when(depth == F.floor(depth), depth.cast("int")).alias("depth"), "height", "width")


def slices(infos: DataFrame, first: int = 0, step: int = 1, last: int | None = None, box: tuple[int, int, int, int] | None = None, suffix: str = ".dax") -> DataFrame:
    """Some frames of movies, and of them one box (x from, to, y from, to), without reading the rest: path, frame, height, width, pixels.

    Each asked frame is a row before it is read, so that a large file is read by many tasks, a frame's byte range at a time. The files lie where all
    executors see them as files; ``frames`` reads those of other stores.
    """
    end = F.col("frames") - 1 if last is None else F.least(F.col("frames") - 1, F.lit(last))
    asked = infos.where(end >= first).select("path", "height", "width", "big_endian", F.explode(F.sequence(F.lit(first), end, F.lit(step))).alias("frame"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                x0, x1, y0, y1 = box or (0, r.height, 0, r.width)
                with open(r.path.removeprefix("file:").replace("///", "/") + suffix, "rb") as f:
                    f.seek(2 * (r.frame * r.height + x0) * r.width)
                    lines = np.frombuffer(f.read(2 * (x1 - x0) * r.width), ">u2" if r.big_endian else "<u2").reshape(x1 - x0, r.width)
                yield pd.DataFrame({"path": [r.path], "frame": [r.frame], "height": [x1 - x0], "width": [y1 - y0], "pixels": [lines[:, y0:y1].astype("<u2").tobytes()]})

    return asked.mapInPandas(read, "path string, frame int, height int, width int, pixels binary")


def write_movies(frames_: DataFrame, folder: str) -> DataFrame:
    """Write movies (name, frame, height, width, pixels) as raw files with sidecars into a folder that all executors see, and return
    what was written: name, frames. A movie's frames are written in order by one task, to a file of another name that takes its place at the end, so that
    a task that runs twice leaves the same files."""
    ordered = frames_.select("name", "frame", "height", "width", "pixels").repartition("name").sortWithinPartitions("name", "frame")
    place = folder.removeprefix("file:").replace("///", "/")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        name, n, shape, out = None, 0, (0, 0), None
        part = f".{uuid.uuid4().hex}"

        def close() -> pd.DataFrame:
            out.close()
            with open(f"{place}/{name}.inf{part}", "w") as f:
                f.write(f"frame dimensions = {shape[0]} x {shape[1]}\nnumber of frames = {n}\nlittle endian\n")
            for end in (".dax", ".inf"):
                os.replace(f"{place}/{name}{end}{part}", f"{place}/{name}{end}")
            return pd.DataFrame({"name": [name], "frames": [n]})

        for b in batches:
            for r in b.itertuples(index=False):
                if r.name != name:
                    if out:
                        yield close()
                    name, n, shape, out = r.name, 0, (r.height, r.width), open(f"{place}/{r.name}.dax{part}", "wb")  # noqa: SIM115
                out.write(r.pixels)
                n += 1
        if out:
            yield close()

    return ordered.mapInPandas(write, "name string, frames int")


def label_images(spark: SparkSession, path: str) -> DataFrame:
    """Segmented stacks in NumPy files as voxels: path, z, x, y, label (not 0). A file is one stack."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for b in batches:
            for r in b.itertuples(index=False):
                a = np.load(io.BytesIO(r.content), allow_pickle=False)
                a = a[None] if a.ndim == 2 else a
                z, x, y = np.nonzero(a)
                yield pd.DataFrame({"path": r.path, "z": z, "x": x, "y": y, "label": a[z, x, y].astype("int64")})

    return files.mapInPandas(read, "path string, z int, x int, y int, label long")
