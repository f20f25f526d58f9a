"""Cell types from gene counts, learned by the library's network."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predicted(train: DataFrame, cells: DataFrame, label: str, hidden: tuple[int, ...] = (16,), rounds: int = 100, seed: int = 0) -> DataFrame:
    """``cells`` with ``predicted`` (a label of ``train``) and ``confidence``, from the genes (numeric columns) that both tables have.

    The labels are a short list: it is collected to number them. Counts are scaled by their spread in the training cells; missing ones are 0.
    """
    numeric = {c for c, kind in train.dtypes if kind in ("int", "bigint", "float", "double")}
    genes = sorted((numeric & {c for c, _ in cells.dtypes}) - {label, "cell_id"})
    labels = sorted(r[0] for r in train.select(label).where(F.col(label).isNotNull()).distinct().collect())
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    gather = VectorAssembler(inputCols=genes, outputCol="_raw")
    filled = lambda df: df.fillna(0, subset=genes)
    use = gather.transform(filled(train.where(F.col(label).isNotNull()))).select("_raw", number.cast("double").alias("_y"))
    scale = StandardScaler(inputCol="_raw", outputCol="_x").fit(use)
    net = MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_y", probabilityCol="_p", predictionCol="_k", layers=[len(genes), *hidden, max(2, len(labels))], maxIter=rounds, seed=seed)
    out = net.fit(scale.transform(use)).transform(scale.transform(gather.transform(filled(cells))))
    best = F.least(F.col("_k").cast("int"), F.lit(len(labels) - 1))
    return out.select(*cells.columns, F.get(F.array(*[F.lit(x) for x in labels]), best).alias("predicted"), F.array_max(vector_to_array("_p")).alias("confidence"))
