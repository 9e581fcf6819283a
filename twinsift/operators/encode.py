"""Turn text into vectors with a model the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from twinsift.operators.questions import clean_text

BATCH_SIZE = 32

# A factory loads a model inside the worker and returns texts -> matrix of vectors.
Encoder = Callable[[np.ndarray], np.ndarray]
ModelFactory = Callable[[], Encoder]


def choose_model(models: Mapping[str, ModelFactory], name: str) -> ModelFactory:
    if name not in models:
        raise ValueError(f"unknown model {name!r}, known: {', '.join(sorted(models))}")
    return models[name]


def encode(questions: DataFrame, factory: ModelFactory, id_col: str = "question_id",
           text_col: str = "question_text", vector_col: str = "embedding",
           batch_size: int = BATCH_SIZE) -> DataFrame:
    """(id, vector) of all rows with text; the model is loaded once per Python worker."""
    to_vector = predict_batch_udf(factory, return_type=ArrayType(FloatType()), batch_size=batch_size)
    texts = clean_text(questions, text_col)
    return texts.select(id_col, to_vector(F.col(text_col)).alias(vector_col))
