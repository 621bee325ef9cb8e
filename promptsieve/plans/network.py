"""Networks of the user's own in an experiment: a fit function, and batch inference on the workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


class NetworkModel(Transformer):
    """Adds ``probability`` and ``prediction`` to rows with ``features``.

    ``make_predict`` is called once per Python worker, loads the network there, and returns a function from an array of
    (rows, size) numbers to one of (rows, classes) probabilities. Ties go to the smaller class.
    """

    def __init__(self, make_predict: Callable, size: int, batch_rows: int = 256):
        super().__init__()
        self.make_predict, self.size, self.batch_rows = make_predict, size, batch_rows

    def _transform(self, dataset: DataFrame) -> DataFrame:
        predict = predict_batch_udf(self.make_predict, return_type=ArrayType(FloatType()), batch_size=self.batch_rows,
                                    input_tensor_shapes=[[self.size]])
        rows = dataset.withColumn("_p", predict(vector_to_array("features", "float32")).cast("array<double>"))
        best = F.array_position("_p", F.array_max("_p")) - 1
        return rows.withColumns({"probability": array_to_vector("_p"), "prediction": best.cast("double")}).drop("_p")


class NetworkEstimator(Estimator):
    """A candidate for ``experiment.train``: ``fit_network`` gets the training rows (features, label, weight) as a DataFrame,
    trains in whatever way it likes, and returns the ``make_predict`` of a ``NetworkModel``."""

    def __init__(self, fit_network: Callable[[DataFrame], Callable], size: int, batch_rows: int = 256):
        super().__init__()
        self.fit_network, self.size, self.batch_rows = fit_network, size, batch_rows

    def _fit(self, dataset: DataFrame) -> NetworkModel:
        return NetworkModel(self.fit_network(dataset), self.size, self.batch_rows)
