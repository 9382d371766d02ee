"""Label encoding as a Spark ML stage (E3): alphabetical codes per category column, unseen values 0.

The fitted stage keeps its classes as a table (column, value, code), not as a parameter: it is numbered by ranges, saved as
parquet beside the stage's parameters and read from there, so columns of millions of classes never reach the driver. In
``transform`` columns of few classes become literal maps, the others are joined (``encode.encode``).
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame

from ..functions import constants as K
from . import encode as EN

CLASSES = "column string, value string, code int"


class _EncoderParams(HasInputCols):
    nullAs = Param(Params._dummy(), "nullAs", "missing value handling: 'nan' class or 'first' (unseen)",
                   typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(nullAs="nan", inputCols=list(K.CATEGORICAL))


class CategoryEncoder(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the classes of ``inputCols``; columns that the rows lack are left out."""

    @keyword_only
    def __init__(self, *, inputCols=None, nullAs="nan"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "CategoryEncoderModel":
        columns = self.getOrDefault(self.inputCols)
        model = CategoryEncoderModel(nullAs=self.getOrDefault(self.nullAs), inputCols=columns)
        model.classes = EN.encoder_table_by_ranges(dataset, columns)
        return model


class CategoryEncoderModel(Model, _EncoderParams, MLReadable, MLWritable):
    """``classes``: the fitted table; a model without one encodes nothing."""

    classes: DataFrame | None = None
    _state: EN.EncoderState | None = None

    @keyword_only
    def __init__(self, *, nullAs="nan", inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def state(self) -> EN.EncoderState:
        if self._state is None:
            self._state = EN.EncoderState() if self.classes is None else EN.EncoderState.from_table(self.classes)
        return self._state

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return EN.encode(dataset, self.state(), null_as=self.getOrDefault(self.nullAs))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: CategoryEncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        classes = self.model.classes
        if classes is None:
            classes = self.sparkSession.createDataFrame([], CLASSES)
        classes.write.parquet(f"{path}/classes")


class _Reader(MLReader):
    def __init__(self, cls: type[CategoryEncoderModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> CategoryEncoderModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession, f"{self.cls.__module__}.{self.cls.__name__}")
        model = self.cls()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        model.classes = self.sparkSession.read.schema(CLASSES).parquet(f"{path}/classes")
        return model
