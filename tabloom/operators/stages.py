"""The operators as Spark ML stages, so that a fitted preparation can be saved, loaded
and replayed on a batch or a stream inside a `PipelineModel`.

A `FittedStep` keeps what was learned as one JSON-ready value; an `OperatorStep`
learns nothing. Subclass either to add an operator. Learned tables that are too large for
such a value are folders named in it; saving copies them below the model's own folder, so
a saved model needs nothing of the scratch space it was trained in.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReader,
                             MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import resolve_columns
from ..functions.text import clean_text
from . import encode, features, guard, impute, isolation, sanitize, scale, target_stats, vectorize


def _tables(value, found: list[dict]) -> list[dict]:
    """Every part of a state that names a written table, in a fixed order."""
    if isinstance(value, dict):
        if isinstance(value.get("table"), str):
            found.append(value)
        for key in value:
            _tables(value[key], found)
    elif isinstance(value, list):
        for part in value:
            _tables(part, found)
    return found


def carry_tables(spark: SparkSession, state, path: str):
    """A copy of the state whose tables have been copied below `path` and are named relative to it."""
    copied = json.loads(json.dumps(state))
    for i, (part, source) in enumerate(zip(_tables(copied, []), _tables(state, []))):
        spark.read.parquet(source["table"]).write.parquet(f"{path}/tables/{i}")
        part["table"] = f"tables/{i}"
    return copied


def find_tables(state, path: str):
    """The state with its tables named by full path again."""
    for part in _tables(state, []):
        part["table"] = f"{path}/{part['table']}"
    return state


def save_state(spark: SparkSession, state, path: str) -> None:
    text = json.dumps(carry_tables(spark, state, path))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/state")


def load_state(spark: SparkSession, path: str):
    return find_tables(json.loads(spark.read.text(f"{path}/state", wholetext=True).first()["value"]), path)


class _StepWriter(MLWriter):
    def __init__(self, step):
        super().__init__()
        self.step = step

    def saveImpl(self, path: str) -> None:  # noqa: N802
        state = carry_tables(self.sparkSession, self.step.getOrDefault(self.step.state), path)
        DefaultParamsWriter.saveMetadata(self.step, path, self.sparkSession, paramMap={"state": state})


class _StepReader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        step = self.kind(state=find_tables(metadata["paramMap"]["state"], path))
        step._resetUid(metadata["uid"])
        return step


class OperatorStep(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stateless operator; `config` holds its settings."""

    config = Param(Params._dummy(), "config", "settings of the operator")

    @keyword_only
    def __init__(self, config=None):
        super().__init__()
        self._setDefault(config={})
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def validate(self) -> list[str]:
        """Problems of the configuration; empty when it is usable."""
        return []

    def apply(self, df: DataFrame, **config) -> DataFrame:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.apply(dataset, **self.getOrDefault(self.config))


class FittedStep(Model, DefaultParamsReadable, DefaultParamsWritable):
    """What an operator learned; `state` is plain data, with large tables named by folder."""

    state = Param(Params._dummy(), "state", "learned values")

    @keyword_only
    def __init__(self, state=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def apply(self, df: DataFrame, state) -> DataFrame:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.apply(dataset, self.getOrDefault(self.state))

    def write(self):
        return _StepWriter(self)

    @classmethod
    def read(cls):
        return _StepReader(cls)


class LearningStep(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """An operator that learns from the table; `fitted` names its `FittedStep`."""

    config = Param(Params._dummy(), "config", "settings of the operator")
    fitted = FittedStep

    @keyword_only
    def __init__(self, config=None):
        super().__init__()
        self._setDefault(config={})
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def validate(self) -> list[str]:
        return []

    def learn(self, df: DataFrame, **config):
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> FittedStep:
        return self.fitted(state=self.learn(dataset, **self.getOrDefault(self.config)))


class ImputerModel(FittedStep):
    def apply(self, df, state):
        return impute.apply_fills(df, state)


class Imputer(LearningStep):
    fitted = ImputerModel

    def learn(self, df, **config):
        return impute.fit_fills(df, **config)


class ScalerModel(FittedStep):
    def apply(self, df, state):
        return scale.apply_scaler(df, state)


class Scaler(LearningStep):
    fitted = ScalerModel

    def learn(self, df, **config):
        return scale.fit_scaler(df, **config)


class EncoderModel(FittedStep):
    def apply(self, df, state):
        return encode.apply_encoder(df, state)


class Encoder(LearningStep):
    fitted = EncoderModel

    def learn(self, df, **config):
        return encode.fit_encoder(df, **config)


class GuardModel(FittedStep):
    def apply(self, df, state):
        return guard.apply_bounds(df, state, state.get("action", "flag"))


class Guard(LearningStep):
    fitted = GuardModel

    def learn(self, df, action="flag", **config):
        return {**guard.fit_bounds(df, **config), "action": action}


class VectorizerModel(FittedStep):
    """Adds named columns, or one vector column when the state has `vector_column`."""

    def apply(self, df, state):
        if state.get("vector_column"):
            return vectorize.transform_vectors(df, state, state["vector_column"])
        return vectorize.vectorize(df, state, state.get("drop_original", True))


class Vectorizer(LearningStep):
    fitted = VectorizerModel

    def learn(self, df, drop_original=True, vector_column=None, **config):
        state = vectorize.fit_vectorizer(df, **config)
        if state is None:
            raise ValueError("no text column to vectorize")
        return {**state, "drop_original": drop_original, "vector_column": vector_column}


class FeatureModel(FittedStep):
    def apply(self, df, state):
        return features.apply_features(df, state)


class Features(LearningStep):
    fitted = FeatureModel

    def learn(self, df, exclude=()):
        return features.fit_features(df, exclude)


class NativeCategoryModel(FittedStep):
    def apply(self, df, state):
        return features.apply_native_categories(df, state)


class TargetStatsModel(FittedStep):
    def apply(self, df, state):
        return target_stats.apply_target_stats(df, state)


class IsolationForestModel(FittedStep):
    def apply(self, df, state):
        return isolation.flag_anomalies(df, state)


class IsolationForest(LearningStep):
    fitted = IsolationForestModel

    def learn(self, df, **config):
        return isolation.fit_isolation_forest(df, **config)


class CategorySanitizer(OperatorStep):
    def apply(self, df, **config):
        return sanitize.sanitize_categories(df, **config)


class TextCleaner(OperatorStep):
    def apply(self, df, columns=None, **config):
        return clean_columns(df, columns, **config)


def clean_columns(df: DataFrame, columns=None, **config) -> DataFrame:
    """`clean_text` on the chosen (else all) text columns."""
    return df.withColumns({n: clean_text(F.col(f"`{n}`"), **config) for n in resolve_columns(df, columns, "string")})
