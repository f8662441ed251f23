"""Shared parts of the stages: settings as Params, fitted tables that save and load."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReader,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.session import settle


def setting(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc)


class FitOnBatch(Transformer):
    """Learn on the very rows that are transformed, instead of on the training rows.

    Every batch (a split, a fold, the rows to be scored) is filled and scaled by its own
    statistics; nothing is remembered.
    """

    def __init__(self, est: Estimator):
        super().__init__()
        self.est = est

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.est.fit(df).transform(df)


RAW = "_raw"


class Settled(DefaultParamsReadable, DefaultParamsWritable, Transformer):
    """Write the rows prepared so far, for stages and learners that read them many times."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return settle(df)


def packed(df: DataFrame) -> DataFrame:
    """Carry the rows as they are in one struct, past stages that overwrite columns."""
    return df.withColumn(RAW, F.struct(*[F.col(f"`{c}`") for c in df.columns]))


class Configured(DefaultParamsReadable, DefaultParamsWritable):
    """A stage built from keyword settings; values must be JSON-serialisable."""

    defaults: Mapping = {}

    def __init__(self, **settings):
        super().__init__()
        self._setDefault(**self.defaults)
        self._set(**{name: value for name, value in settings.items() if value is not None})

    def get(self, name: str):
        return self.getOrDefault(name)


class _TablesWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        for name, table in self.instance.tables.items():
            table.write.parquet(f"{path}/tables/{name}")


class _TablesReader(DefaultParamsReader):
    def load(self, path: str):
        stage = super().load(path)
        read = self.sparkSession.read.parquet
        stage.tables = {name: read(f"{path}/tables/{name}") for name in stage.get("table_names")}
        return stage


class TableModel(Configured, Model):
    """A model whose keyed state stays a DataFrame, because it grows with the data."""

    table_names = setting("table_names", "names of the fitted tables")

    def __init__(self, tables: dict[str, DataFrame] | None = None, **settings):
        super().__init__(**settings)
        self.tables = tables or {}
        self._set(table_names=sorted(self.tables))

    def write(self):
        return _TablesWriter(self)

    @classmethod
    def read(cls):
        return _TablesReader(cls)


class _PartsWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        parts, facts = self.instance.parts()
        extra = {"facts": facts, "names": list(parts)}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=extra)
        for number, part in enumerate(parts.values()):
            part.save(f"{path}/parts/{number}")


class _PartsReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        parts = {
            name: DefaultParamsReader.loadParamsInstance(f"{path}/parts/{number}", self.sparkSession)
            for number, name in enumerate(metadata["names"])
        }
        return self.cls.of_parts(parts, metadata["facts"])


class PartsModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A model made of fitted models; it is saved and loaded part by part."""

    def parts(self) -> tuple[dict[str, Model], dict]:
        """The parts by name, in order, and whatever else is needed (JSON)."""
        raise NotImplementedError

    @classmethod
    def of_parts(cls, parts: dict[str, Model], facts: dict):
        raise NotImplementedError

    def write(self):
        return _PartsWriter(self)

    @classmethod
    def read(cls):
        return _PartsReader(cls)
