"""Saving of fitted models: as stages of pipelines, and whole folders that appear at once.

A model of this library states what it is made of: settings, numpy arrays, tables and other models. That
makes it writable like any MLlib model, so pipelines that hold it can be saved too. ``save`` writes a model
beside its place, adds a manifest with versions and the length of every file, and renames the folder;
``load`` reads a folder only if all its files are there. On stores that copy to rename, the manifest
is what tells a whole folder from a part of one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

FORMAT = 1
MANIFEST = "manifest"


@dataclass
class Parts:
    """What a fitted model is made of. ``settings`` are JSON values; ``arrays`` are held by the driver."""

    settings: dict = field(default_factory=dict)
    arrays: dict[str, np.ndarray] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    models: dict[str, MLWritable] = field(default_factory=dict)


class Saved(MLWritable, MLReadable):
    """Mixin of models that state their parts and can be made of them."""

    def parts(self) -> Parts:
        raise NotImplementedError

    @classmethod
    def of_parts(cls, parts: Parts) -> Saved:
        raise NotImplementedError

    def write(self) -> PartsWriter:
        return PartsWriter(self)

    @classmethod
    def read(cls) -> PartsReader:
        return PartsReader(cls)


class PartsWriter(MLWriter):
    def __init__(self, model: Saved):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, parts = self.sparkSession, self.model.parts()
        names = {"settings": parts.settings, "tables": sorted(parts.tables), "models": sorted(parts.models)}
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata=names)
        rows = []
        for name, value in parts.arrays.items():
            a = np.ascontiguousarray(value)
            rows.append((name, a.dtype.str, list(a.shape), a.tobytes()))
        spark.createDataFrame(rows, "name string, kind string, shape array<int>, data binary").coalesce(1).write.parquet(f"{path}/arrays")
        for name, table in parts.tables.items():
            table.write.parquet(f"{path}/tables/{name}")
        for name, model in parts.models.items():
            model.write().save(f"{path}/models/{name}")


class PartsReader(MLReader):
    def __init__(self, kind: type[Saved]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Saved:
        spark = self.sparkSession
        stored = DefaultParamsReader.loadMetadata(path, spark)
        rows = spark.read.parquet(f"{path}/arrays").collect()
        arrays = {r["name"]: np.frombuffer(r["data"], np.dtype(r["kind"])).reshape(r["shape"]).copy() for r in rows}
        tables = {name: spark.read.parquet(f"{path}/tables/{name}") for name in stored["tables"]}
        models = {name: DefaultParamsReader.loadParamsInstance(f"{path}/models/{name}", spark) for name in stored["models"]}
        model = self.kind.of_parts(Parts(stored["settings"], arrays, tables, models))
        model._resetUid(stored["uid"])
        return model


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _lengths(spark: SparkSession, path: str) -> dict[str, int]:
    """Relative path -> bytes of the files below ``path``, the manifest left out."""
    fs, where = _place(spark, path)
    root = fs.makeQualified(where).toUri().getPath().rstrip("/") + "/"
    found, files = {}, fs.listFiles(where, True)
    while files.hasNext():
        one = files.next()
        name = one.getPath().toUri().getPath()[len(root) :]
        if not name.startswith(f"{MANIFEST}/"):
            found[name] = one.getLen()
    return found


def save(model: MLWritable, path: str, overwrite: bool = False) -> None:
    """Write any writable model to the folder ``path``, which appears whole or not at all.

    An existing folder raises, unless it is to be replaced: then it stays until the new one is written.
    """
    spark = SparkSession.active()
    path = path.rstrip("/")
    fs, target = _place(spark, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    mark = uuid.uuid4().hex
    pending, aside = f"{path}.pending-{mark}", _place(spark, f"{path}.replaced-{mark}")[1]
    model.write().save(pending)
    kind = type(model)
    manifest = {"format": FORMAT, "spark": spark.version, "class": f"{kind.__module__}.{kind.__name__}", "files": _lengths(spark, pending)}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{pending}/{MANIFEST}")
    replaced = fs.exists(target) and fs.rename(target, aside)
    if fs.exists(target) or not fs.rename(_place(spark, pending)[1], target):
        if replaced:
            fs.rename(aside, target)
        raise OSError(f"could not rename {pending} to {path}")
    if replaced:
        fs.delete(aside, True)


def load(spark: SparkSession, path: str):
    """The model that ``save`` wrote to ``path``. A folder of a later format, or with files missing, raises."""
    path = path.rstrip("/")
    manifest = json.loads(spark.read.text(f"{path}/{MANIFEST}").first()["value"])
    if manifest["format"] > FORMAT:
        raise ValueError(f"{path} has format {manifest['format']}; this library reads up to {FORMAT}")
    found = _lengths(spark, path)
    missing = sorted(name for name, size in manifest["files"].items() if found.get(name) != size)
    if missing:
        raise ValueError(f"{path} lacks or has changed {', '.join(missing[:5])}")
    return DefaultParamsReader.loadParamsInstance(path, spark)
