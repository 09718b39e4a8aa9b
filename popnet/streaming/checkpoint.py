"""Checkpoints of model results: a folder of Parquet batches under one identity.

Completed models are found by an anti-join, so a resumed run fits the rest only; the
weights of the first run are kept and used again, as sums may differ in their last digits
from run to run.  Before anything is reused, two things are checked: the identity (settings,
inputs by their digests, and the code and libraries that made the results), and a digest of
each target group's weights, a sum of wide row hashes that doesn't depend on the rows' order,
which is one grouped aggregate.  The domain has no event streams: batches of models are the
increments.
"""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Iterator
from importlib import metadata, resources

from pyspark.sql import DataFrame, SparkSession, functions as F

from popnet.operators.checks import InputError, require_none
from popnet.storage import delete_path, exists

KEYS = ["target_group", "target"]
#: Libraries whose versions are part of an identity.
LIBRARIES = ("numpy", "pyspark", "pyarrow", "pandas")
#: Folders whose code takes no part in a run's results.
ASIDE = ("llm", "__pycache__")


def _sources(folder, at: str = "") -> Iterator[tuple[str, bytes]]:
    for item in sorted(folder.iterdir(), key=lambda i: i.name):
        if item.is_dir() and item.name not in ASIDE:
            yield from _sources(item, f"{at}{item.name}/")
        elif item.name.endswith(".py"):
            yield at + item.name, item.read_bytes()


def implementation() -> str:
    """A digest of this package's code and of the versions of what it runs on."""
    digest = hashlib.sha256(json.dumps([platform.python_version(), *[metadata.version(x) for x in LIBRARIES]]).encode())
    for name, code in _sources(resources.files("popnet")):
        digest.update(f"{name}\0{len(code)}\0".encode() + code)
    return digest.hexdigest()


def identity(parameters: dict, inputs: dict[str, str]) -> str:
    """What decides the results, as text: a digest of the settings, one of each input, and one of the implementation; paths and resources stay out."""
    settings = hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()
    return json.dumps({"parameters": settings, "inputs": inputs, "implementation": implementation()}, sort_keys=True)


def weight_digests(weights: DataFrame) -> DataFrame:
    """(target_group, rows, digest): the sums of four 64-bit parts of each row's SHA-256; equal for equal rows in any order and partitioning."""
    row = F.sha2(F.concat_ws("\x00", F.col("cell").cast("string"), F.col("cell_ord").cast("string"), F.col("final_weight").cast("string")), 256)
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).cast("string")
    hashed = weights.select(F.col("target_group").cast("string").alias("target_group"), row.alias("h"))
    return hashed.groupBy("target_group").agg(F.count("*").alias("rows"), F.concat_ws("-", *[part(i) for i in range(4)]).alias("digest"))


class Checkpoint:
    """A folder with ``_identity`` (one row), ``weights``, their digests and ``results``."""

    def __init__(self, spark: SparkSession, path: str, digest: str) -> None:
        self.spark, self.path, self.digest = spark, path.rstrip("/"), digest

    def _has(self, name: str) -> bool:
        return exists(self.spark, f"{self.path}/{name}")

    def open(self, resume: bool) -> None:
        """Start, or go on: an identity other than the run's is an error, as is a checkpoint when not resuming."""
        if self._has("_identity"):
            if not resume:
                raise FileExistsError(f"A checkpoint exists: {self.path}; resume it or remove it")
            known, own = (json.loads(x) for x in (self.spark.read.parquet(f"{self.path}/_identity").first()[0], self.digest))
            differing = sorted(k for k in known.keys() | own.keys() if known.get(k) != own.get(k))
            if differing:
                raise InputError(f"The checkpoint belongs to another run: it differs in {', '.join(differing)}")
        elif resume:
            raise FileNotFoundError(f"No checkpoint to resume: {self.path}")
        else:
            self.spark.createDataFrame([(self.digest,)], "identity string").write.parquet(f"{self.path}/_identity")

    def weights(self, computed: DataFrame) -> DataFrame:
        """The stored weights, stored now if there are none; a group whose weights aren't those that were stored is an error."""
        fresh = not self._has("weight-digests/_SUCCESS")
        if fresh:
            computed.write.mode("overwrite").parquet(f"{self.path}/weights")
        kept = self.spark.read.parquet(f"{self.path}/weights")
        if fresh:
            weight_digests(kept).write.mode("overwrite").parquet(f"{self.path}/weight-digests")
        else:
            known, now = self.spark.read.parquet(f"{self.path}/weight-digests"), weight_digests(kept)
            changed = known.exceptAll(now).unionByName(now.exceptAll(known)).select("target_group").distinct()
            require_none(changed, "target_group", "The checkpoint's weights have changed in target groups")
        return kept

    def results(self, schema: str) -> DataFrame:
        """All batches that were completed; a batch without its success mark doesn't count."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/results/*/_SUCCESS")
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(root)
        done = [str(f.getPath().getParent().toString()) for f in found or []]
        return self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)

    def append(self, number: int, results: DataFrame) -> None:
        """Write a batch; its name is new for each attempt of a run."""
        results.write.mode("overwrite").parquet(f"{self.path}/results/batch-{number:06d}")

    def next_number(self) -> int:
        """The first unused batch number."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/results/batch-*")
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(root)
        return max((int(f.getPath().getName().rpartition("-")[2]) for f in found or []), default=-1) + 1

    def remove(self) -> None:
        """Delete the folder."""
        delete_path(self.spark, self.path)


def remaining(requested: DataFrame, done: DataFrame) -> DataFrame:
    """Requested models without a result."""
    return requested.join(done.select(*KEYS), KEYS, "left_anti")


def completed_counts(done: DataFrame) -> DataFrame:
    """(target_group, completed)."""
    return done.select(*KEYS).distinct().groupBy("target_group").agg(F.count("*").alias("completed"))
