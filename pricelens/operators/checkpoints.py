"""Checkpoints of a training run: a manifest replaced in one step, a limit on how many are kept.

A run's folder holds one folder a checkpoint and ``manifest.json``, which lists the
epochs done so far (each with its metrics and the path of its checkpoint, null once
that is deleted), the best of them and the run's settings.  A checkpoint counts from the moment the
manifest names it: the manifest is written beside and renamed over the old one, so a reader
sees the state before or after an epoch, never between.  Checkpoints beyond
the limit are deleted after that, so a manifest never names one that is gone; the
last one and the best one always stay.  What a failed attempt left is not
named and is overwritten by no one: every attempt writes to a new path.

Paths are Hadoop paths, so any store the cluster reads will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

MANIFEST = "manifest.json"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


class Run:
    """The checkpoints under ``folder``; at most ``keep`` of them, ``metric`` (lower is better) names the best."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 10, metric: str = "rmse"):
        if keep < 2:
            raise ValueError("the last and the best checkpoint are always kept: keep must be 2 at least")
        self.spark, self.folder, self.keep, self.metric = spark, folder.rstrip("/"), keep, metric

    def manifest(self) -> dict | None:
        """The manifest, or None where there is no run yet."""
        if not _store(self.spark, self.folder).exists(_path(self.spark, f"{self.folder}/{MANIFEST}")):
            return None
        rows = self.spark.read.text(f"{self.folder}/{MANIFEST}", wholetext=True).collect()  # one small file
        return json.loads(rows[0]["value"])

    def new_path(self, epoch: int) -> str:
        """Where an attempt at an epoch may write its checkpoint."""
        return f"{self.folder}/checkpoint-{epoch}-{uuid.uuid4().hex[:12]}"

    def commit(self, epoch: int, path: str, metrics: dict, settings: dict | None = None) -> dict:
        """Name a written checkpoint in the manifest and delete what is beyond the limit; the new manifest."""
        old = self.manifest() or {"epochs": [], "settings": settings or {}}
        done = [e for e in old["epochs"] if e["epoch"] < epoch]  # an epoch done again drops what followed it
        done.append({"epoch": epoch, "path": path, "metrics": metrics})
        known = [e for e in done if e["metrics"].get(self.metric) is not None]
        best = min(known, key=lambda e: (e["metrics"][self.metric], e["epoch"]))["epoch"] if known else epoch
        held = [e["epoch"] for e in done if e["path"] and e["epoch"] not in (best, epoch)]
        spare = self.keep - len({best, epoch})
        stay = {best, epoch, *held[len(held) - spare:]} if spare else {best, epoch}
        gone = {e["path"] for e in old["epochs"] if e["path"]} - {e["path"] for e in done if e["epoch"] in stay}
        for e in done:
            if e["epoch"] not in stay:
                e["path"] = None
        new = {"epochs": done, "best": best, "last": epoch, "settings": old["settings"]}
        self._replace(new)
        store = _store(self.spark, self.folder)
        for p in gone:
            store.delete(_path(self.spark, p), True)
        return new

    def _replace(self, manifest: dict) -> None:
        spark, jvm = self.spark, self.spark._jvm
        target = _path(spark, f"{self.folder}/{MANIFEST}")
        store = _store(spark, self.folder)
        beside = _path(spark, f"{self.folder}/.{MANIFEST}-{uuid.uuid4().hex}")
        store.mkdirs(_path(spark, self.folder))
        out = store.create(beside, True)
        try:
            out.write(bytearray(json.dumps(manifest, indent=1).encode()))
        finally:
            out.close()
        rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
        files.rename(beside, target, options)

    def checkpoint(self, epoch: int | None = None) -> dict:
        """The manifest's entry of an epoch (default: the best one); its checkpoint is there."""
        told = self.manifest()
        if told is None or not told["epochs"]:
            raise FileNotFoundError(f"no trained model under {self.folder}; run the training job first")
        wanted = told["best"] if epoch is None else epoch
        for e in told["epochs"]:
            if e["epoch"] == wanted:
                if e["path"] is None:
                    raise FileNotFoundError(f"the checkpoint of epoch {wanted} under {self.folder} is no longer kept")
                return e
        raise FileNotFoundError(f"no epoch {wanted} under {self.folder}")
