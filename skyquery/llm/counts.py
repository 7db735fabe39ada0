"""Token counts as delta-maintained rollups.

Changes - inserted, deleted and revised documents - become signed counts, which are summed by
source, language and tokenizer version and committed as batches. Totals are sums of batches,
so nothing is ever counted anew. A batch is a folder named after its id. It is written aside and renamed when
it is whole, which fails if the batch is there: commits can be repeated at will, and of two at once one
counts. ``fold`` sums batches up, so that totals read few files however many batches there have been.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, slices, spare_name
from .tokens import Encoder

KEYS = ("source", "lang", "version")
CHANGE = "source string, lang string, version string, docs long, tokens long"


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) with ``tokens``: the number of ids of each whole text, 0 if it is null."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("tokens", text_column)]
    source = spare_name(keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_column).alias(source))
    schema = rows.drop(source).withColumn("tokens", F.lit(0).cast("long")).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        for part, texts in slices(batches, source):
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(encoder.counts(texts).astype(np.int64))], names=[*keep, "tokens"])

    return mapped(rows, task, schema)


def inserted(counts: DataFrame) -> DataFrame:
    """Changes that add documents (source, lang, version, tokens)."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Changes that take documents away, given as they were counted."""
    return inserted(counts).select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that replace counts: what was counted before is taken away and what is counted now added, whatever column differs."""
    return deleted(before).unionByName(inserted(after))


class Rollup:
    """The batches below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch) or batch.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch!r}")
        return f"{self.root}/batch={batch}"

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._path(path)
        return bool(fs.exists(p))

    def _names(self, prefix: str) -> list[str]:
        fs, path = self._path(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))

    def _publish(self, folder: str, **tables: DataFrame) -> bool:
        """Writes the tables below a folder of another name and renames it; False if the folder has been there first."""
        sc = self.spark.sparkContext
        fs, aside = self._path(f"{self.root}/_aside-{uuid.uuid4().hex}")
        for name, table in tables.items():
            table.write.parquet(f"{aside.toString()}/{name}")
        target = self._path(folder)[1]
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(aside).toUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(target), sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError:
            fs.delete(aside, True)
            if not fs.exists(target):
                raise
            return False
        return True

    def _folded(self) -> tuple[str | None, set[str]]:
        """The latest fold's folder and the batches in it."""
        folds = self._names("fold=")
        if not folds:
            return None, set()
        latest = f"{self.root}/fold={folds[-1]}"
        return latest, {r[0] for r in self.spark.read.schema("batch string").parquet(f"{latest}/batches").collect()}

    def committed(self, batch: str) -> bool:
        return self._exists(self._folder(batch)) or batch in self._folded()[1]

    def batches(self) -> list[str]:
        """All batches ever committed."""
        return sorted({*self._names("batch="), *self._folded()[1]})

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Sums the signed changes and writes them as one batch; False, with nothing done, if the batch is there. Null keys are groups of their own; no changes are a batch as well."""
        folder = self._folder(batch)
        if self.committed(batch):
            return False
        return self._publish(folder, changes=_summed(changes).coalesce(1))

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) over all committed batches, without groups that have come to nothing."""
        latest, folded = self._folded()
        parts = [f"{latest}/totals"] * (latest is not None) + [f"{self._folder(b)}/changes" for b in self._names("batch=") if b not in folded]
        rows = self.spark.read.schema(CHANGE).parquet(*parts) if parts else self.spark.createDataFrame([], CHANGE)
        return _summed(rows)

    def fold(self) -> bool:
        """Sums the batches up in one table and remembers their ids; totals stay as they are. False if there is nothing new or another fold was first."""
        _, folded = self._folded()
        every = {*self._names("batch="), *folded}
        if every == folded:
            return False
        number = int(max(self._names("fold="), default="0")) + 1
        ids = self.spark.createDataFrame([(b,) for b in sorted(every)], "batch string")
        return self._publish(f"{self.root}/fold={number:09}", totals=self.totals().coalesce(1), batches=ids.coalesce(1))

    def purge(self) -> None:
        """Deletes the folders of folded batches and of earlier folds: for when nobody reads totals made before the latest fold."""
        latest, folded = self._folded()
        old = [self._folder(b) for b in self._names("batch=") if b in folded] + [f for f in (f"{self.root}/fold={n}" for n in self._names("fold=")) if f != latest]
        for folder in old:
            fs, path = self._path(folder)
            fs.delete(path, True)


def _summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")
