"""Nested studies of any learner over a run table that outlives failures.

A study is a folder: the dealt rows, the fitted column transformers of all
parts, a table of runs and the scores of each run. A run is one candidate on
one part; its scores are written first and its row in the run table last, so
a run that was cut off is not there and is done again. Failed runs have a row
with their error; they stop nothing and are tried again when the study is
resumed.
"""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import learners, metrics, splits, transformer
from gneiss.operators.modelling import judged_scores
from gneiss.sources.storage import materialize

RUN = "outer_fold int, inner_fold int, candidate string, status string, error string, n_fit long, n_held long, seconds double"


def estimator(name: str, **params) -> Callable[[DataFrame], Model]:
    """A fit of a named learner on ``features`` (a vector) and ``y``."""
    stages = learners.learner(name, ["features"], "y", **params).getStages()[1:]
    return lambda train: Pipeline(stages=stages).fit(train)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class Study:
    """Candidates (name: a fit on ``features``, ``y`` that gives a model) over nested stratified folds.

    ``key`` must be unique, ``target`` 0 or 1; rows without a target are left
    out. The columns of rows are those of the transformer. A folder belongs to
    one table and one layout of folds. ``at_once`` runs are fitted side by side.
    """

    def __init__(self, folder: str, key: str, target: str, numeric: Sequence[str], categorical: Sequence[str], candidates: dict[str, Callable[[DataFrame], Model]], outer: int = 5, inner: int = 3, least: int = 20, at_once: int = 1):
        self.folder, self.key, self.target = folder.rstrip("/"), key, target
        self.numeric, self.categorical, self.candidates = list(numeric), list(categorical), candidates
        self.outer, self.inner, self.least, self.at_once = outer, inner, least, at_once

    def _kept(self, spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table of the folder, made if it isn't whole there."""
        path = f"{self.folder}/{name}"
        if not exists(spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def prepare(self, dev: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Dealt rows (``own``: outer fold, ``deal``: inner fold) and the transformers of all parts, from one pass."""
        spark = dev.sparkSession

        def dealt() -> DataFrame:
            rows = dev.select(self.key, F.col(self.target).alias("y"), *self.numeric, *self.categorical)
            rows = splits.stratified(rows, self.key, "y", {"all": 1.0}, folds=self.outer * self.inner)
            return rows.withColumn("own", F.col("fold") % self.outer).withColumn("deal", F.floor(F.col("fold") / self.outer).cast("int")).drop("part", "fold")

        rows = self._kept(spark, "rows", dealt)
        parts = F.array(*(F.struct(F.lit(k).alias("outer_fold"), F.lit(j).alias("inner_fold")) for k, j in self.parts()))
        spread = rows.withColumn("p", F.explode(parts)).select("*", "p.*").drop("p").where((F.col("own") != F.col("outer_fold")) & (F.col("deal") != F.col("inner_fold")))
        states = self._kept(spark, "states", lambda: transformer.fit(spread, self.numeric, self.categorical, ["outer_fold", "inner_fold"], self.least))
        return rows, states

    def parts(self) -> list[tuple[int, int]]:
        """(k, j) leaves out outer fold k and inner fold j and scores j within the rest; (k, -1) is fitted on all but k and scores k."""
        return [(k, j) for k in range(self.outer) for j in range(-1, self.inner)]

    def runs(self, spark: SparkSession) -> DataFrame:
        """Every attempt so far."""
        path = f"{self.folder}/runs"
        return spark.read.schema(RUN).parquet(path) if exists(spark, path) else spark.createDataFrame([], RUN)

    def pending(self, spark: SparkSession) -> list[tuple[int, int, str]]:
        done = {(r.outer_fold, r.inner_fold, r.candidate) for r in self.runs(spark).where("status = 'done'").collect()}  # a row for each run
        return [(k, j, name) for name in self.candidates for k, j in self.parts() if (k, j, name) not in done]

    def run(self, dev: DataFrame) -> DataFrame:
        """All runs that aren't done yet; returns the run table."""
        spark = dev.sparkSession
        rows, states = self.prepare(dev)
        sizes = {(r.own, r.deal): r["count"] for r in rows.groupBy("own", "deal").count().collect()}  # a row for each fold
        pending = self.pending(spark)
        by = {(k, j): transformer.rows_of(states.where((F.col("outer_fold") == k) & (F.col("inner_fold") == j))) for k, j in dict.fromkeys((k, j) for k, j, _ in pending)}

        def one(run: tuple[int, int, str]) -> tuple:
            k, j, name = run
            began, error = time.time(), None
            n_fit = sum(n for (own, deal), n in sizes.items() if own != k and deal != j)
            n_held = sum(n for (own, deal), n in sizes.items() if (own != k and deal == j if j >= 0 else own == k))
            try:
                ready = rows.withColumn("features", array_to_vector(transformer.features(by[k, j])))
                outside, inner = F.col("own") != k, F.col("deal") == j
                fit, held = ready.where(outside & ~inner), ready.where(outside & inner if j >= 0 else ~outside)
                scored = learners.scores(self.candidates[name](fit.select("features", "y")), held.select(self.key, "y", "features"))
                scored.select(self.key, "y", "s").write.mode("overwrite").parquet(f"{self.folder}/scores/outer_fold={k}/inner_fold={j}/candidate={name}")
            except Exception:
                error = traceback.format_exc()[-2000:]
            return k, j, name, "failed" if error else "done", error, n_fit, n_held, time.time() - began

        # the short jobs of one fit leave room for those of others; the run table is written by this thread alone
        with ThreadPoolExecutor(self.at_once) as pool:
            for done in pool.map(inheritable_thread_target(spark)(one), pending) if self.at_once > 1 else map(one, pending):
                spark.createDataFrame([done], RUN).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")
        return self.runs(spark)

    def scores(self, spark: SparkSession) -> DataFrame:
        """Scores of every run that is done: ``outer_fold``, ``inner_fold``, ``candidate``, key, ``y``, ``s``."""
        done = self.runs(spark).where("status = 'done'").select("outer_fold", "inner_fold", "candidate").distinct()
        return spark.read.parquet(f"{self.folder}/scores").join(done, ["outer_fold", "inner_fold", "candidate"], "left_semi")

    def judged(self, spark: SparkSession, cost_fn: float = 10.0) -> DataFrame:
        """For each outer fold the best candidate by mean inner AUC, its threshold, outer AUC and optimism; only candidates whose runs are all done count."""
        scores = self.scores(spark)
        whole = self.runs(spark).where("status = 'done'").groupBy("candidate").agg(F.countDistinct("outer_fold", "inner_fold").alias("n")).where(F.col("n") == len(self.parts()))
        return judged_scores(scores.join(whole, "candidate", "left_semi"), cost_fn)

    def final(self, dev: DataFrame, test: DataFrame, cost_fn: float = 10.0) -> DataFrame:
        """The one evaluation on ``test`` of the candidate of the best inner AUC, refitted on all of ``dev``; kept, and only read the next time.

        Transformer state and model stay in the folder, so later rows are
        scored by :meth:`predict`.
        """
        spark = dev.sparkSession

        def evaluate() -> DataFrame:
            folds = self.judged(spark, cost_fn).collect()  # a row for each outer fold
            best = max(folds, key=lambda r: (r.inner_auc, -r.outer_fold)).candidate
            limits = sorted(r.cost_threshold for r in folds if r.cost_threshold is not None)
            limit = (limits[(len(limits) - 1) // 2] + limits[len(limits) // 2]) / 2 if limits else float("inf")
            rows = dev.where(F.col(self.target).isNotNull()).withColumn("y", F.col(self.target))
            transformer.fit(rows, self.numeric, self.categorical, least=self.least).write.mode("overwrite").parquet(f"{self.folder}/final_state")
            state = transformer.rows_of(spark.read.parquet(f"{self.folder}/final_state"))
            model = self.candidates[best](rows.select(array_to_vector(transformer.features(state)).alias("features"), "y"))
            model.write().overwrite().save(f"{self.folder}/final_model")
            scored = self.predict(test).select(F.col(self.target).alias("y"), "s").where("y is not null")
            scored = materialize(scored, "final_scores")  # two measures read it several times
            judged = metrics.ranking(scored).crossJoin(metrics.confusion(scored, limit))
            return judged.select(F.lit(best).alias("candidate"), F.lit(limit).alias("threshold"), "n", "auc", "ap", "tp", "fp", "fn", "tn")

        return self._kept(spark, "evaluation", evaluate)

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``s`` of the saved final model."""
        spark = rows.sparkSession
        state = transformer.rows_of(spark.read.parquet(f"{self.folder}/final_state"))
        ready = rows.withColumn("features", array_to_vector(transformer.features(state)))
        return learners.scores(PipelineModel.load(f"{self.folder}/final_model"), ready)


def optimism(judged: DataFrame) -> DataFrame:
    """Mean inner and outer AUC over outer folds and their difference."""
    return judged.agg(F.avg("inner_auc").alias("inner_auc"), F.avg("outer_auc").alias("outer_auc"), F.avg("optimism").alias("optimism"), F.count("*").alias("folds"))

