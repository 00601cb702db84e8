"""The session's settings, and refusals."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Refused(ValueError):
    """A question to which any answer would be a plausible wrong one."""


SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, **more: str) -> SparkSession:
    b = SparkSession.builder.appName("tessera")
    b = b.master(master) if master else b
    for k, v in (SETTINGS | more).items():
        b = b.config(k, v)
    return b.getOrCreate()


def check(spark: SparkSession) -> list[str]:
    """Settings on which answers depend and that differ here."""
    return [f"{k} is {spark.conf.get(k, None)}, not {v}" for k, v in SETTINGS.items() if (spark.conf.get(k, None) or "") != v]


def local_folder(context) -> str:
    """A folder for checkpoints where the session names none. On a cluster that would be another machine's disk: refused."""
    if not context.master.startswith("local"):
        raise Refused("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints/tessera"


def shared_cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the folder that all executors share; one is set only where none is (tests)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or local_folder(context))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Let the executors' Python import this package when neither PYTHONPATH nor the working folder has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    places = os.environ.get("PYTHONPATH", "").split(":") + [os.getcwd()]
    if any(os.path.exists(os.path.join(p, "tessera")) for p in places if p) or getattr(spark.sparkContext, "_tessera_shipped", False):
        return
    with tempfile.TemporaryDirectory() as d:
        at = os.path.join(d, "tessera.zip")
        with zipfile.ZipFile(at, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "tessera")):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
        spark.sparkContext.addPyFile(at)
    spark.sparkContext._tessera_shipped = True


def within(spark: SparkSession, seconds: float, action: Callable[[], object]):
    """What `action` gives, or a refusal once its Spark jobs have taken more than `seconds`: they are cancelled."""
    context, group, late = spark.sparkContext, uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "a query with a deadline", True)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise Refused(f"the query took more than {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
