"""Memory of executors beside the driver, which a local session doesn't have: these tests start a small cluster."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark

#: Fills the executor's heap with what sorts and sums leave behind; prints its JVM's MB before and after a stage begins.
RUN = """
import json, os, re, sys
from pathlib import Path

from pyspark.sql import SparkSession

conf = {"spark.master": "local-cluster[1,2,1800]", "spark.executor.memory": "1200m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.checkpoint.dir": f"file://{sys.argv[1]}/shared", "spark.sql.warehouse.dir": f"{sys.argv[1]}/warehouse"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")


def jvm(batches):
    import pyarrow as pa

    pid = os.getppid()
    while "CoarseGrainedExecutorBackend" not in Path(f"/proc/{pid}/cmdline").read_text():
        pid = int(re.search(r"PPid:\\s+(\\d+)", Path(f"/proc/{pid}/status").read_text())[1])
    for _ in batches:
        yield pa.RecordBatch.from_pydict({"mb": [int(re.search(r"RssAnon:\\s+(\\d+)", Path(f"/proc/{pid}/status").read_text())[1]) // 1024]})


def measured():
    return spark.range(0, 1, 1, 1).mapInArrow(jvm, "mb long").first()["mb"]


import corpus_pipeline

docs = spark.createDataFrame([(1, "password = abcdefgh12345678")], "doc_id long, text string")
for _ in range(3):
    spark.range(2_000_000).selectExpr("xxhash64(id) k", "repeat('x', 200) t").repartition(4, "k").sortWithinPartitions("k").write.format("noop").mode("overwrite").save()
before = measured()
kept = corpus_pipeline.secrets(spark, docs, "").count()
print("MB", json.dumps([before, measured(), kept]))
spark.stop()
"""


def test_a_stage_begins_with_small_executors(tmp_path):
    home = tmp_path / "home"  # where executors work
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    said = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "MB" in said.stdout, said.stderr[-2000:]
    before, after, kept = json.loads(said.stdout.rpartition("MB")[2])
    assert kept == 1
    assert after < before - 100, (before, after)
