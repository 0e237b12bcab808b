"""python tests/executor_loss.py DIR QUERY...: runs each query on a local cluster of three executors, then again while one is lost, and compares the rows.

Only processes that this script's own Spark driver started are ended.
"""

import importlib.util
import os
import shutil
import sys
import tempfile
import threading
import time
from pathlib import Path

import psutil

REPO = str(Path(__file__).resolve().parent.parent)


def main(d, names):
    work = Path(tempfile.mkdtemp(prefix="loss-"))
    for x in ("home/work", "shared", "local"):
        (work / x).mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # executors write their logs to Spark's home
        if p.name != "work":
            (work / "home" / p.name).symlink_to(p)
    os.environ.update(SPARK_HOME=str(work / "home"), SPARK_SCALA_VERSION="2.13", SPARK_LOCAL_DIRS=str(work / "local"), PYSPARK_PYTHON=sys.executable, PYTHONPATH=REPO, SPARK_LOCAL_IP="127.0.0.1")
    sys.path.insert(0, REPO)
    from pyspark.sql import SparkSession

    import __spark_entry__

    conf = {"spark.master": "local-cluster[3,2,3000]", "spark.executor.memory": "1800m", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "12"}
    spark = SparkSession.builder.config(map=conf | {"spark.checkpoint.dir": f"file://{work}/shared", "spark.driver.host": "127.0.0.1"}).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    run = lambda n: sorted(map(str, __spark_entry__.queries()[n](spark, d).collect()))

    def lose(after):
        time.sleep(after)
        executors = [p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline())]
        if executors:
            executors[0].kill()

    bad = 0
    for n in names:
        run(n)
        began = time.time()
        want = run(n)
        took = time.time() - began
        for share in (0.3, 0.6, 0.85):
            loss = threading.Thread(target=lose, args=(took * share,))
            loss.start()
            same = run(n) == want
            loss.join()
            bad += not same
            print(f"{n}: {len(want)} rows, executor lost after {took * share:.1f} of {took:.1f} s: {'same' if same else 'DIFFERENT'}", flush=True)
            time.sleep(3)
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
