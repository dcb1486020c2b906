"""Executors that die in the middle of a run: the same rows in the end.

Runs a small cluster of three executors in a process of its own and kills one of them while stages are at work.
"""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent

RUN = """
import json, os, signal, subprocess, sys, threading, time
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
shared = {shared!r}
s = (SparkSession.builder.master("local-cluster[3,1,900]").config("spark.executor.memory", "700m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
     .config("spark.checkpoint.dir", "file://" + shared).config("spark.sql.warehouse.dir", shared + "/w").config("spark.sql.shuffle.partitions", "6").config("spark.default.parallelism", "6")
     .config("spark.sql.files.maxPartitionBytes", "200k").config("spark.sql.session.timeZone", "UTC").getOrCreate())
s.sparkContext.setLogLevel("OFF")
import __spark_entry__ as e
query = e.queries()[{name!r}]
drop = {drop!r}

def rows():
    df = query(s, "/root/testdata/sf0.01")
    df = df.select(*(c for c in df.columns if c not in drop))
    return df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()

def parent(p):
    with open("/proc/" + str(p) + "/stat") as f:
        return int(f.read().rpartition(")")[2].split()[1])

def executors():
    # executors among the processes that this one started: only those are ever killed.
    out = []
    for p in os.listdir("/proc"):
        try:
            if p.isdigit() and any(a.endswith(b".CoarseGrainedExecutorBackend") for a in open("/proc/" + p + "/cmdline", "rb").read().split(b"\\0")):
                up = parent(p)
                while up not in (0, 1, os.getpid()):
                    up = parent(up)
                if up == os.getpid():
                    out.append(int(p))
        except OSError:
            continue
    return out

first = rows()
killed = []
def kill():
    for _ in range(2):
        time.sleep(3)
        found = [p for p in executors() if p not in killed]
        if found:
            os.kill(found[0], signal.SIGKILL)  # one of our own three
            killed.append(found[0])
t = threading.Thread(target=kill, daemon=True)
t.start()
again = [rows()]
while t.is_alive():
    again.append(rows())
print("RESULT " + json.dumps([str(first), [str(a) for a in again], len(killed)]))
s.stop()
"""


@pytest.mark.parametrize("name,drop", [("op2_topk", []), ("op4_simhash", []), ("op6_substrings", []), ("op8_mixing", []), ("op10_lm", []), ("pipeline", ["sequence_id", "offset"])])
def test_killed_executors_change_nothing(tmp_path, name, drop):
    if os.environ.get("KEYSTRATA_KILL_TESTS") != "1":
        pytest.skip("minutes long: set KEYSTRATA_KILL_TESTS=1")
    code = RUN.format(root=str(ROOT), shared=str(tmp_path), name=name, drop=drop)
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=1200, env=os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"})
    line = next((x for x in out.stdout.splitlines() if x.startswith("RESULT ")), None)
    assert line, out.stderr[-2000:]
    first, again, killed = json.loads(line[7:])
    assert killed and all(a == first for a in again)
