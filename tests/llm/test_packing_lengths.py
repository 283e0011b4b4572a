"""op1's lengths: words against Python's own, and memory that follows the text and not its number of words."""

import os
import re
import subprocess
import sys
from pathlib import Path

import numpy as np

from loamgrid.llm import packing

ROOT = Path(__file__).resolve().parents[2]

#: 20 MB of short words: an array of them does not fit into this heap.
LONG = """
from pyspark.sql import SparkSession, functions as F
from loamgrid.llm.packing import word_lengths
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("repeat('ab c ', 4000000)").alias("text"))
print("tokens", word_lengths(docs).head().n_tokens)
"""


def test_lengths_against_python(spark):
    rng = np.random.default_rng(17)
    marks = [" ", "\t", "\n", "\v", "\f", "\r", "\x00", "\x1c", "\x1f", "\x85", " ", " ", "　", "a", "x", "$1", "\\", "é", "中", "\U0001f600"]
    texts = ["".join(rng.choice(marks, rng.integers(0, 25))) for _ in range(400)]
    texts += [None, "", " ", " " * 50_000, "\n\r" * 50_000 + "a", "a" + "\t" * 50_000, "b" * 50_000, " a b", "a b ", "x x  x\n"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in packing.word_lengths(table).collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for i, t in enumerate(texts)}


def test_lengths_of_a_long_text_fit_a_small_heap(tmp_path):
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": "--driver-memory 512m pyspark-shell"}
    run = subprocess.run([sys.executable, "-c", LONG], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "tokens 8000001" in run.stdout, run.stderr[-500:]
