"""The pipeline against brute-force versions of its stages, and the registration."""

import corpus_pipeline as C
import pytest
from llm_cases import documents
from test_exact_dedup import brute as brute_exact
from test_packing import check_packed
from test_secret_scan import brute_base
from test_simhash import brute_components, brute_fingerprint

import __spark_entry__ as E
from exposa.llm import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in C.STAGES:
        out.append(stage(spark, out[-1], SF).persist())
    return out


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_quality(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in quality.score(stages[0], labels).collect() if r["kept"]}
    assert pairs(stages[1]) == [p for p in pairs(stages[0]) if p[0] in kept]
    assert 0.7 < stages[1].count() / stages[0].count() < 1


def test_exact(stages):
    kept = {r[0] for r in brute_exact(pairs(stages[1])) if r[3]}
    assert pairs(stages[2]) == [p for p in pairs(stages[1]) if p[0] in kept]


def test_near(stages):
    rows = pairs(stages[2])
    names = brute_components([(d, brute_fingerprint(t)) for d, t in rows])
    assert pairs(stages[3]) == [p for p, c in zip(rows, names) if p[0] == c]


def test_secrets(stages):
    before, after = dict(pairs(stages[3])), dict(pairs(stages[4]))
    assert before.keys() == after.keys()
    assert any(brute_base(t) for t in before.values())
    for d, t in after.items():
        assert not brute_base(t) and (t == before[d] or "[" in t)


def test_packing(stages):
    check_packed(stages[5].collect(), 2048, pairs(stages[4]))


def test_columns_stay(stages):
    for df in stages[:5]:
        assert df.columns == stages[0].columns


def test_run(spark, stages):
    a, b = C.run(spark, SF), stages[5]
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, a.select(key).collect())) == sorted(map(tuple, b.select(key).collect()))


def test_awkward_rows(spark):
    df = documents(spark)
    for _, stage in C.STAGES:
        df = stage(spark, df, SF)
    assert df.count() > 0
    df = documents(spark, [])
    for _, stage in C.STAGES:
        df = stage(spark, df, SF)
    assert df.count() == 0


def test_registered():
    names = E.queries().keys()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_workers_need_no_path(tmp_path):
    """The entry module, loaded by path from another folder, works without PYTHONPATH."""
    import os
    import subprocess
    import sys
    script = tmp_path / "run.py"
    script.write_text(f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", {os.path.abspath(E.__file__)!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", entry.queries()["op2_url_filter"](spark, {SF!r}).count())
""")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 50" in out.stdout, out.stderr[-2000:]
