"""The driver contract: names, twins, and the import guard."""

import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from mosaiq.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "asDict"):
        v = list(v.asDict().values())
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else repr(v)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        return
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert sorted(plain(r) for r in rows) == sorted(plain([r[k] for k in at]) for r in found.fetchall())


def test_the_rest_imports_without_the_corpus_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('mosaiq.llm'):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'readiness_by_source' in e.queries() and not any(n.startswith('op') for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)


def test_nothing_else_imports_the_corpus_subpackage():
    for p in (ROOT / "mosaiq").rglob("*.py"):
        if "llm" not in p.parts:
            assert "mosaiq.llm" not in p.read_text(), p


def test_workers_without_a_path_get_the_package():
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
import __spark_entry__ as e
print('ROWS', e.queries()['scene_filter'](s, '/root/testdata/sf0.001').count())
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=120)
    assert "ROWS 8" in done.stdout, done.stderr[-2000:]


def test_a_sheet_rounds_balances_as_its_twin(spark, tmp_path):
    """Balances near a half of a cent, where rounding the shortest decimal and rounding the double differ; large and negative ones."""
    rng = np.random.default_rng(3)
    cents = rng.integers(-10**6, 10**6, 400) / 100
    values = [4857.85 + 0.005, 1.005, 0.125, -0.125, -0.001, 0.0, 9999999.999, 12345678.9, -98765432.1, *(cents + 0.005).tolist(), *cents.tolist()]
    rows = [(k, f"Customer#{k}", 1, v, "M") for k, v in enumerate(values)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    found = catalogue.QUERIES["sheet_round_trip"](spark, str(tmp_path)).select("record_id", "notes", "balance").collect()
    assert sorted(tuple(r) for r in found) == sorted(c.execute(catalogue.ORACLES["sheet_round_trip"]).fetchall())


@pytest.mark.parametrize("name", ["detail_reading", "digit_reading"])
def test_drawn_images_fit_a_worker(tmp_path, name):
    """A single batch of keys, whose images would take more than 1 GB as lists; the peak is read in the worker that drew them."""
    code = f"""
import re, sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
import __spark_entry__ as e
s.range(3000).selectExpr('id AS c_custkey').write.parquet({f"{tmp_path}/customer.parquet"!r})
e.queries()[{name!r}](s, {str(tmp_path)!r}).write.parquet({f"{tmp_path}/out"!r})
def peak(batches):
    yield from batches
    print('MB', int(re.search('VmHWM: *([0-9]+)', open('/proc/self/status').read().replace(chr(9), ' '))[1]) // 1024, file=sys.stderr, flush=True)
s.range(1).mapInArrow(peak, 'id long').collect()
print('ROWS', s.read.parquet({f"{tmp_path}/out"!r}).count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert "ROWS 3000" in done.stdout, done.stderr[-2000:]
    peak = [int(x.split()[1]) for x in done.stderr.splitlines() if x.startswith("MB ")]
    assert peak and max(peak) < 600
