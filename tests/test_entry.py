"""The driver's contract."""

import subprocess
import sys

import __spark_entry__ as entry


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert queries and set(oracles) <= set(queries)


def test_import_without_the_training_data_operators():
    """The entry imports where neither the subpackage nor the pipeline is installed."""
    hide = "import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n in ('tesserae.llm', 'corpus_pipeline') else f(n, *a); import __spark_entry__ as e; assert e.queries(); assert not [n for n in e.queries() if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", hide], check=True, cwd=entry.__file__.rsplit("/", 1)[0])


def test_entry(spark):
    rows = entry.entry(spark).collect()
    total = [r for r in rows if r.source == "TOTAL"]
    assert len(total) == 1 and total[0].samples == sum(r.samples for r in rows) // 2
