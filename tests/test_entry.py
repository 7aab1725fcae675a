import importlib.util
import subprocess
import sys

import __spark_entry__ as entry_points


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_names():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    """The rest of the library works where that subpackage and the pipeline are not installed."""
    root = importlib.util.find_spec("plumeline").submodule_search_locations[0]
    code = (
        "import importlib.util as u; found = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n in ('plumeline.llm', 'corpus_pipeline') else found(n, *a)\n"
        "import sys; import __spark_entry__ as e; assert e.queries() and e.oracle_sql()\n"
        "assert not [m for m in sys.modules if m.startswith('plumeline.llm') or m == 'corpus_pipeline']\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root + "/..", check=True)


def test_names_of_the_benchmark():
    import bench

    names = bench.headlines(entry_points.queries())
    assert set(names) <= set(entry_points.queries()) and names[: len(bench.HEADLINES)] == bench.HEADLINES and "opt_anchor" not in names
    assert bench.headlines(["op10_b", "op2_a", "opt_anchor"])[len(bench.HEADLINES) :] == ["op2_a", "op10_b"]
