"""Every query of the index engine against its SQL; the entry module without the training-data operators."""

import os
import subprocess
import sys

import pytest

from tessera import queries
from tessera.operators import ranges

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, same_rows):
    same_rows(queries.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_without_sql(name, spark, sf_dir):
    assert queries.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("script", [False, True])
def test_entry_without_llm(tmp_path, script):
    """The folders of the training-data operators deleted, the pipeline's script deleted too or still there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if script else [])):
        with open(tmp_path / name, "w") as f:
            f.write(open(f"{root}/{name}").read() if os.path.exists(f"{root}/{name}") else "import tessera.llm.common")
    os.makedirs(tmp_path / "tessera/llm/__pycache__")
    for name in os.listdir(f"{root}/tessera"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/tessera/{name}", tmp_path / "tessera" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_broken_operators_are_an_error(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with open(tmp_path / "__spark_entry__.py", "w") as f:
        f.write(open(f"{root}/__spark_entry__.py").read())
    os.makedirs(tmp_path / "tessera/llm")
    for name in os.listdir(f"{root}/tessera"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/tessera/{name}", tmp_path / "tessera" / name)
    for name in ("__init__.py", "queries.py"):
        with open(tmp_path / "tessera/llm" / name, "w") as f:
            f.write("import no_such_module_at_all\n" if name == "queries.py" else "")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode and "no_such_module_at_all" in done.stderr


def test_a_rewritten_table_gets_a_new_index(spark, tmp_path):
    """The index queries answer from the table as it is, also when a file is replaced under its name or the index is gone."""
    write = lambda *texts: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    terms = lambda: {r["term"] for r in queries.queries()["term_df"](spark, str(tmp_path)).collect()}
    write("alpha beta", "gamma")
    first = terms()
    write("omega sigma", "zeta", "theta")
    assert {"alpha", "beta", "gamma"} <= first and {"omega", "sigma", "zeta", "theta"} <= terms() and not {"alpha", "gamma"} & terms()
    key = queries._input(spark, str(tmp_path))
    ranges.delete(spark, queries._WRITTEN[key])
    assert "omega" in terms()
