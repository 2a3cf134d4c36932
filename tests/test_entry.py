"""The entry module stands with and without the training-data part; queries match their SQL."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_without_the_extra_part(tmp_path):
    for name in ("__spark_entry__.py", "wordloom"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path / "e.py")
    (tmp_path / "e.py").rename(tmp_path / "entry_copy.py")
    shutil.copytree(ROOT / "wordloom", tmp_path / "wordloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import entry_copy as e; q = e.queries(); assert 'tokens_per_lang' in q and not any(x.startswith('op') and x[2].isdigit() for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["split_words", "encode_string_bpe", "encode_id_bpe", "merge_rules_resolve", "pair_counts"])
def test_query_matches_sql(spark, name):
    import __spark_entry__ as e
    import duckdb

    df = e.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as from '{p}'")
    cur = con.execute(e.oracle_sql()[name])
    at = [[x[0] for x in cur.description].index(c) for c in columns]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in cur.fetchall())
