"""Corpus queries against their DuckDB oracles, and what the driver may take away."""

import os
import shutil
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_chat_format", "op7_decontaminate", "op10_exact_dedup", "op11_source_audit", "op12_quality_rules",
                                  "op13_collocations"])
def test_query_matches_oracle(spark, name):
    from churnlens.llm.queries import ORACLES, QUERIES
    from oracle_harness import compare, duck
    res = compare(spark, SF, name, QUERIES[name], ORACLES[name], duck(SF))
    assert res["status"] == "match", res


def test_entry_imports_without_the_corpus_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)
