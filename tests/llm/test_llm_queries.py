"""The numbered queries that SQL can express, against their SQL; the others at least run over the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import oracle

from plumbline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert oracle.difference(QUERIES[name](spark, SF), oracle.connect(SF), ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", ["op1_text_density", "op8_compression_toxicity", "op9_suffix_tree_lm"])
def test_a_row_for_each_row(spark, name):
    source = "pages" if name.startswith("op1_") else "documents"
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
