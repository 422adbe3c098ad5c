import os

import pytest

from skein.llm import queries
from tests.oracle import SMALL, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
COLUMNS = {"p1_found": "chunk_key cut", "p2_found": "page_key line_no noise", "p3_found": "chunk_key lang_code", "p4_found": "chunk_key_a chunk_key_b", "p5_found": "conv_id turn defect", "p6_found": "doc_id item_id", "p8_found": "doc_id band"}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs(spark, name):
    df = queries.queries()[name](spark, SMALL)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split()
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name])
