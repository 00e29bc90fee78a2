"""Every query of the subpackage: against its SQL, or for its columns and rows."""

import os

import pytest

from catalens.llm.registered import ORACLE, QUERIES
from compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op2_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8_license_scan": [
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
    ],
    "op10_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op11_toxicity": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) - set(ORACLE) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    rows, problems = compare(QUERIES[name](spark, SF_DIR), con, ORACLE[name])
    assert not problems, problems
    assert rows


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert QUERIES[name](spark, SF_DIR).columns == COLUMNS[name]
