"""The registered queries on the smallest tables: those with SQL against DuckDB, the others against their contract."""

import os
import zlib

import duckdb
import pytest

from tests.test_queries import rows
from thicket.llm import registry

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_url_filters": ["page_id", "host", "path", "rule", "verdict"],
    "op2_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op3_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op5_pii": ["doc_id", "text", "n_found"],
    "op6_ann": ["query_id", "rank", "vec_id", "score"],
    "op7_brown_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op8_token_counts": ["doc_id", "n_tokens"],
    "op9_simhash": ["doc_id", "fingerprint", "component_id"],
    "op10_language_id": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(db.execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", list(COLUMNS))
def test_every_row_of_its_table_has_a_result(spark, db, name):
    out = registry.queries()[name](spark, DATA)
    assert out.columns[: len(COLUMNS[name])] == COLUMNS[name]
    got = out.select(COLUMNS[name][0]).collect()
    if name == "op6_ann":
        want = db.execute("SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0").fetchall()
        assert sorted(r[0] for r in got) == sorted(i for (i,) in want for _ in range(10))
        return
    table, key = ("pages", "page_id") if name == "op1_url_filters" else ("documents", "doc_id")
    ids = [i for (i,) in db.execute(f"SELECT {key} FROM {table}").fetchall()]
    if name == "op4_packing":
        got = out.where("piece = 0").select("doc_id").collect()
    assert sorted(r[0] for r in got) == sorted(ids)


def test_held_out_rows_are_those_of_their_fold(spark):
    for name, mod, rest in (("op7_brown_lm", 5, 1), ("op10_language_id", 5, 0)):
        got = registry.queries()[name](spark, DATA).select("doc_id", "held_out").collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in got)
