"""The registered queries: those with SQL give what DuckDB gives, the others the columns of their contracts for all rows."""

import os

import duckdb
import pytest

from pairlens.llm import queries

from ..test_queries import rows

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ngram_jaccard": ("documents", "doc_id n_shingles component_id"),
    "op2_sharding": ("documents", "doc_id size text_crc32 law shard slot grown_shard"),
    "op3_mixing": ("documents", "doc_id size source_size target taken"),
    "op4_flac_media": ("documents", "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature"),
    "op5_language_id": ("documents", "doc_id held_out lang_pred score"),
    "op8_suffix_dedup": ("documents", "doc_id n_bytes n_removed n_spans kept_sha256"),
    "op10_packing": (None, "doc_id start length ids_crc32 doc_tokens sequence_id offset"),
    "op11_swap_packing": (None, "doc_id piece start length ids_crc32 sequence_id offset"),
    "op12_periodic_runs": ("documents", "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256"),
    "op13_whitening": (None, "vec_id component n deviation whitened explained identity_error"),
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, duck, name):
    df, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, duck, name):
    table, columns = COLUMNS[name]
    df = queries.QUERIES[name](spark, SF)
    assert set(columns.split()) <= set(df.columns)
    ident = df.columns[0]
    got = [r[ident] for r in df.collect()]
    ids = sorted(r[0] for r in duck.sql(f"SELECT {ident} FROM {'documents' if ident == 'doc_id' else 'embeddings'}").fetchall())
    assert (sorted(got) if table else sorted(set(got))) == ids


def test_all_are_covered():
    assert set(COLUMNS) | set(queries.ORACLE) == set(queries.QUERIES)
