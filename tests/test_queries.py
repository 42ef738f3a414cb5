"""Every registered query against its SQL; those without run and give rows."""

import pytest

import vecspark.queries  # noqa: F401
from tests.oracle import same
from vecspark import registry

SF = "/root/testdata/sf0.001"
SQL, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_imports_without_the_optional_subpackage():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def shifted(tmp_path, by: int) -> str:
    """A folder with the embeddings of SF under ids that begin at ``by``."""
    import duckdb

    duckdb.sql(f"COPY (SELECT vec_id + {by} AS vec_id, embedding, label FROM '{SF}/embeddings.parquet') TO '{tmp_path}/embeddings.parquet'")
    return str(tmp_path)


@pytest.mark.parametrize("by", [65_300, 16_777_000])
def test_places_of_large_ids_match_sql(spark, tmp_path, by):
    """Numbers of more than two bytes come back whole."""
    same(spark, QUERIES["packed_places"], SQL["packed_places"], shifted(tmp_path, by))


def test_updates_leave_unknown_ids_out_at_any_size(spark, tmp_path):
    """The base has the ids from 100,000 on beside the low ones."""
    import duckdb

    duckdb.sql(f"COPY (SELECT vec_id + k AS vec_id, embedding, label FROM '{SF}/embeddings.parquet', (VALUES (0), (99800)) t(k)) TO '{tmp_path}/embeddings.parquet'")
    same(spark, QUERIES["update_vectors"], SQL["update_vectors"], str(tmp_path))
