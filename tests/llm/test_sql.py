"""Queries of the subpackage against their SQL, and edge rows of the tables that SQL can state."""

import textwrap

import pytest

from tests.oracle import same
from vecspark.llm import license_scan, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


TEXTS = [
    None, "", " \t\n\x0b\x0c\r", "one", "a b c d e a b c d e f", "x " * 30, "A\nA\nA\n \nB", "é ü\u00a0ß ### || $$", "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG AGAIN",
    "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14", "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14",
    "Licensed under CC BY-NC 4.0.\nReleased under the MIT License. All rights reserved.", "long " * 20_000,
    *(" \r\n# ".join(textwrap.wrap("Before. " + " ".join(license_scan.SENTENCES[i] for i in seq) + " After.", width)) for width, (_, seq) in zip((20, 40, 60, 72, 78, 500) * 9, license_scan.RULES)),
    "Released under\n\nthe MIT License.", "Released under \n * \n the MIT License.", "All rights . : reserved. \t", "Released under the MIT. \r License. ", "SPDX-License-Identifier: GPL-2.0-only\nAll rights reserved.  \n All rights\treserved",
    " ".join(f"v{i}" for i in range(40)) + " w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w0",
]


@pytest.fixture(scope="session")
def odd_tables(spark, tmp_path_factory):
    """documents and pages with null ids, languages and texts, repeated rows, and columns of clashing names."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i if i != 3 else None, t, "en" if i % 3 else None, "s" if i % 2 else None, len(t or ""), "extra") for i, t in enumerate(TEXTS)]
    rows += rows[4:6]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string")
    docs.coalesce(1).write.mode("overwrite").parquet(f"{path}/all")
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x#y", "https://example.com", "http://b.net/de/8", "x://example.net/de/8#://", "http://c.org/es/1", "http://notcom/en/", "http://m.example.com/en/71", "http://com/en/"]
    pages = spark.createDataFrame([(i if i != 2 else None, u, None if i == 4 else f"<p>{i}</p>", 1) for i, u in enumerate(urls + urls[-2:])], "page_id bigint, url string, html string, rule int")
    pages.coalesce(1).write.mode("overwrite").parquet(f"{path}/pages_all")
    import glob
    import shutil

    shutil.copy(glob.glob(f"{path}/all/part-*")[0], f"{path}/documents.parquet")
    shutil.copy(glob.glob(f"{path}/pages_all/part-*")[0], f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", ["op4_url_filter", "op5_substring", "op8_license_scan", "op10_quality"])
def test_odd_rows_match_sql(spark, odd_tables, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], odd_tables)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables_give_no_rows(spark, tmp_path, name):
    for t in ("documents", "pages", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_licences_of_wrapped_rules(spark):
    """Each rule's own text, wrapped and behind marks, gives its licence; no two sentences are alike."""
    assert len(license_scan.KNOWN) == len(license_scan.SENTENCES)
    texts = ["\n// ".join(textwrap.wrap("Before. " + " ".join(license_scan.SENTENCES[i] for i in seq), 60)) for _, seq in license_scan.RULES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.licences for r in license_scan.license_scan(docs).collect()}
    assert [found[i] for i in range(len(texts))] == [name for name, _ in license_scan.RULES]


def test_passing_keeps_rows_and_columns(spark, odd_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    kept = quality.passing(docs)
    assert kept.columns == docs.columns
    verdicts = {(r.doc_id, r.kept) for r in quality.quality(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, k in verdicts if k}


def test_salted_join_of_limits_equals_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, quality.quality(docs).collect()))
    monkeypatch.setattr(quality, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, quality.quality(docs).collect())) == want


def test_groups_of_other_distributions_have_other_fences(spark):
    """Symbols that are common in one source are junk in another; the fence of each follows its own documents."""
    word = lambda i, n: " ".join(f"word{(i * 37 + k * 11) % 997}x{k}" for k in range(n))
    plain = [(i, word(i, 60), "en", "prose") for i in range(60)]
    tables = [(100 + i, " | ".join(word(i, 60).split()), "en", "tables") for i in range(60)]
    odd = [(200, word(7, 60).replace(" ", " $ "), "en", "prose"), (201, word(7, 60).replace(" ", " $ "), "en", "tables")]
    docs = spark.createDataFrame(plain + tables + odd, "doc_id bigint, text string, lang string, source string")
    limits = {r.source: r for r in quality.limits_of(quality.measure(docs)).collect()}
    assert limits["tables"].max_symbols > 3 * limits["prose"].max_symbols
    assert limits["prose"].max_repeats < 200  # within what the base rules let pass
    assert {r.doc_id for r in quality.quality(docs).collect() if not r.kept} == {200}
