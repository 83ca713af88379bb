"""The registered queries: against their SQL on the smallest tables, and against plain computations."""

import os
import zlib

import duckdb
import pytest

from logsift.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))


def test_languages_of_held_out_rows_are_neither_learned_nor_read(spark, tmp_path):
    words = {"en": "the and of with house", "fr": "le que été même château", "de": "und nicht für über straße"}
    rows = [(i, f"{w} {w} {i % 7}", lang, "s", 1) for i, (lang, w) in enumerate(list(words.items()) * 60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spoiled = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, "other", -i) for i, t, lang, _, _ in rows]
    found = []
    for name, part in (("plain", rows), ("spoiled", spoiled)):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found.append(sorted(queries.op9_language_id(spark, f"{tmp_path}/{name}").collect()))
    assert found[0] == found[1] and len(found[0]) == len(rows)
    assert [r["held_out"] for r in found[0]] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(rows))]
    assert all(r["lang_pred"] == rows[r["doc_id"]][2] for r in found[0] if r["held_out"])
