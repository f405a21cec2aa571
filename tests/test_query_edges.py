"""Queries over small made tables: odd inputs against their SQL, and the shape of what they write."""

from collections import Counter

import duckdb
import pytest

from lectern import queries as engine


@pytest.fixture
def made(spark, tmp_path):
    """Writes documents (doc_id, text) and gives the folder."""

    def write(texts):
        rows = [(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def by_sql(folder, sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return con.sql(sql)


def test_segments_meet_letters_beyond_ascii_as_the_sql_does(spark, made):
    sf = made(["caféOf a", "a Ofé b", "Of\u0301 c", "xOf Ofx _Of Of_ 1Of", "٣Of x Of", None, "", " Of ", "Of Of", "éOfé"])
    got = engine.queries()["segment_turns"](spark, sf)
    want = by_sql(sf, engine.oracle_sql()["segment_turns"])
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def test_segments_keep_a_letter_v_at_the_ends(spark, made):
    # In DuckDB E'\\v' is the letter v, so the query's SQL cuts it off; only white space is stripped here.
    got = engine.queries()["segment_turns"](spark, made(["vequa Of \x0bmolv\x0b"])).orderBy("i").collect()
    assert [(r["i"], r["marker"], r["body"]) for r in got] == [(0, "", "vequa"), (1, "Of", "molv")]


@pytest.mark.parametrize("name", ["phrase_occurrences", "sentiment_means"])
def test_a_table_of_one_row_group_is_dealt_out(spark, sf, name, monkeypatch):
    from lectern import source_queries

    dealt = []
    real = getattr(source_queries, "spread", None)
    monkeypatch.setattr(source_queries, "spread", lambda scan: dealt.append(real(scan)) or dealt[-1], raising=False)
    engine.queries()[name](spark, sf)
    assert [d.rdd.getNumPartitions() for d in dealt if "text" in d.columns] == [spark.sparkContext.defaultParallelism]
