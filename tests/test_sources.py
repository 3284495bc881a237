"""Sources and sinks on small files."""

from __future__ import annotations

import datetime as dt
import json

from tidemark.sources import files as S


def test_submissions(spark, tmp_path):
    recent = {"accessionNumber": ["a-1", "a-2", "a-3"], "form": ["10-K", "10-Q", "10-K"], "filingDate": ["2024-03-15", "2023-03-14", ""], "reportDate": ["2023-12-31", ""], "primaryDocument": ["x.htm"]}
    (tmp_path / "c.json").write_text(json.dumps({"cik": "42", "name": "Co", "filings": {"recent": recent}}))
    rows = S.submissions(spark, str(tmp_path), ["10-K"], "2024-01-01").collect()
    assert sorted((r.accession, r.cik, r.filing_date, r.report_date, r.document) for r in rows) == [("a-1", "0000000042", dt.date(2024, 3, 15), dt.date(2023, 12, 31), "x.htm"), ("a-3", "0000000042", None, None, None)]


def test_dimensions(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 7, "ticker": "ab", "title": "Old"}, "1": {"cik_str": 8, "ticker": "AB", "title": "New"}}))
    (tmp_path / "p.json").write_text(json.dumps({"phrases": ["Going Concern", "going concern ", "fraud"]}))
    (tmp_path / "l.csv").write_text("Word,Negative,Positive,Other\nLOSS,2009,0,1\nGain,0,2009,1\nOLD,-2020,0,0\nNone,0,0,0\n")
    assert [(r.ticker, r.cik, r.name) for r in S.tickers(spark, str(tmp_path / "t.json")).collect()] == [("AB", "0000000008", "New")]
    assert sorted(r.phrase for r in S.phrase_list(spark, str(tmp_path / "p.json")).collect()) == ["fraud", "going concern"]
    assert sorted((r.word, r.category) for r in S.lexicon(spark, str(tmp_path / "l.csv")).collect()) == [("gain", "positive"), ("loss", "negative"), ("old", "negative")]
    assert S.lexicon(spark, None).count() == 0


def test_ingest_twice_and_rewrite(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "accession string, v int")
    path = str(tmp_path / "table")
    assert (S.ingest(rows, path), S.ingest(rows, path)) == (2, 0)
    assert sorted((r.accession, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]
    out = str(tmp_path / "parts")
    S.rewrite(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), out, "k")
    S.rewrite(spark.createDataFrame([(2, "z")], "k int, v string"), out, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [(1, "x"), (2, "z")]


def test_documents(spark, tmp_path):
    (tmp_path / "a.htm").write_text("<p>one\ntwo</p>")
    assert [r.html for r in S.documents(spark, str(tmp_path / "a.htm")).collect()] == ["<p>one\ntwo</p>"]
