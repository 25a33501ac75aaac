"""Reads at the cost of what is read: name search, pages, and tables of earlier sessions."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F
from test_plans import physical

from rentlens import Workspace
from rentlens.operators import grams
from rentlens.plans import segments
from rentlens.sources import from_star
from rentlens.store import Store

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ws(spark):
    return Workspace(spark, from_star(spark, ROOT))


@pytest.mark.parametrize("pattern, strings", [
    ("Smith", [["smith"]]), ("^Ann Lee$", [["ann lee"]]), ("ab+cd", [["ab", "bcd"]]), ("abc?d", [["ab", "d"]]),
    ("ab{2}c|x", [["ab", "bc"], ["x"]]), ("a{0,2}bcd", [["bcd"]]), (r"a\.b\d+cde", [["a.b", "cde"]]), ("[a-z|)]x(y|z)+vw", [["x", "vw"]]),
    (r"abc\x41def", [["abc"]]), (r"\Qa.b\E", [[]]), ("(?i)abc", [["abc"]]), ("(?u)abc", [[]]), ("[]a]bcd", [["bcd"]]), ("[^]a]+bcd", [["bcd"]]), ("(a|b)|cde", [[], ["cde"]]), (r"abc\1234", [["abc"]]), ("", [[]]),
])
def test_required_strings(pattern, strings):
    assert grams.required_strings(pattern) == strings


PATTERNS = [
    "building", "customer#0000000.1", "^machinery", "AUTO|house", "m[a-z]+ customer#00000001", "0{3}12$", "é", "x|building", ".*", "customer#(000)+0011$", "furniture?", "ILE CUST", r"\d\d7$", r"r#0+14",
    "no such name", "ßtraße", "ab", "customer#00000001?23",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_search_equals_a_scan(spark, ws, pattern):
    found = {r.customer_id for r in segments.customer_search(ws, name=pattern).collect()}
    scan = ws.profile_base.where(F.col("full_name").rlike(f"(?i){pattern}")).select("customer_id")
    assert found == {r.customer_id for r in scan.collect()}


def test_search_reads_lists_of_the_rarest_grams(ws):
    found = grams.candidates(ws.name_grams, ws.name_gram_sizes, "building customer#000000011")
    plan = physical(found)
    assert re.search(r"PushedFilters: \[[^]]*In\(gram, \[[^,]*,[^,]*,[^,\]]*\]\)", plan) and "PartitionFilters: [isnotnull(folder" in plan or "folder" in plan
    assert grams.candidates(ws.name_grams, ws.name_gram_sizes, "a.*b") is None


def test_grams_of_odd_texts(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (2, "ab"), (3, ""), (4, None), (5, "ÀBCd"), (6, "日本語名")], "id long, text string")
    found = {(r["gram"], r["id"]) for r in grams.postings(texts, "id", "text").collect()}
    assert found == {("abc", 1), ("bca", 1), ("cab", 1), ("Àbc", 5), ("bcd", 5), ("日本語", 6), ("本語名", 6)}


@pytest.mark.parametrize("order", ["name_asc", "risk_desc", "rentals_desc"])
def test_pages_are_slices_of_the_table(ws, order):
    whole = [tuple(r) for r in segments.customer_table(ws, order).collect()]
    pages = [[tuple(r) for r in segments.customer_page(ws, k, 37, order).collect()] for k in range(6)]
    assert [r for page in pages for r in page] == whole and pages[-1] == []
    assert [len(p) for p in pages[:4]] == [37] * 4


def test_a_page_reads_few_folders(ws):
    plan = physical(segments.customer_page(ws, 1, 20))
    read = re.search(r"PartitionFilters: \[(?:isnotnull\(place#\d+\), )?\(?(place#\d+ (?:= \d+|IN \([\d,]+\)))", plan)
    assert read and read[1].count(",") <= 1


def star_copy(tmp_path):
    import shutil

    folder = tmp_path / "star"
    shutil.copytree(ROOT, folder)
    for path in folder.iterdir():
        path.chmod(0o644)
    return folder


def test_a_second_session_finds_the_tables(spark, tmp_path):
    folder, root = star_copy(tmp_path), str(tmp_path / "shared")
    open_one = lambda **x: Workspace(spark, from_star(spark, str(folder)), store=Store(spark, root, **x))
    first = open_one()
    rows = sorted(map(tuple, first.customer_genre.collect()))
    second = open_one()
    assert second.customer_genre.inputFiles() == first.customer_genre.inputFiles()
    assert sorted(map(tuple, second.customer_genre.collect())) == rows
    assert Workspace(spark, from_star(spark, str(folder)), noise="none", store=second.store).snapshot != second.snapshot
    orders = spark.read.parquet(f"{folder}/orders.parquet").limit(700).toPandas()
    orders.to_parquet(f"{folder}/orders.parquet", coerce_timestamps="us")
    third = open_one()
    assert third.snapshot != first.snapshot
    assert third.customer_genre.inputFiles() != first.customer_genre.inputFiles()
    assert third.customer_genre.count() < len(rows)


def test_expired_tables_go_when_no_lease_holds_them(spark, tmp_path):
    root = str(tmp_path / "shared")
    frame = spark.range(5)
    short, long = Store(spark, root, keep_seconds=0.5), Store(spark, root, keep_seconds=3600)
    short.put("a", frame)
    short.put("b", frame)
    assert long.find("b").count() == 5
    time.sleep(0.7)
    assert long.find("a") is None
    assert Store(spark, root, keep_seconds=3600).sweep() == ["a"]
    tables = lambda: sorted(p.name[0] for p in (tmp_path / "shared/rentlens-store/tables").iterdir())
    assert tables() == ["b"]
    long.release()
    assert Store(spark, root, keep_seconds=3600).sweep() == ["b"] and tables() == []
    # Built anew after it had gone, and by two writers at once: the first one's table is everyone's.
    again = long.put("b", frame)
    other = Store(spark, root).put("b", frame)
    assert again.inputFiles() == other.inputFiles() and tables() == ["b"]
    # What a writer left behind that failed goes in time.
    (tmp_path / "shared/rentlens-store/tables/x-left").mkdir()
    time.sleep(0.7)
    short.sweep()
    assert tables() == ["b"]
