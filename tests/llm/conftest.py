from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

from pyspark.sql import SparkSession  # noqa: E402

from rentlens.llm.common import ship  # noqa: E402

BASE = " ".join(f"word{k % 97}x{k % 89} and{k % 83}" for k in range(400))
PASSAGE = "a passage of some length that repeats across many documents, word for word, without any change at all"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, label string, class string, keys string, row string, _row string, _id long, low string"
EXTRA = (5, "l", "c", "k", "r", "x", 9, "low")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = SparkSession.getActiveSession() or (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    return ship(session)


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty, blank and long texts, equal and near ones, repeated rows."""
    near = BASE.replace("word5x5 ", "changed ", 1)
    long = " ".join(f"long{k}" for k in range(60_000))
    texts = [
        (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, near, "en", "b"), (3, near, "en", "b"), (4, None, None, None),
        (5, "", "de", "a"), (6, " \n\t\n", None, "b"), (7, "Grüße aus ÄÖÜ\nzweite Zeile", "de", None), (8, f"start {PASSAGE} stop", "en", "a"),
        (9, f"other beginning, {PASSAGE} and another end", "en", "a"), (10, long, "en", "a"), (11, long + " end", "en", "b"),
        (None, "a text without id", "en", "a"), (None, None, None, None), (12, "a b", "en", "b"), (13, "日本語のテキスト", "ja", "c"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), *EXTRA) for i, t, lang, source in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
