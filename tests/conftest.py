from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plaintide.session import build_session  # noqa: E402

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "plaintide-tests", "local[8]",
        spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Rating, days before the newest review, text.
OWN_REVIEWS = [
    (2, 0, "The lid leaks as soon as the bottle tips over"),
    (4, 4, "Does its job, the colour is a little dull"),
    (1, 9, "Refund please: the motor burned out on the second day and the shop has not answered any of my three letters"),
    (5, 15, "My daughter takes it everywhere"),
    (3, 22, "Fine for the garden, too loud for a flat"),
    (1, 29, "Two screws and the manual were not in the parcel"),
    (3, 33, "Came a week after the date they gave me"),
    (2, 41, "The zip gave way, the seams look careless"),
    (5, 50, "Quiet, light and easy to clean"),
    (4, 58, "Good value, I would have liked a longer cable"),
]


@pytest.fixture(scope="session")
def reviews(spark):
    """Ten reviews over 58 days, every rating twice, ids from 101."""
    newest = datetime(2024, 5, 20)
    rows = [(101 + i, rating, text, newest - timedelta(days=days)) for i, (rating, days, text) in enumerate(OWN_REVIEWS)]
    return spark.createDataFrame(
        rows, "review_id bigint, rating int, review_text string, created_at timestamp_ntz"
    )


def items(spark, categories, period="recent"):
    rows = [(i + 1, c, f"issue {i + 1}", period) for i, c in enumerate(categories)]
    return spark.createDataFrame(rows, "review_number int, category string, brief_issue string, period string")


RECENT = [
    "price_issue", "size_issue", "other", "size_issue", "wrong_item", "size_issue",
    "price_issue", "size_issue", "wrong_item", "other", "price_issue", "size_issue",
]
COMPARISON = [
    "size_issue", "price_issue", "size_issue", "price_issue", "size_issue", "wrong_item", "size_issue", "price_issue",
]
