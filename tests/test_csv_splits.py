"""CSV files read in many small splits against Spark's reader with one task for each file."""

import random

import pytest
from pyspark.sql import functions as F

from plaintide.sources import csv_splits, tables

SMALL = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "10", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}


@pytest.fixture(scope="module")
def small_splits(spark):
    """Splits of 200 bytes, batches of seven lines."""
    before = {key: spark.conf.get(key) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def write(path, rows, end="\n", last=True):
    path.write_bytes((end.join(rows) + (end if last else "")).encode())


def random_field(rng):
    text = "".join(rng.choice(["a", "b ", " ", ",", "\n", "\r\n", '"', "é", '"', " x", ""]) for _ in range(rng.randrange(6)))
    quoted = any(c in text for c in ',\n\r"') or rng.random() < 0.3
    return '"' + text.replace('"', '""') + '"' if quoted else text


def same_rows(spark, folder, position=True):
    found = csv_splits.read_csv(spark, str(folder), position="place")
    rows = found.collect()
    assert sorted(r.place for r in rows) == list(range(len(rows)))
    assert sorted(map(repr, found.drop("place").collect())) == sorted(map(repr, tables.read_whole_csv(spark, str(folder)).collect()))
    return [r for r in sorted(rows, key=lambda r: r.place)]


@pytest.mark.parametrize("seed", range(6))
def test_random_files(small_splits, tmp_path, seed):
    """Quotes, commas and line breaks in fields, rows of other lengths, stray quotes, blank lines, both line ends."""
    rng = random.Random(seed)
    for i in range(rng.randrange(1, 4)):
        rows = ["x,y,z", *[",".join(random_field(rng) for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(rng.randrange(80))]]
        rows = [r if k == 0 or rng.random() < 0.9 else r + rng.choice([',5" disk', 'a"b', ""]) for k, r in enumerate(rows)]
        if seed % 2:
            rows.insert(rng.randrange(1, len(rows) + 1), "")
        write(tmp_path / f"f{i}.csv", rows, rng.choice(["\n", "\r\n"]), rng.random() < 0.5)
    same_rows(small_splits, tmp_path)


def test_order_and_splits(small_splits, tmp_path):
    """Rows are numbered in file order; records longer than several splits are put together."""
    texts = [f"{i} " + "word\n" * (200 if i % 10 == 3 else i % 3) for i in range(60)]
    write(tmp_path / "a.csv", ["n,t", *[f'{i},"{t}"' for i, t in enumerate(texts[:30])]])
    write(tmp_path / "b.csv", ["n,t", *[f'{i},"{t}"' for i, t in enumerate(texts[30:], 30)]], last=False)
    rows = same_rows(small_splits, tmp_path)
    assert [(int(r.n), r.t) for r in rows] == list(enumerate(texts))
    lines = csv_splits.read_lines(small_splits, str(tmp_path / "a.csv"))
    assert lines.rdd.getNumPartitions() >= 8
    assert csv_splits.split_starts(lines).where("inside").count() > 5


def test_starts_joined_by_shuffle(small_splits, tmp_path):
    write(tmp_path / "a.csv", ["n,t", *[f'{i},"{i}\n\n{i}"' for i in range(300)]])
    rows = csv_splits.read_csv(small_splits, str(tmp_path), "place", most_broadcast=0).collect()
    assert [(r.n, r.t) for r in sorted(rows, key=lambda r: r.place)] == [(str(i), f"{i}\n\n{i}") for i in range(300)]


def test_no_rows_and_open_quote(small_splits, tmp_path):
    write(tmp_path / "a.csv", ["n,t"])
    assert same_rows(small_splits, tmp_path) == []
    write(tmp_path / "b.csv", ["n,t", "1,x"])
    assert len(same_rows(small_splits, tmp_path)) == 1


def test_other_header_fails(small_splits, tmp_path):
    write(tmp_path / "a.csv", ["n,t", "1,x"])
    write(tmp_path / "b.csv", ["n,u", "1,x"])
    with pytest.raises(Exception, match="another header"):
        csv_splits.read_csv(small_splits, str(tmp_path)).collect()


def test_byte_order_mark(spark, tmp_path):
    sample = spark.createDataFrame([(1, "é\n\"x\"", 2, "", "")], "review_id int, review_text string, rating int, manual_label string, notes string")
    for mark in (True, False):
        path = tables.write_labeling_csv(sample, str(tmp_path / str(mark)), mark)
        files = [f.read_bytes() for f in (tmp_path / str(mark)).glob("*.csv")]
        assert files and all(f.startswith(b"\xef\xbb\xbfreview_id,") == mark for f in files)
        back = tables.read_labeled_csv(spark, path).collect()
        assert [(r.review_id, r.review_text, r.rating, r.manual_label) for r in back] == [("1", "é\n\"x\"", 2.0, None)]


def test_states_of_lines():
    import numpy as np
    import pyarrow as pa

    lines = ['a,b', '"a', 'a"', '"a"', '"a""b,"', '"a"",b', 'a"b', 'x,"y', '"x"y,"', '']
    opens, stays = csv_splits._effects(pa.array(lines))
    assert list(opens) == [False, True, False, False, False, True, False, True, True, False]
    # In a quoted field, the first quote closes it, and what follows up to a comma belongs to it all the same.
    assert list(stays) == [True, False, False, False, True, False, False, False, True, True]
    for first in (False, True):
        expected = [first]
        for o, s in zip(opens, stays):
            expected.append(bool(s) if expected[-1] else bool(o))
        assert list(csv_splits._states(np.array(opens), np.array(stays), first)) == expected
