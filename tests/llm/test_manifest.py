"""The Merkle manifest against a plain recomputation, in one append and in many."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from plaintide.llm import merkle
from plaintide.session import new_path

from .conftest import SCHEMA, hard_rows


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_levels(nodes):
    """All levels of a tree, from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_steps(levels, place):
    steps = []
    for level in levels[:-1]:
        start = place // 16 * 16
        steps.append(("".join(level[start:place]), "".join(level[place + 1:start + 16])))
        place //= 16
    return steps


def plain_fold(digest, steps):
    for left, right in steps:
        digest = h(left, digest, right)
    return digest


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_manifest(rows, tamper):
    """``rows`` of doc_id, text, lang, source, n_chars."""
    leaf = lambda r, text: h(*[field(v) for v in (r[0], r[3], r[2], r[4], text)])
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append(((r[0] is not None, r[0] or 0), leaf(r, r[1]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(trees[s], key=lambda x: x[:2]) for s in order}
    levels = {s: plain_levels([x[1] for x in trees[s]]) for s in order}
    top = plain_levels([levels[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for place, (_, digest, r) in enumerate(trees[s]):
            steps = plain_steps(levels[s], place) + plain_steps(top, k)
            back = plain_fold(leaf(r, lowered(r[1]) if tamper(r[0]) else r[1]), steps)
            out.append((r[0], digest, levels[s][-1][0], top[-1][0], h(*[a + b for a, b in steps]), back, back == top[-1][0]))
    return sorted(out, key=repr)


def found(docs, text):
    return sorted((tuple(r) for r in merkle.manifest(docs, text).collect()), key=repr)


def odd(doc_id):
    return doc_id is not None and doc_id % 2 == 1


def changed():
    return F.when(F.col("doc_id") % 2 == 1, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))


def test_hard_rows(hard):
    assert found(hard, changed()) == plain_manifest(hard_rows(), odd)


def test_empty(nothing):
    assert found(nothing, changed()) == []


def test_long_texts(spark):
    rows = [(i, text, "en", None, 1 << 20) for i, text in enumerate(["\t" * (1 << 20), "Ab," * 300000, "é" * (1 << 19), ""])]
    assert found(spark.createDataFrame(rows, SCHEMA), changed()) == plain_manifest(rows, odd)


@pytest.mark.parametrize("count", [1, 2, 15, 16, 17, 31, 32, 33, 255, 256, 257, 272, 4096, 4097])
def test_sizes_of_trees(spark, count):
    """One tree of each size; a lone leaf is its own root."""
    digests = [h(str(i)) for i in range(count)]
    leaves = spark.createDataFrame([("t", i, d) for i, d in enumerate(digests)], "key string, info bigint, digest string")
    path = new_path(spark, "manifest")
    runs, roots, levels = merkle.seal(spark, path, merkle.append(spark, path, 0, leaves, ["info"]))
    plain = plain_levels(digests)
    assert levels == len(plain) - 1 and [r.digest for r in roots.collect()] == [plain[-1][0]]
    got = {r.place: [tuple(s) for s in r.steps] for r in merkle.witnesses(runs, roots, levels).collect()}
    assert got == {i: plain_steps(plain, i) for i in range(count)}


def test_appends_extend_witnesses(spark):
    """After each of many appends of any size, all witnesses are those of one tree; closed runs are not written again."""
    rng = random.Random(1)
    path, trees, number = new_path(spark, "manifest"), {"a": [], "b": [], "c": []}, 0
    for batch, sizes in enumerate([(5, 0, 1), (11, 300, 0), (1, 16, 0), (0, 0, 0), (rng.randrange(100, 400), 1, 15)]):
        rows = []
        for key, size in zip(trees, sizes):
            for _ in range(size):
                rows.append((key, number, h(str(number))))
                trees[key].append(h(str(number)))
                number += 1
        rng.shuffle(rows)
        leaves = spark.createDataFrame(rows, "key string, info bigint, digest string")
        if batch == 2:
            # A try that broke off after its first table is written over.
            merkle._runs_of(leaves.select("key", F.lit(0).cast("bigint").alias("place"), "digest", "info")).write.parquet(f"{path}/runs/append=2/level=0")
        count = merkle.append(spark, path, batch, leaves, ["info"])
        runs, roots, levels = merkle.seal(spark, path, count)
        plain = {key: plain_levels(t) for key, t in trees.items() if t}
        assert {r.key: r.digest for r in roots.collect()} == {key: t[-1][0] for key, t in plain.items()}
        got = merkle.witnesses(runs, roots, levels).collect()
        assert len(got) == number
        for r in got:
            assert r.digest == trees[r.key][r.place] and [tuple(s) for s in r.steps] == plain_steps(plain[r.key], r.place)
    full = merkle._tables(spark, path, count).where(F.size("members") == 16)
    assert full.count() == full.select("key", "level", "run").distinct().count()


def test_stream(spark, tmp_path):
    """Micro-batches of a stream give the root of one append, also when one is sent twice."""
    source = str(tmp_path / "in")
    for i in range(3):
        spark.range(100 * i, 100 * i + 100, numPartitions=1).withColumn("source", F.lit("s")).write.mode("append").parquet(source)
    to_leaves = lambda rows: rows.select(F.col("source").alias("key"), F.col("id").alias("info"), merkle.leaf(F.col("id")).alias("digest"))
    path = new_path(spark, "manifest")
    add, batches = merkle.appender(path, ["info"], to_leaves), []

    def twice(rows, batch):
        batches.append(sorted(r.id for r in rows.collect()))
        add(rows, batch)
        add(rows, batch)

    stream = spark.readStream.schema("id bigint, source string").option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert len(batches) == 3
    _, roots, _ = merkle.seal(spark, path, 3)
    expected = plain_levels([h(field(i)) for b in batches for i in b])[-1][0]
    assert [r.digest for r in roots.collect()] == [expected]
