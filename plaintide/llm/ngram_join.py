"""N-gram Jaccard join (7): sets in one global order, joined through prefix trees.

A text's set are its 3-word shingles as 64-bit hashes. Two sets with a Jaccard
similarity of at least ``t`` share one of the first ``n - ceil(t * n) + 1``
members of each in any order that is the same for all sets; the order is by
hash, with shingles that many texts share last. What is shared at positions
``i`` and ``j`` leaves room for at most ``min(n - i, m - j)`` common members,
which prunes most pairs before any set is read.

Candidates of one set are stored in a prefix tree and the set walks it: sets
that begin alike share the count of what is common so far, and a branch is left
as soon as the members it can still have in common are too few.

Equal sets are one node from the start. Where a member is shared by very many
sets, each is first compared with one of them, which links families of copies to
what they were copied from. What is then in different components is looked at
block by block inside tasks: first by bounds only, where a task tells no pairs but
which sets it joins, and so each set comes into one cluster outside of which it
has no candidates; then the clusters' sets are read and compared, and a task tells
only the links that join components. So a family of any kind makes no more rows
than it has sets in a block, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_tasks, release, saved, slices
from .components import components

#: Groups of at most this many sets that share a member early are compared in full at once.
SMALL = 32
#: Members put last in the order, at most: a shingle must be in that part of all early members.
MOST_COMMON = 1 << 20
#: Candidates in one prefix tree.
TREE = 256
#: Members of a node looked up between two looks at the bound.
READ = 32
#: Sets in one block of a large group, and members of all sets of a block that are read.
BLOCK, BLOCK_MEMBERS = 512, 1 << 20
#: Bits of the filter on the sets that are read again.
FILTER = 1 << 23
#: Parts of the hash range whose members are counted for each set; and for sets that are read.
PARTS, MANY_PARTS = 256, 1024

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_WORD = np.array([b not in b"\x20\x09\x0a\x0b\x0c\x0d" for b in range(256)])
_POWERS = np.cumprod(np.full(4096, 0xD1342543DE82EF95, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def words_at(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of a lower-case text, and the byte at which it starts."""
    codes = np.frombuffer(text, np.uint8)
    inside = _WORD[codes]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    begin = np.zeros(len(codes), np.int64)
    begin[starts] = starts
    at = np.arange(len(codes)) - np.maximum.accumulate(begin)
    # Beyond 4096 bytes of a word the powers come again, multiplied otherwise.
    value = _BYTES[codes] * _POWERS[at & 4095]
    if (ends - starts).max() > 4096:
        value *= (at >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    value[~inside] = 0
    return _mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64)), starts


def words(text: bytes) -> np.ndarray:
    return words_at(text)[0]


def shingles(text: str, size: int = 3) -> np.ndarray:
    """The distinct shingles of a text, in order of hash; fewer words than ``size`` are one shingle."""
    found = words(text.encode(errors="surrogatepass").lower())
    if not len(found):
        return found
    size = min(size, len(found))
    out = found[:len(found) - size + 1].copy()
    for k in range(1, size):
        out = _mix(out) + found[k:len(found) - size + 1 + k]
    return np.unique(_mix(out + np.uint64(size)))


def least_common(n: Column, percent: int) -> Column:
    """Members that a set of ``n`` must share with any set similar enough: ceil of the percentage, in integers."""
    return F.floor((n * percent + 99) / 100)


def _first(df: DataFrame, text_col: str, percent: int, size: int) -> DataFrame:
    """The first members ``m`` of every row's set by hash, as many as a set similar enough must share one of."""
    def run(batches):
        release()
        for batch in slices(batches):
            sets = [shingles(text or "", size) for text in batch.column(0).to_pylist()]
            early = [x[:len(x) - (len(x) * percent + 99) // 100 + 1] for x in sets if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *early]).view(np.int64))], names=["m"])

    return in_tasks(df.select(F.col(text_col).alias("text")), run, "m bigint")


def _sets(df: DataFrame, id_col: str, text_col: str, percent: int, size: int, common: list[int]) -> DataFrame:
    """Each row's number and id, ``n``, ``key`` (digest of the set), ``early`` (first members, common ones last), ``own`` (members that aren't common), ``h`` (members by part of the hash range), ``t`` (hash of the text)."""
    shared = df.sparkSession.sparkContext.broadcast(np.array(sorted(common), np.int64).view(np.uint64)) if common else None

    def run(batches):
        release()
        last = np.sort(shared.value) if shared else np.zeros(0, np.uint64)
        for batch in slices(batches):
            n, keys, early, own, parts = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                members = shingles(text or "", size)
                many = len(members)
                n.append(many)
                parts.append(np.bincount((members & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS))
                keys.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest())
                first = many - (many * percent + 99) // 100 + 1 if many else 0
                if len(last) and many:
                    hot = last[np.minimum(np.searchsorted(last, members), len(last) - 1)] == members
                    own.append(int(many - hot.sum()))
                    members = np.concatenate([members[~hot][:first], members[hot][:max(0, first - own[-1])]])
                else:
                    own.append(many)
                early.append(members[:first].view(np.int64))
            h = pa.ListArray.from_arrays(np.arange(0, len(n) * PARTS + 1, PARTS, dtype=np.int32), np.concatenate(parts).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(early, pa.list_(pa.int64())),
                 pa.array(own, pa.int64()), h, batch.column(3)], names=["row", "id", "n", "key", "early", "own", "h", "t"])

    kind = df.schema[id_col].dataType.simpleString()
    return in_tasks(
        df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t")), run,
        f"row bigint, id {kind}, n bigint, key binary, early array<bigint>, own bigint, h array<int>, t bigint")


def _may_link(percent: int) -> Column:
    """Whether sets ``a`` and ``b`` that share members at these positions can be similar enough."""
    room = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    return room * (100 + percent) >= percent * (F.col("a.n") + F.col("b.n"))


def walk(probe: np.ndarray, sets: list[np.ndarray], percent: int, read: list[int] | None = None) -> list[int]:
    """Which of ``sets`` are similar enough to ``probe``, by a walk over their prefix tree; all are sorted.

    The tree is the sorted list of the sets: a range of it that begins alike is
    a node, told from the first and the last set of the range. What a node adds
    to its parent is looked up in ``probe`` once for all sets below it, a few
    members at a time, and a branch is left as soon as the members that both
    sides still have cannot make up what is missing. ``read`` gets the number
    of members looked up.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
    # Sorted as bytes, sets with the same first members stand together, the shorter first.
    rows = [sets[i] for i in order]
    found, todo = [], [(0, len(rows), 0, 0)]
    while todo:
        low, high, depth, common = todo.pop()
        first, last = rows[low], rows[high - 1]
        size = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:size] != last[depth:size])
        to = len(first) if high - low == 1 else depth + int(differ[0]) if len(differ) else size
        # The largest set below may have most in common, the smallest needs least.
        longest, least = max(len(r) for r in rows[low:high]), min(len(r) for r in rows[low:high])
        needed = percent * (len(probe) + least)
        alive = True
        while depth < to and alive:
            part = first[depth:min(to, depth + READ)]
            at = np.searchsorted(probe, part)
            common += int((probe[np.minimum(at, len(probe) - 1)] == part).sum())
            depth += len(part)
            if read is not None:
                read.append(len(part))
            left = len(probe) - int(np.searchsorted(probe, part[-1], side="right"))
            alive = (common + min(longest - depth, left)) * (100 + percent) >= needed
        if not alive:
            continue
        if high - low == 1:
            if common * (100 + percent) >= needed:
                found.append(order[low])
            continue
        begin = low
        while begin < high:
            ends = len(rows[begin]) == to
            end = begin + 1
            while end < high and (len(rows[end]) == to if ends else len(rows[end]) > to and rows[end][to] == rows[begin][to]):
                end += 1
            if ends:
                if common * (100 + percent) >= percent * (len(probe) + to):
                    found += [order[i] for i in range(begin, end)]
            else:
                todo.append((begin, end, to, common))
            begin = end
    return sorted(found)


def _whole(wanted: DataFrame, df: DataFrame, text_col: str, size: int) -> DataFrame:
    """``k`` and all ``members`` of the sets in ``wanted`` (``k``, ``key``, and ``t`` of a text that has it), read from the texts again."""
    # One bit for each of a fixed number of hash values: what comes to the driver has a bound.
    bits = wanted.select(F.pmod("t", F.lit(FILTER)).alias("h"))
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(bits)))

    def run(batches):
        release()
        there = np.unpackbits(shared.value).view(bool)
        for batch in slices(batches):
            keys, sets = [], []
            # Only texts that may be wanted are cut into words again, and of equal ones in a batch the first.
            hashes = batch.column(1).to_numpy()
            first = np.sort(np.unique(hashes, return_index=True)[1])
            for i in first[there[hashes[first] % FILTER]].tolist():
                members = shingles(batch.column(0)[i].as_py() or "", size)
                if len(members):
                    keys.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest())
                    sets.append(members.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "members"])

    texts = df.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    read = in_tasks(texts, run, "key binary, members array<bigint>").groupBy("key").agg(F.first("members").alias("members"))
    return read.join(wanted.select("k", "key"), "key").select("k", "members")


def forest(n: np.ndarray, parts: np.ndarray, groups: np.ndarray, label: np.ndarray, blocks: np.ndarray, percent: int, at: np.ndarray | None = None,
           similar: Callable[[int, np.ndarray], list[int]] | None = None) -> np.ndarray:
    """Index pairs (rows of two) that join sets of different groups whose labels differ; sets that are joined get one label.

    Sets are joined that the bounds on places and part counts leave, or which of
    these ``similar`` (a set, and others) says. Pairs span what is joined, so they
    are fewer than the sets. Of two blocks, pairs are of one set of each.
    """
    two, reach, out = len(np.unique(blocks)) > 1, n if at is None else n - at, []
    label = label.copy()
    for i in range(len(n) - 1):
        j = np.arange(i + 1, len(n))
        j = j[(groups[j] != groups[i]) & (label[j] != label[i]) & ((blocks[j] != blocks[i]) | (not two))]
        j = j[np.minimum(reach[j], reach[i]) * (100 + percent) >= percent * (n[j] + n[i])]
        j = j[np.minimum(parts[j], parts[i]).sum(axis=1) * (100 + percent) >= percent * (n[j] + n[i])]
        if similar is not None and len(j):
            j = j[similar(i, j)]
        if len(j):
            j = j[np.unique(label[j], return_index=True)[1]]
            out.append(np.stack([np.full(len(j), i), j]))
            label[np.isin(label, label[j])] = label[i]
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


def _dealt(df: DataFrame, group: str, members: Column) -> DataFrame:
    """Rows with the ``block`` of their group to which ``k`` is dealt, of about ``BLOCK`` sets and ``BLOCK_MEMBERS`` of ``members`` at most."""
    sized = df.groupBy(group).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(members) / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    return df.join(sized, group).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))


def _in_blocks(df: DataFrame, group: str, members: Column) -> DataFrame:
    """Rows of each group dealt into blocks, once for each two blocks (``low``, ``high``) that meet with theirs."""
    return _dealt(df, group, members).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"low": F.least("block", "other"), "high": F.greatest("block", "other")})


def _pairs(keys: np.ndarray, found: np.ndarray) -> pa.Table:
    return pa.table({"ka": pa.array(keys[found].min(axis=0), pa.int64()), "kb": pa.array(keys[found].max(axis=0), pa.int64())})


def _clusters(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``k`` and ``cluster`` of sets that have a candidate of another component by one of their early members.

    All candidates of a set are in its cluster. Pairs are looked at in tasks, by
    what the bounds need of each set.
    """
    met = _in_blocks(rest.join(sets.select("k", "h"), "k"), "m", F.lit(0)).select("m", "low", "high", "block", "k", "component", "n", "at", "h")

    def compare(table):
        k, n, at, block, component = (table[c].to_numpy() for c in ("k", "n", "at", "block", "component"))
        parts = table["h"].combine_chunks().flatten().to_numpy().reshape(len(k), PARTS)
        return _pairs(k, forest(n, parts, component, np.arange(len(k)), block, percent, at))

    joined = met.groupBy("m", "low", "high").applyInArrow(compare, "ka bigint, kb bigint")
    return components(saved(joined.distinct(), "near"), "ka", "kb", few=False).withColumnsRenamed({"node": "k", "component": "cluster"})


def _joining(met: DataFrame, sets: DataFrame, df: DataFrame, text_col: str, percent: int, size: int) -> DataFrame:
    """Links ``ka``, ``kb`` that join the components which similar sets of one task (``cluster``, ``low``, ``high``) join.

    ``met`` has what a task gets of each set: ``k``, ``block`` and ``component``; it is read twice.
    """
    wanted = met.select("k").distinct()
    whole = _whole(sets.select("k", "key", "t").join(wanted, "k", "left_semi"), df, text_col, size)

    def compare(table):
        k, block, component = (table[c].to_numpy() for c in ("k", "block", "component"))
        lists = table["members"].combine_chunks()
        n = lists.value_lengths().to_numpy().astype(np.int64)
        members = np.split(lists.flatten().to_numpy().view(np.uint64), np.cumsum(n)[:-1])
        parts = np.stack([np.bincount((x & np.uint64(MANY_PARTS - 1)).astype(np.int64), minlength=MANY_PARTS).astype(np.int32) for x in members])

        def similar(i, j):
            return [x + y for x in range(0, len(j), TREE) for y in walk(members[i], [members[z] for z in j[x:x + TREE]], percent)]

        return _pairs(k, forest(n, parts, component, component, block, percent, similar=similar))

    sides = met.join(whole, "k").select("cluster", "low", "high", "block", "k", "component", "members")
    return saved(sides.groupBy("cluster", "low", "high").applyInArrow(compare, "ka bigint, kb bigint").distinct(), "similar")


def _between(clusters: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of each cluster in blocks, each two of which meet; ``found`` has ``k`` and ``component``."""
    placed = clusters.join(found, "k", "left").withColumn("component", F.coalesce("component", "k")).join(sets.select("k", "n"), "k")
    return saved(_in_blocks(placed, "cluster", F.col("n")).select("cluster", "low", "high", "block", "k", "component"), "placed")


def _of_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The sets of pairs ``ka``, ``kb`` that the bounds leave, for each two blocks that a pair is in; ``sets`` has ``k``, ``n`` and ``h``.

    A set is moved once for each two blocks, not for each pair: one that very
    many meet goes to as many tasks as their blocks. Each ``ka`` should have few
    ``kb``: these are in one row while its own columns are looked up.
    """
    # No more can be common than the smaller count in each part of the hash range.
    side = lambda x: sets.select(*[F.col(c).alias(c + x) for c in ("k", "n", "h")])
    most = F.aggregate(F.zip_with("ha", "hb", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    pairs = pairs.groupBy("ka").agg(F.collect_set("kb").alias("all")).join(side("a"), "ka").withColumn("kb", F.explode("all")).drop("all") \
        .join(side("b"), "kb").where(most * (100 + percent) >= percent * (F.col("na") + F.col("nb")))
    pairs = saved(pairs.select("ka", "kb"), "pairs")
    clusters = components(pairs, "ka", "kb", few=False).withColumnsRenamed({"node": "k", "component": "cluster"})
    dealt = _dealt(clusters.join(sets.select("k", "n"), "k"), "cluster", F.col("n"))
    end = lambda x: dealt.select(F.col("k").alias("k" + x), "cluster", F.col("block").alias("block" + x))
    tasks = pairs.join(end("a"), "ka").join(end("b").drop("cluster"), "kb").withColumns({"low": F.least("blocka", "blockb"), "high": F.greatest("blocka", "blockb")})
    ends = tasks.select("cluster", "low", "high", F.explode(F.array(*[F.struct(F.col("k" + x).alias("k"), F.col("block" + x).alias("block")) for x in "ab"])).alias("of"))
    return saved(ends.select("cluster", "low", "high", "of.block", "of.k", F.col("of.k").alias("component")).distinct(), "met")


def _bitmap(bits: DataFrame) -> np.ndarray:
    """True at every ``h``; it comes to the driver in pieces of fixed size, put together in tasks."""
    at = F.col("h") + 1
    pieces = bits.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros((-(-FILTER // (1 << 15)), 1 << 12), np.uint8)
    for row in pieces:
        out[row.piece - 1] = np.frombuffer(row.bits, np.uint8)
    return np.unpackbits(out.ravel(), bitorder="little")[:FILTER].astype(bool)


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """Each set with the one that has the fewest members of its own, by the most shared of its members.

    Which pairs are taken here is free. A set's most shared member leads to the
    family it may be of. The set met comes last: very many meet it, and it few.
    """
    least = members.groupBy("m").agg(F.min(F.struct("own", "k", "n", "at")).alias("least"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("sets"), "m"))
    tried = members.withColumn("rank", rank).where(F.col("rank") == 1)
    return tried.join(least, "m").where("k <> least.k").select(
        F.struct("k", "n", "at").alias("a"), F.struct("least.k", "least.n", "least.at").alias("b")).where(_may_link(percent)) \
        .select(F.col("a.k").alias("ka"), F.col("b.k").alias("kb"))


def _merged(found: DataFrame, between: DataFrame) -> DataFrame:
    """``k`` and ``component`` after the links ``between`` are added to the components ``found``."""
    # Each set stands for its component, so the rounds have only the links between those.
    names = found.withColumnRenamed("component", "of")
    named = lambda c: F.coalesce("of", c).alias(c)
    first = between.join(names.withColumnRenamed("k", "ka"), "ka", "left").select(named("ka"), "kb")
    ends = first.join(names.withColumnRenamed("k", "kb"), "kb", "left").select("ka", named("kb")).distinct()
    joined = components(ends, "ka", "kb", few=False).withColumnsRenamed({"node": "old", "component": "new"})
    singles = ends.select(F.explode(F.array("ka", "kb")).alias("k")).distinct().join(found, "k", "left_anti").select("k", F.col("k").alias("component"))
    return found.union(singles).join(joined, F.col("component") == F.col("old"), "left").select("k", F.coalesce("new", "component").alias("component"))


def shingle_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, size: int = 3) -> tuple[DataFrame, DataFrame]:
    """Id, ``n_shingles`` and ``component_id`` of every row; and links between different sets (``a``, ``b``: the smallest ids of each).

    The links span the components: of sets in one component, not every link is listed.

    Words are runs of anything but ASCII blanks, with A-Z in lower case. Texts
    link when their intersection has at least ``percent`` of their union.
    ``component_id`` is the smallest id reachable, the row's own included; of
    null ids it is null unless a linked row has one. Null and empty texts have
    no shingles and link with nothing. Rows may repeat; equal texts are linked.
    """
    first = _first(df, text_col, percent, size)
    many = saved(first.groupBy("m").agg(F.count("*").alias("texts")).where(F.col("texts") > SMALL), "common")
    # Any choice gives a valid order; the most common members are taken, at most MOST_COMMON.
    common = [r.m for r in many.orderBy(F.desc("texts"), "m").limit(MOST_COMMON).select("m").toLocalIterator()]
    rows = saved(_sets(df, id_col, text_col, percent, size, common), "early")
    # A set has the number of its first row, and is moved without its members.
    kinds = rows.where("n > 0").groupBy("key").agg(F.min("row").alias("row"), F.min("id").alias("least"))
    sets = saved(kinds.drop("key").join(rows.select("row", "key", "n", "own", "h", "t"), "row").withColumnRenamed("row", "k"), "sets")
    # Most members are in one set only: rows of all members are small and are moved once.
    single = rows.join(sets.select(F.col("k").alias("row")), "row", "left_semi")
    every = single.select(F.col("row").alias("k"), F.col("n").cast("int").alias("n"), F.col("own").cast("int").alias("own"), F.posexplode("early").alias("at", "m"))
    twice = every.groupBy("m").agg(F.count("*").alias("sets")).where("sets > 1")
    members = saved(every.join(twice, "m"), "members")
    small, large = members.where(F.col("sets") <= SMALL), members.where(F.col("sets") > SMALL)
    pair = [F.col("a.k").alias("ka"), F.col("b.k").alias("kb")]
    close = small.alias("a").join(small.alias("b"), (F.col("a.m") == F.col("b.m")) & (F.col("a.k") < F.col("b.k")) & _may_link(percent)).select(*pair)
    links = _joining(_of_pairs(close.union(_stars(large, percent)), sets, percent), sets, df, text_col, percent, size)
    found = saved(components(links, "ka", "kb", few=False).withColumnsRenamed({"node": "k"}), "components")
    placed = large.join(found, "k", "left").withColumn("component", F.coalesce("component", "k"))
    # Only members whose sets are in several components can still link two of them.
    apart = placed.groupBy("m").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("m")
    rest = saved(placed.join(apart, "m", "left_semi"), "rest")
    if not rest.isEmpty():
        between = _joining(_between(_clusters(rest, sets, percent), found, sets), sets, df, text_col, percent, size)
        if not between.isEmpty():
            links, found = links.union(between), saved(_merged(found, between), "components")
    named = sets.select("k", "key", "least").join(found, "k", "left").withColumn("component", F.coalesce("component", "k"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(smallest, "component").select("key", "component_id")
    out = rows.select("id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(of, "key", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    ids = lambda k, c: sets.select(F.col("k").alias(k), F.col("least").alias(c))
    return out, links.join(ids("ka", "a"), "ka").join(ids("kb", "b"), "kb").select("a", "b")
