"""URL filters: parts, rules, and the model against plain Python."""

import math
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from plaintide.llm import urls
from plaintide.llm.common import saved

from .conftest import EXTRA, TABLES


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = lambda text, marks: min([text.index(m) for m in marks if m in text], default=len(text))
    at = ends(rest, "/?#")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
    return host, rest[at:][:ends(rest[at:], "?#")]


def plain_rule(host, path):
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


class Plain:
    """Witten-Bell over all contexts of up to ORDER characters."""

    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        for text in texts:
            for gram in self.grams(text):
                for k in range(urls.ORDER + 1):
                    self.counts[gram[urls.ORDER - k:-1]][gram[-1]] += 1

    @staticmethod
    def grams(text):
        padded = urls.START * urls.ORDER + text + urls.END
        return [padded[i:i + urls.ORDER + 1] for i in range(len(text) + 1)]

    def p(self, gram, size):
        value = 1 / (size + 1)
        for k in range(urls.ORDER + 1):
            seen = self.counts.get(gram[urls.ORDER - k:-1])
            if seen:
                value = (seen[gram[-1]] + len(seen) * value) / (sum(seen.values()) + len(seen))
        return value


def plain_filter(rows):
    judged = [(i, u or "", *plain_parts(u)) for i, u in rows]
    judged = [(*r, *plain_rule(*r[2:])) for r in judged]
    learns = lambda i: i is None or zlib.crc32(str(i).encode()) % 4 != 2
    models = {v: Plain([r[1] for r in judged if r[5] == v and learns(r[0])]) for v in ("allow", "block")}
    size = len({c for r in judged for c in r[1]} | {urls.END})

    def steps(text):
        ratios = [round((math.log(models["allow"].p(g, size)) - math.log(models["block"].p(g, size))) * urls.UNIT) for g in Plain.grams(text)]
        return sum(ratios) // (len(ratios) * (urls.UNIT // urls.STEPS))

    scored = [(*r, steps(r[1])) for r in judged]
    held = [(r[6], r[5]) for r in scored if r[5] and not learns(r[0])]
    na, nb = (sum(v == kind for _, v in held) for kind in ("allow", "block"))
    least = 0
    if na and nb:
        right = lambda t: sum(v == "allow" for s, v in held if s >= t) / na + sum(v == "block" for s, v in held if s < t) / nb
        seen = sorted({s for s, _ in held})
        best = max(range(len(seen)), key=lambda i: (right(seen[i]), -i))
        least = (seen[best - 1] + seen[best]) // 2 + 1 if best else seen[0]
    return sorted([(r[0], r[2], r[3], r[4], r[5] or ("allow" if r[6] >= least else "block"), r[6] / urls.STEPS) for r in scored], key=repr)


def found(frame):
    return sorted((tuple(r) for r in urls.url_filter(frame).collect()), key=repr)


def frame_of(spark, rows):
    frame = spark.createDataFrame(rows, "page_id bigint, url string").repartition(3)
    return frame.select("*", *[F.lit(f"own {c}").alias(c) for c in [*EXTRA, "host", "path", "rule", "verdict", "learn", "row", "text", "gram"]])


HARD = ["http://a.net/x", "http://net/", "https://NET/y#f", "http://a.net", "http://a.net?/en/", "HTTP://Example.NET/en/", "http://x.example.net/en/1",
        "http://example.net/EN/1", "http://notexample.com/de/", "http://example.com/de/?q=/fr/", "http://org/fr/", "http://a.org/fr/x", "http://a.org/fr", "http://a.org/es/",
        "://host/p", "a://b://c/d", "no scheme", "", None, "http://", "http:///p", "http://é.org/fr/日本\U0001F600", "http://a.net/\n/b", "\x02\x03://x.org/fr/",
        "http://u:p@Host.org:80/fr/", "http://a.net/x"]


def test_hard_urls(spark):
    rows = [*enumerate(HARD), (None, "http://a.net/x"), (None, None)]
    assert found(frame_of(spark, rows)) == plain_filter(rows)


def test_random_urls(spark):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 6)))
    rows = []
    for i in range(600):
        host, letters = rng.choice([("net", "xyz"), ("org", "abc"), ("com", "abxy"), ("example.com", "abz")])
        rows.append((i, f"http{rng.choice(['', 's'])}://{word(letters)}.{host}/{rng.choice(['en', 'fr', 'de'])}/{word(letters)}?{word('qr')}"))
    assert found(frame_of(spark, rows)) == plain_filter(rows)


def test_pages(spark):
    pages = spark.read.parquet(f"{TABLES}/pages.parquet")
    assert found(pages) == plain_filter([(r.page_id, r.url) for r in pages.collect()])


def test_model_tells_kinds_apart(spark):
    """URLs that no rule judges, made like those that rules allow or block."""
    rng = random.Random(9)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    rows = [(i, f"http://{word('casino')}.net/{word('casino')}") for i in range(200)] \
        + [(200 + i, f"http://{word('hearty')}.org/fr/{word('hearty')}") for i in range(200)] \
        + [(400 + i, f"http://{word('casino')}.com/{word('casino')}") for i in range(50)] + [(450 + i, f"http://{word('hearty')}.com/{word('hearty')}") for i in range(50)]
    verdicts = {r[0]: r[4] for r in found(frame_of(spark, rows))}
    right = sum(verdicts[400 + i] == "block" for i in range(50)) + sum(verdicts[450 + i] == "allow" for i in range(50))
    assert right >= 95


def test_one_kind_only_and_nothing(spark):
    rows = [(i, f"http://a.org/fr/{i}") for i in range(20)] + [(20, "http://a.com/")]
    assert found(frame_of(spark, rows)) == plain_filter(rows)
    assert found(frame_of(spark, rows).limit(0)) == []


def test_long_urls(spark):
    rows = [(0, "http://a.net/" + "x" * (1 << 20)), (1, "http://b.org/fr/" + "1," * (1 << 19)), (2, "http://c.com/" + "\t" * (1 << 20)), (3, None)]
    judged = found(frame_of(spark, rows))
    assert [(r[0], r[3]) for r in judged] == [(0, "net/"), (1, "org/fr/"), (2, None), (3, None)]
    assert [r[4] for r in judged][:2] == ["block", "allow"] and len(judged[0][2]) == (1 << 20) + 1


def test_no_table_goes_through_the_driver(spark, monkeypatch):
    """A saved table looks as small as its file, the characters of all URLs as small as the URLs: no join may broadcast them."""
    made = []
    monkeypatch.setattr(urls, "saved", lambda df, name: made.append((name, df)) or saved(df, name))
    rows = [(i, f"http://a{i % 7}.{'net' if i % 2 else 'org/fr'}/{i}") for i in range(300)]
    assert found(frame_of(spark, rows)) == plain_filter(rows)
    plans = [(name, df._jdf.queryExecution().executedPlan().toString()) for name, df in made]
    assert [name for name, _ in plans] == ["urls", "grams", *["model"] * (urls.ORDER + 1), "scores"]
    assert not [name for name, plan in plans if "Broadcast" in plan] and sum(plan.count("SortMergeJoin") > 0 for _, plan in plans) == urls.ORDER + 2
