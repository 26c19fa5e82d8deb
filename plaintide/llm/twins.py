"""SQL of the URL filters, the Merkle manifest and the spelling variants."""

from __future__ import annotations

from . import urls

#: One row with the table of CRC-32, made by its rule.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(
    list_prepend(n, list_transform(range(8), lambda i: 0::BIGINT)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of an expression, beside ``crc_table``."""
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def url_filter_sql() -> str:
    fits = "".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN struct_pack(rule := '{h}{p}', verdict := '{v}')\n"
        for h, p, v in sorted(urls.RULES, key=lambda r: -len(r[0]) - len(r[1])))
    size, levels = urls.ORDER + 1, []
    for k in range(size):
        p = {c: "1.0::DOUBLE / (SELECT count(DISTINCT right(g, 1)) + 1 FROM counts)" if k == 0 else f"l.{c}_p" for c in ("allow", "block")}
        smooth = ", ".join(f"CASE WHEN {c}_n + {c}_kinds > 0 THEN (o.{c} + {c}_kinds * {p[c]}) / ({c}_n + {c}_kinds) ELSE {p[c]} END AS {c}_p"
                           for c in ("allow", "block"))
        levels.append(f"""own{k} AS (SELECT right(g, {k + 1}) AS gram, left(right(g, {k + 1}), {k}) AS context, CAST(sum(allow) AS BIGINT) AS allow, CAST(sum(block) AS BIGINT) AS block
  FROM counts GROUP BY ALL),
sums{k} AS (SELECT context, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}_n, count(*) FILTER ({c} > 0) AS {c}_kinds' for c in ('allow', 'block'))} FROM own{k} GROUP BY context),
model{k} AS (SELECT o.gram, {smooth} FROM own{k} o JOIN sums{k} USING (context){f' JOIN model{k - 1} l ON l.gram = right(o.gram, {k})' if k else ''})""")
    return f"""
WITH {CRC_TABLE},
split AS (SELECT page_id, coalesce(url, '') AS text,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, text, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
ruled AS (SELECT *, row_number() OVER () AS id, CASE {fits} END AS found FROM hosts),
judged AS (SELECT page_id, text, host, path, id, found.rule AS rule, found.verdict AS verdict,
    coalesce({crc32("CAST(page_id AS VARCHAR)")} % 4 <> 2, true) AS learn FROM ruled, crc_table),
padded AS (SELECT *, repeat(chr(2), {urls.ORDER}) || text || chr(3) AS p FROM judged),
windows AS (SELECT id, learn, verdict, unnest(list_transform(range(1, length(p) - {urls.ORDER - 1}), lambda i: substr(p, i, {size}))) AS g FROM padded),
counts AS (SELECT g, count(*) FILTER (learn AND verdict = 'allow') AS allow, count(*) FILTER (learn AND verdict = 'block') AS block FROM windows GROUP BY g),
{','.join(levels)},
scored AS (SELECT id, CAST(floor(sum(CAST(round((ln(allow_p) - ln(block_p)) * {urls.UNIT}) AS BIGINT)) / CAST(count(*) * {urls.UNIT // urls.STEPS} AS DOUBLE)) AS BIGINT) AS steps
  FROM windows JOIN model{urls.ORDER} ON gram = g GROUP BY id),
every AS (SELECT * FROM judged JOIN scored USING (id)),
kinds AS (SELECT steps, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM every WHERE NOT learn AND verdict IS NOT NULL GROUP BY steps),
sides AS (SELECT steps, lag(steps) OVER (ORDER BY steps) AS prior, sum(a) OVER () AS na, sum(b) OVER () AS nb,
    sum(a) OVER (ORDER BY steps ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ra,
    coalesce(sum(b) OVER (ORDER BY steps ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rb FROM kinds),
least AS (SELECT CASE WHEN prior IS NULL THEN steps ELSE CAST(floor((prior + steps) / 2.0::DOUBLE) AS BIGINT) + 1 END AS t FROM sides WHERE na > 0 AND nb > 0 ORDER BY ra::DOUBLE / na::DOUBLE + rb::DOUBLE / nb::DOUBLE DESC, steps LIMIT 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN steps >= coalesce((SELECT t FROM least), 0) THEN 'allow' ELSE 'block' END) AS verdict FROM every"""


def _tree_sql(name: str, levels: int) -> str:
    """Levels of the trees whose leaves are ``{name}0`` (``key, place, h``), with what is left and right of each node in its run."""
    parts = []
    for k in range(levels):
        beside = "string_agg(h, '') OVER (PARTITION BY key, place // 16 ORDER BY place ROWS BETWEEN {})"
        parts.append(f"""{name}{k}s AS (SELECT key, place, h, count(*) OVER (PARTITION BY key) AS n,
    coalesce({beside.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS l,
    coalesce({beside.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS r FROM {name}{k}),
{name}{k + 1} AS (SELECT key, place // 16 AS place, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY place)) END AS h
  FROM {name}{k}s GROUP BY key, place // 16)""")
    return ",\n".join(parts)


def _climb_sql(start: str, name: str, levels: int, key: str, place: str, out: str) -> str:
    """Rows of ``start`` with ``proof`` and ``fold`` led on through the levels of a tree."""
    parts = []
    for k in range(levels):
        source, target = (start if k == 0 else f"{out}{k - 1}"), (out if k == levels - 1 else f"{out}{k}")
        parts.append(f"""{target} AS (SELECT x.* REPLACE (x.proof || s.l || s.r AS proof,
    CASE WHEN s.n = 1 THEN x.fold ELSE sha256(s.l || x.fold || s.r) END AS fold)
  FROM {source} x JOIN {name}{k}s s ON s.key = x.{key} AND s.place = x.{place} // {16 ** k})""")
    return ",\n".join(parts)


def manifest_sql(levels: int = 6, top_levels: int = 4) -> str:
    """Good for trees of up to 16 ** ``levels`` leaves and 16 ** ``top_levels`` sources."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    return f"""
WITH {CRC_TABLE},
leaves AS (SELECT doc_id, coalesce('=' || source, '') AS key, {leaf('text')} AS leaf,
    CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf('lowered')} ELSE {leaf('text')} END AS edited
  FROM (SELECT *, {_LOWER.format('text')} AS lowered FROM documents), crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
a0 AS (SELECT key, place, leaf AS h FROM placed),
{_tree_sql('a', levels)},
b0 AS (SELECT 0 AS key, row_number() OVER (ORDER BY key) - 1 AS place, h, key AS source FROM a{levels}),
{_tree_sql('b', top_levels)},
start AS (SELECT p.doc_id, p.key, p.place, p.leaf, b.h AS subroot, 0 AS one, b.place AS above, '' AS proof, p.edited AS fold
  FROM placed p JOIN b0 b ON b.source = p.key),
{_climb_sql('start', 'a', levels, 'key', 'place', 'inner_')},
{_climb_sql('inner_', 'b', top_levels, 'one', 'above', 'whole')}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified
FROM whole, b{top_levels}"""


def spelling_sql() -> str:
    return f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
kinds AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
coded AS (SELECT run, n, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM kinds, crc_table),
taken AS (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM coded),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM taken WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word),
near AS (SELECT word, count(*) AS n_near, arg_max(struct_pack(form := other, m := m), (m, -rank)) AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other) AS rank FROM pairs) GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN best.m >= 5 * w.n THEN best.form END AS form, CASE WHEN best.m >= 5 * w.n THEN best.m END AS form_n FROM words w LEFT JOIN near USING (word)),
steps AS (SELECT word, form AS reached, 1 AS step FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT s.word, f.form, s.step + 1 FROM steps s JOIN forms f ON f.word = s.reached WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(reached, step) AS root FROM steps GROUP BY word)
SELECT word, n, n_near, form, form_n, coalesce(root, word) AS root FROM forms LEFT JOIN ends USING (word)"""
