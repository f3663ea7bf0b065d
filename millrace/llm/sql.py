"""DuckDB SQL for the operators that SQL can express, over whole tables like the queries themselves."""

from __future__ import annotations

from millrace.llm import langid, rules, simhash, urls
from millrace.llm.features import STOPWORDS

_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STOP = ", ".join(f"'{w}'" for w in sorted({w for words in STOPWORDS.values() for w in words.split()}))
_COUNT = "len(list_filter(w, lambda x: {}))"
_STATS = {
    "n_words": "len(w)",
    "n_upper": _COUNT.format("length(x) > 1 AND upper(x) = x AND lower(x) <> x"),
    "n_marked": _COUNT.format(r"x <> '|' AND regexp_matches(x, '[#$%&*@^~<>{}\[\]\\|=+_]')"),
    "n_pipe": _COUNT.format("x = '|'"),
    "n_clean": _COUNT.format(r"regexp_full_match(x, '[\p{L}\p{Nl}\p{No}]+([''’-][\p{L}\p{Nl}\p{No}]+)*[.,;:!?]?') AND NOT (length(x) > 2 AND regexp_matches(substr(x, 2, 1), '\p{Lu}'))"),
    "n_stop": _COUNT.format(f"""lower(trim(x, '.,;:!?"''()')) IN ({_STOP})"""),
    "n_repeat": "len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))",
    "n_distinct": "list_unique(w)",
    "n_lines": "len(l)",
    "n_dup_lines": "len(l) - list_unique(l)",
    "n_letters": r"list_sum(list_transform(w, lambda x: length(regexp_replace(x, '[^\p{L}]', '', 'g'))))",
    "n_bang": _COUNT.format("suffix(x, '!!')"),
    "n_word_chars": "list_sum(list_transform(w, lambda x: length(x)))",
    "n_chars": "length(text)",
}
_LEDGER = (
    "SELECT *, " + " | ".join(f"(CASE WHEN {cond} THEN {1 << bit} ELSE 0 END)::BIGINT" for bit, _, cond in rules.RULES) + " AS fail_bits FROM (SELECT doc_id, "
    + ", ".join(f"coalesce({e}, 0)::BIGINT AS {n}" for n, e in _STATS.items())
    + rf" FROM (SELECT *, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') AS w, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS l FROM documents))"
)
_MASKS = rules.policy_masks()
_GRID = ", ".join(f"('{p}', '{name}', {m}, {1 << bit})" for p, m in _MASKS.items() for bit, name, _ in rules.RULES if m >> bit & 1)


def _url_host(c: str) -> str:
    return rf"regexp_replace(regexp_extract(lower({c}), '^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#@]*)', 1), '^(www|m)\.|\.?(:[0-9]*)?$', '', 'g')"


def _normal(c: str) -> str:
    rest = rf"regexp_replace(regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(\.html?)?/?$', '')"
    kept = rf"regexp_replace(regexp_replace(regexp_extract({c}, '^[^?#]*\?([^#]*)', 1), '(^|&){urls.TRACKING}=[^&]*', '', 'g'), '^&', '')"
    return f"CASE WHEN {_url_host(c)} <> '' THEN {_url_host(c)} || {rest} || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END"


_BLOCKED = " OR ".join([f"h = '{b}' OR suffix(h, '.{b}')" for b in urls.BLOCK_HOSTS] + [f"regexp_matches(substr(normal, length(h) + 1), '{r}')" for r in urls.BLOCK_PATHS])
_ALLOWED = ", ".join(f"'{u}'" for u in urls.ALLOW_URLS)
_URLS = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, {_normal("url")} AS normal,
    regexp_extract(regexp_extract(html, '(?is)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)', 1), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS canon,
    regexp_extract(html, '(?is)<meta\b[^>]*http-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1) AS fresh,
    regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root
  FROM (SELECT page_id, url, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>', ' ', 'g') AS html FROM pages)),
links AS (SELECT normal, root, unnest([canon, fresh]) AS t FROM p),
absolute AS (
  SELECT normal, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN root || t END AS u
  FROM links WHERE t <> ''),
edges AS (SELECT normal AS src, {_normal("u")} AS dst FROM absolute),
ways AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
nodes AS (SELECT normal FROM p WHERE normal IS NOT NULL UNION SELECT src FROM ways),
reach AS (SELECT normal, normal AS other FROM nodes UNION SELECT r.normal, b.dst FROM reach r JOIN ways b ON b.src = r.other),
comp AS (SELECT normal, min(other) AS component FROM reach GROUP BY normal),
flags AS (SELECT *, ({_BLOCKED}) AS blocked_self, normal IN ({_ALLOWED}) AS allowed_self FROM (SELECT *, regexp_extract(normal, '^([^/?]*)', 1) AS h FROM comp)),
hit AS (SELECT DISTINCT component FROM flags WHERE blocked_self)
SELECT page_id, url, p.normal, f.component, coalesce(blocked_self, false) AS blocked_self, coalesce(allowed_self, false) AS allowed_self,
  CASE WHEN allowed_self THEN 'allow' WHEN f.component IN (SELECT component FROM hit) THEN 'block' ELSE 'pass' END AS verdict
FROM p LEFT JOIN flags f ON p.normal = f.normal"""

_LANGUAGE = rf"""
WITH s AS (SELECT doc_id, lang, regexp_replace('_' || regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', '_', 'g') || '_', '__+', '_', 'g') AS s FROM documents),
c AS (SELECT doc_id, lang, string_split(s, '') AS c FROM s WHERE length(s) > 2),
t AS (SELECT doc_id, lang, unnest(list_zip(c, c[2:], c[3:])) AS x FROM c),
g AS (
  SELECT doc_id, lang, x[1] AS g FROM t WHERE x[1] <> '_'
  UNION ALL SELECT doc_id, lang, x[1] || x[2] FROM t WHERE x[2] IS NOT NULL
  UNION ALL SELECT doc_id, lang, x[1] || x[2] || x[3] FROM t WHERE x[3] IS NOT NULL AND x[2] <> '_'),
n AS (SELECT doc_id, lang, g, count(*) AS n FROM g GROUP BY ALL),
train AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents WHERE lang IS NOT NULL) WHERE r <= {langid.TRAIN_PER_LANG}),
prof AS (SELECT lang, g, r FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS r FROM n WHERE doc_id IN (FROM train) GROUP BY lang, g) WHERE r < {langid.TOP}),
own AS (SELECT doc_id, g, r FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS r FROM n) WHERE r < {langid.TOP}),
d AS (SELECT doc_id, la.lang AS lang, sum(coalesce(abs(prof.r - own.r), {langid.TOP}))::BIGINT AS d FROM own CROSS JOIN (SELECT DISTINCT lang FROM prof) la LEFT JOIN prof ON prof.lang = la.lang AND prof.g = own.g GROUP BY ALL),
o AS (SELECT doc_id, lang, d, row_number() OVER (PARTITION BY doc_id ORDER BY d, lang) AS k FROM d)
SELECT x.doc_id, a.lang AS pred_lang, a.d AS distance, b.d - a.d AS margin
FROM documents x LEFT JOIN o a ON a.doc_id = x.doc_id AND a.k = 1 LEFT JOIN o b ON b.doc_id = x.doc_id AND b.k = 2"""

_SIMHASH = rf"""
WITH RECURSIVE w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents),
c AS (SELECT doc_id, md5(w) AS h, count(*) AS n FROM w GROUP BY doc_id, w),
df AS (SELECT substr(h, 1, 4) AS b, count(*) AS df FROM c GROUP BY 1),
total AS (SELECT count(*) AS n FROM documents),
weighted AS (
  SELECT doc_id, length(bin(c.n)) * (1 + len(list_filter(range(1, {simhash.LEVELS + 1}), lambda k: (df << k::INT) <= total.n))) AS v,
    [('0x' || substr(h, 1, 8))::BIGINT, ('0x' || substr(h, 9, 8))::BIGINT, ('0x' || substr(h, 17, 8))::BIGINT, ('0x' || substr(h, 25, 8))::BIGINT] AS q
  FROM c JOIN df ON df.b = substr(h, 1, 4), total),
bits AS (SELECT doc_id, k, sum(v * ((q[k // 32 + 1] >> (31 - k % 32)) & 1)) * 2 > sum(v) AS one FROM weighted, range(128) r(k) GROUP BY doc_id, k),
fp AS (SELECT doc_id, string_agg(CASE WHEN one THEN '1' ELSE '0' END, '' ORDER BY k)::BIT AS f FROM bits GROUP BY doc_id),
f AS (SELECT f, min(doc_id) AS id FROM fp GROUP BY f),
e AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.id <> b.id AND bit_count(xor(a.f, b.f)) <= {simhash.RADIUS}),
reach AS (SELECT id, id AS other FROM f UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other),
comp AS (SELECT id, min(other) AS g FROM reach GROUP BY id),
grp AS (SELECT fp.doc_id, comp.g FROM fp JOIN f ON f.f = fp.f JOIN comp ON comp.id = f.id)
SELECT d.doc_id, coalesce(g, d.doc_id) AS group_id, CASE WHEN g IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g) - 1 END AS n_links, coalesce(g, d.doc_id) = d.doc_id AS keep FROM documents d LEFT JOIN grp ON grp.doc_id = d.doc_id"""

SQL: dict[str, str] = {
    "op5_simhash_dedup": _SIMHASH,
    "op6_quality_rules": "SELECT *, " + ", ".join(f"(fail_bits & {m}) = 0 AS keep_{p}" for p, m in _MASKS.items()) + f" FROM ({_LEDGER})",
    "quality_rule_ablations": f"WITH c AS (SELECT fail_bits, count(*) AS n, sum(n_words) AS w FROM ({_LEDGER}) GROUP BY 1) SELECT policy, rule, coalesce(sum(n), 0)::BIGINT AS failed, coalesce(sum(n) FILTER (WHERE fail_bits & mask = bit), 0)::BIGINT AS only_this, coalesce(sum(w) FILTER (WHERE fail_bits & mask = bit), 0)::BIGINT AS words_regained FROM (VALUES {_GRID}) g(policy, rule, mask, bit) LEFT JOIN c ON fail_bits & bit <> 0 GROUP BY policy, rule",
    "op7_url_filters": _URLS,
    "op9_language_id": _LANGUAGE,
}
