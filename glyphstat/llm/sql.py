"""DuckDB SQL for the queries of this subpackage that SQL can express.

Toxicity, the forest's verdicts and token ids come from trained models and vocabularies; they are
tested against brute force, held-out labels and the tokenizers library. What line deduplication
keeps follows from an alignment, and what conversation repair does from a search, which SQL does not have. The scores of the backoff
model are long sums of logarithms, whose last digits depend on the order of addition; they are compared with a plain
version of the model.
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_PHRASES = rf"""
WITH texts AS (SELECT doc_id, {_WORDS} AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM texts WHERE len(words) >= 20),
ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY hash(array_to_string(words[i:i + 19], ' ')) ORDER BY doc_id, i) AS place FROM starts
),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM ranked WHERE place > 1),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(len(t.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.words, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""

_SUFFIXES = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM texts WHERE n >= 200),
keyed AS MATERIALIZED (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS k FROM starts),
twice AS (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1),
hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM keyed SEMI JOIN twice USING (k)),
islands AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hits),
spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM islands GROUP BY doc_id, g),
pieces AS (
  SELECT doc_id, g, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY g), 0) AS a, a AS b FROM spans
  UNION ALL SELECT doc_id, max(g) + 1, max(b), NULL FROM spans GROUP BY doc_id
),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY g) AS h
  FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id
),
counts AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, CAST(coalesce(c.removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(c.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN counts c USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

_MIX = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS rank FROM documents
),
sizes AS (SELECT source, sum(size) AS source_size, count(*) AS n_docs FROM docs GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
    2 * source_size AS top FROM sizes
),
levels AS (
  SELECT *, top / weight AS ratio,
    ((sum(source_size) OVER ()) * 150 / 100.0::DOUBLE
      - coalesce(sum(top) OVER (ORDER BY top / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY top / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
),
targets AS (
  SELECT source, source_size, coalesce(least(CAST(top AS DOUBLE), weight * (SELECT arg_min(level, (ratio, place)) FROM levels WHERE ratio > level)), 0) AS target,
    greatest(1, ceil((source_size + n_docs) / 2097152)) AS n_shards FROM levels
),
seats AS (SELECT CAST(round(sum(target) / 32) AS BIGINT) AS n FROM targets),
quotients AS (SELECT source, target / (2 * k + 1) AS q, k FROM targets, seats, unnest(range(0, n + 1)) AS r(k)),
quotas AS (
  SELECT source, count(*) FILTER (place <= n) AS quota
  FROM (SELECT source, row_number() OVER (ORDER BY q DESC, source NULLS LAST, k) AS place FROM quotients), seats GROUP BY source
),
dealt AS (
  SELECT d.*, t.source_size, t.target, q.quota, CAST('0x' || substr(rank, 1, 8) AS BIGINT) % CAST(n_shards AS BIGINT) AS shard
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source
),
shards AS (SELECT source, shard, sum(size) AS words, any_value(quota) AS quota FROM dealt GROUP BY source, shard),
shard_quotients AS (SELECT source, shard, quota, words / (2 * k + 1) AS q, k FROM shards, unnest(range(0, quota + 1)) AS r(k)),
shard_quotas AS (
  SELECT source, shard, count(*) FILTER (place <= quota) AS blocks
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard, k) AS place FROM shard_quotients) GROUP BY source, shard
),
passes AS (
  SELECT s.source, s.shard, least(blocks, 2 * ceil(words / 32)) AS blocks, ceil(words / 32) AS n_blocks
  FROM shards s JOIN shard_quotas q ON s.source IS NOT DISTINCT FROM q.source AND s.shard = q.shard
),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY rank, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS done FROM dealt
)
SELECT p.doc_id, p.size, CAST(p.source_size AS BIGINT) AS source_size, p.target,
  CAST(CASE WHEN n_blocks = 0 THEN 0 ELSE
    floor(blocks / n_blocks) * size + greatest(0, least((blocks % n_blocks) * 32 - done + size, size)) END AS BIGINT) AS taken
FROM placed p JOIN passes b ON p.source IS NOT DISTINCT FROM b.source AND p.shard = b.shard
"""

_NEAR = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN 'short ' || array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY u, v
),
links AS (
  SELECT u, v FROM common c JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * c.n >= 85 * (a.n + b.n - c.n)
),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least_ AS (SELECT u, min(v) AS v FROM reach GROUP BY u)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, least(t.doc_id, coalesce(r.v, t.doc_id)) AS component_id,
  t.doc_id <= coalesce(r.v, t.doc_id) AS kept
FROM texts t LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_ r ON r.u = t.doc_id
"""

_TOP = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

_URLS = r"""
WITH RECURSIVE urls AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls
),
tags AS (
  SELECT host, path, rest, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1))
  )) AS target FROM split
),
ends AS (
  SELECT host || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS a,
    CASE WHEN instr(target, '://') > 0 THEN substr(target, instr(target, '://') + 3) WHEN target LIKE '//%' THEN substr(target, 3)
      WHEN target LIKE '/%' THEN host || target
      ELSE host || CASE WHEN regexp_extract(path, '^.*/') = '' THEN '/' ELSE regexp_extract(path, '^.*/') END || target END AS b
  FROM tags WHERE target <> '' AND host <> ''
),
named AS (
  SELECT regexp_replace(a, '^([^/?#]*)([?]|$)', '\1/\2') AS a,
    regexp_replace(translate(regexp_extract(b, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(b, '^[^/?#]*([^#]*)', 1), '^([^/?#]*)([?]|$)', '\1/\2') AS b
  FROM ends
),
links AS (SELECT a, b FROM named UNION SELECT b, a FROM named),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
rules(verdict, name, start) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
),
nodes AS (SELECT DISTINCT b AS node, regexp_extract(b, '^[^/?#]*') AS host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
blocked AS (
  SELECT node FROM nodes n JOIN rules r ON (n.host = name OR n.host LIKE '%.' || name) AND starts_with(n.path, start)
  GROUP BY node HAVING arg_max(verdict, length(name || start)) = 'block'
),
tainted AS (SELECT DISTINCT a AS node FROM reach JOIN blocked ON b = node),
own AS (
  SELECT DISTINCT host, path, arg_max(name || start, length(name || start)) AS rule, arg_max(verdict, length(name || start)) AS verdict
  FROM (SELECT DISTINCT host, path FROM split) s JOIN rules r ON (host = name OR host LIKE '%.' || name) AND starts_with(path, start) GROUP BY host, path
)
SELECT s.page_id, coalesce(s.host, '') AS host, coalesce(s.path, '') AS path, o.rule,
  coalesce(o.verdict, CASE WHEN t.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN own o ON s.host = o.host AND s.path = o.path
LEFT JOIN tainted t ON s.host <> '' AND t.node = regexp_replace(s.host || regexp_extract(s.rest, '^[^/?#]*([^#]*)', 1), '^([^/?#]*)([?]|$)', '\1/\2')
"""

def _crc_table() -> str:
    """The 256 remainders of CRC-32, as a list."""
    rows = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        rows.append(str(n))
    return f"[{','.join(rows)}]::BIGINT[]"


def _crc32(text: str) -> str:
    octets = (
        f"list_transform(range(1, 2 * octet_length(encode({text})), 2), "
        f"lambda i: CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT))"
    )
    step = f"xor(c >> 8, ({_crc_table()})[1 + (xor(c, b) & 255)])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {step}), 4294967295::BIGINT)"


_SPELLING = f"""
WITH RECURSIVE found AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM found GROUP BY ALL
),
hashed AS (SELECT run, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM lowered),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
),
counted AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
),
cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM counted, unnest(range(1, length(word) + 1)) AS t(i)
),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, c.word, c.n FROM cut a JOIN counted c ON c.word = a.rest
  UNION SELECT c.word, a.word, a.n FROM cut a JOIN counted c ON c.word = a.rest
),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place FROM near),
forms AS MATERIALIZED (SELECT c.word, r.near AS form, r.n AS form_n FROM counted c JOIN ranked r ON r.word = c.word AND place = 1 AND r.n >= 2 * c.n),
chains AS (
  SELECT word, form AS goal, 1 AS step FROM forms
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chains c JOIN forms f ON f.word = c.goal
),
roots AS (SELECT word, arg_max(goal, step) AS root FROM chains GROUP BY word)
SELECT c.word, f.form, coalesce(r.root, c.word) AS root, c.n, coalesce(k.n_near, 0) AS n_near, f.form_n
FROM counted c LEFT JOIN forms f USING (word) LEFT JOIN roots r USING (word)
LEFT JOIN (SELECT DISTINCT word, n_near FROM ranked) k USING (word)
"""

ORACLES: dict[str, str] = {
    "op1_phrase_dedup": _PHRASES,
    "op2_suffix_dedup": _SUFFIXES,
    "op3_mixing": _MIX,
    "op4_superminhash": _NEAR,
    "op5_topk": _TOP,
    "op10_url_filters": _URLS,
    "op13_spelling": _SPELLING,
}
