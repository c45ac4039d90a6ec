"""The same queries in plain SQL, as independent statements over the given tables."""

from glyphstat.functions.lexing import CPP_KEYWORDS, CPP_NAMED, WORDS_TOKEN, cpp_pattern
from glyphstat.functions.text import PANDAS_NA

ORACLES: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


def _unk(column: str) -> str:
    return f"CASE WHEN {column} IS NULL OR {column} IN {_in(PANDAS_NA)} THEN '<<UNK>>' ELSE {column} END"


def _uuid(dataset: str, path: str, num: str) -> str:
    digest = f"md5(concat_ws('|', {dataset}, {path}, CAST({num} AS VARCHAR)))"
    return (
        f"concat_ws('-', substr({digest}, 1, 8), substr({digest}, 9, 4), substr({digest}, 13, 4), "
        f"substr({digest}, 17, 4), substr({digest}, 21, 12))"
    )


# ---------------------------------------------------------------- shared parts

_WORDS_TYPE = r"""CASE WHEN raw = '<EOF>' THEN 'EOF'
  WHEN regexp_matches(raw, '^[\p{L}_]') THEN 'Identifier'
  WHEN regexp_matches(raw, '^[0-9]+$') THEN 'IntegerLiteral'
  WHEN regexp_matches(raw, '^[0-9]') THEN 'FloatingLiteral' ELSE raw END"""

_DOC_PATH = "concat_ws('/', lang, source, CAST(doc_id AS VARCHAR), 'main.c') AS path"

_DOCS = f"""
docs AS (SELECT lang AS dataset, concat_ws('/', lang, source, CAST(doc_id AS VARCHAR), 'main.c') AS path, text FROM documents),
lex AS (SELECT dataset, path,
  list_append(regexp_extract_all(text, {_text(WORDS_TOKEN)}), '<EOF>') AS t FROM docs),
raws AS (SELECT dataset, path, len(t) AS num_tokens, unnest(t) AS raw,
  unnest(range(len(t))) AS num FROM lex),
tok AS (SELECT dataset, path, num_tokens, CAST(num AS INTEGER) AS token_num, raw AS token_text,
  {_WORDS_TYPE} AS token_type FROM raws),
pairs AS (SELECT * FROM (SELECT dataset, path, token_text, token_type,
  lead(token_text) OVER w AS next_text, lead(token_type) OVER w AS next_type,
  lead(token_text, 2) OVER w AS third
  FROM (SELECT * REPLACE ({_unk('token_text')} AS token_text, {_unk('token_type')} AS token_type) FROM tok)
  WINDOW w AS (PARTITION BY dataset, path ORDER BY token_num)) WHERE third IS NOT NULL)"""

_KEYS = {
    "token_text": f"SELECT dataset, path, num_tokens, {_unk('token_text')} AS key FROM tok",
    "token_type": f"SELECT dataset, path, num_tokens, {_unk('token_type')} AS key FROM tok",
    "bigram_text": "SELECT dataset, path, token_text || '<<>>' || next_text AS key FROM pairs",
    "bigram_type": "SELECT dataset, path, token_type || '<<>>' || next_type AS key FROM pairs",
}


def _hist(kind: str) -> str:
    return f"""{_DOCS}, keys AS ({_KEYS[kind]}),
hist AS (SELECT dataset, key, count(*) AS count FROM keys GROUP BY dataset, key)"""


def _cells(kind: str) -> str:
    return f"""{_hist(kind)},
grid AS (SELECT k.key, d.dataset, coalesce(h.count, 0) AS count, coalesce(r.count, 0) AS ref_count
  FROM (SELECT DISTINCT key FROM hist) k CROSS JOIN (SELECT DISTINCT dataset FROM hist) d
  LEFT JOIN hist h ON h.key = k.key AND h.dataset = d.dataset
  LEFT JOIN hist r ON r.key = k.key AND r.dataset = 'en'),
totals AS (SELECT dataset, sum(count) AS total, max(count) AS peak FROM hist GROUP BY dataset),
cells AS (SELECT g.key, g.dataset, g.count, g.ref_count, t.total, t.peak, r.total AS ref_total,
  r.peak AS ref_peak FROM grid g JOIN totals t ON t.dataset = g.dataset JOIN totals r ON r.dataset = 'en'),
shares AS (SELECT key, dataset, count / total AS share, ref_count / ref_total AS ref_share FROM cells),
logs AS (SELECT *, CASE WHEN share > 0 AND ref_share > 0 THEN ln(share / ref_share) END AS log_ratio
  FROM shares WHERE dataset <> 'en'),
norm AS (SELECT key, dataset, count / peak AS m, ref_count / ref_peak AS r FROM cells),
diff AS (SELECT key, dataset, nullif(CASE WHEN r > 0 THEN (m - r) / r WHEN m > 0 THEN 'inf'::DOUBLE END,
  -1) AS diff FROM norm WHERE dataset <> 'en' AND key NOT IN ('EOF', '<EOF>')),
finite AS (SELECT key, dataset, CASE WHEN diff <> 'inf'::DOUBLE THEN diff END AS diff FROM diff)"""


def _files(kind: str) -> str:
    return f"""{_DOCS}, keys AS ({_KEYS[kind]}),
counts AS (SELECT dataset, path, num_tokens, key, count(*) AS n FROM keys GROUP BY ALL),
by_count AS (SELECT dataset, key, n AS num, count(*) AS n_files FROM counts GROUP BY ALL),
by_ratio AS (SELECT dataset, key,
  CAST(round_even(CAST(n AS DOUBLE) / num_tokens * 10000, 0) AS BIGINT) AS num, count(*) AS n_files
  FROM counts GROUP BY ALL)"""


_EVENTS = f"""
ev AS (SELECT 'W' || CAST((day(ts) - 1) // 7 AS VARCHAR) AS dataset, user_id || '/events.log' AS path,
  event_type, ts, event_id FROM events),
tok AS (SELECT dataset, path, event_type AS token_text, event_type AS token_type,
  row_number() OVER (PARTITION BY dataset, path ORDER BY ts, event_id) - 1 AS token_num FROM ev),
pairs AS (SELECT *, token_type || '<<>>' || next_type AS key FROM (SELECT dataset, path, token_type,
  lead(token_type) OVER w AS next_type, lead(token_type, 2) OVER w AS third FROM tok
  WINDOW w AS (PARTITION BY dataset, path ORDER BY token_num)))"""

_EVENT_COUNTS = f"""{_EVENTS},
kinds AS (SELECT dataset, path, unnest(['token_text', 'token_type']) AS kind, token_type AS key FROM tok
  UNION ALL SELECT dataset, path, unnest(['bigram_text', 'bigram_type']), key FROM pairs
  WHERE third IS NOT NULL),
counts AS (SELECT dataset, path, kind, key, count(*) AS n FROM kinds GROUP BY ALL)"""


def _nine_digits(value: str) -> str:
    """Nine significant digits, half to even; powers of ten above 22 are not exact, so small values are scaled twice."""
    p = "(8 - floor(log10(abs(x))))"
    one, two = f"pow(10.0, least(abs({p}), 22))", f"pow(10.0, abs({p}) - least(abs({p}), 22))"
    rounded = (
        f"CASE WHEN {p} >= 0 THEN round_even(x * {one} * {two}, 0) / {one} / {two} "
        f"ELSE round_even(x / {one} / {two}, 0) * {one} * {two} END"
    )
    return f"list_transform([CAST({value} AS DOUBLE)], lambda x: CASE WHEN x = 0 OR isinf(x) OR isnan(x) THEN x ELSE {rounded} END)[1]"


def _expanded(sql: str) -> str:
    """``digits9(value)`` stands for the value in nine significant digits."""
    while (at := sql.find("digits9(")) >= 0:
        end, depth = at + len("digits9("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[:at] + _nine_digits(sql[at + len("digits9(") : end - 1]) + sql[end:]
    return sql


def _oracle(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = _expanded(f"WITH {ctes.strip()}\n{select.strip()}" if ctes else select.strip())


# ---------------------------------------------------------------- tokens

_oracle("tokenize_documents", _DOCS, "SELECT dataset, path, token_num, token_text, token_type FROM tok")

_BLANK = r"[ \t\r\n\f]*"


def _located(match: str, source: str) -> str:
    # The start of the current line is the end of the last line break before the token.
    return f"""docs AS ({source}),
m AS (SELECT dataset, path, regexp_extract_all(text, {match}, 0) AS w,
  regexp_extract_all(text, {match}, 1) AS t FROM docs),
u AS (SELECT dataset, path, unnest(w) AS w, coalesce(unnest(t), '') AS raw, unnest(range(len(w))) AS i FROM m),
v AS (SELECT *, substr(w, 1, length(w) - length(raw)) AS skipped,
  sum(length(w)) OVER x AS upto,
  sum(length(w) - length(replace(w, chr(10), ''))) OVER x AS breaks
  FROM u WINDOW x AS (PARTITION BY dataset, path ORDER BY i)),
z AS (SELECT *, upto - length(raw) AS char_start,
  breaks - (length(raw) - length(replace(raw, chr(10), ''))) + 1 AS line,
  max(CASE WHEN contains(w, chr(10)) THEN upto - (strpos(reverse(w), chr(10)) - 1) END) OVER
    (PARTITION BY dataset, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier,
  CASE WHEN contains(skipped, chr(10)) THEN strpos(reverse(skipped), chr(10)) - 1 END AS own
  FROM v),
placed AS (SELECT dataset, path, i, raw, char_start, line,
  coalesce(own, char_start - coalesce(earlier, 0)) AS line_char FROM z WHERE raw <> ''
  UNION ALL
  SELECT dataset, path, 1000000000, '<EOF>', length(text),
  1 + length(text) - length(replace(text, chr(10), '')),
  CASE WHEN contains(text, chr(10)) THEN strpos(reverse(text), chr(10)) - 1 ELSE length(text) END FROM docs),
numbered AS (SELECT *, row_number() OVER (PARTITION BY dataset, path ORDER BY i) - 1 AS token_num
  FROM placed)"""


def _shown(raw: str) -> str:
    return rf"replace(replace(replace({raw}, chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"


def _token_columns(type_case: str, channel: str) -> str:
    return f"""dataset, path, regexp_extract(path, '[^/]*$') AS file_name, CAST(token_num AS INTEGER) AS token_num,
  CAST(char_start AS INTEGER) AS char_start,
  CAST(char_start + CASE WHEN raw = '<EOF>' THEN 0 ELSE length(raw) END - 1 AS INTEGER) AS char_end,
  {_shown('raw')} AS token_text, {type_case} AS token_type, {channel} AS channel,
  CAST(line AS INTEGER) AS line, CAST(line_char AS INTEGER) AS line_char"""


_DOCS_SOURCE = "SELECT lang AS dataset, concat_ws('/', lang, source, CAST(doc_id AS VARCHAR), 'main.c') AS path, text FROM documents"
_PAGES_SOURCE = (
    "SELECT regexp_extract(url, '^https?://[^/]*\\.([a-z]+)(?:[:/]|$)', 1) AS dataset, "
    "page_id || '/index.html' AS path, html AS text FROM pages"
)
_WORDS_MATCH = _text(rf"{_BLANK}(?:({WORDS_TOKEN})|\z)")
_CPP_MATCH = _text(cpp_pattern(possessive=False))

_CPP_TYPE = (
    "CASE WHEN raw = '<EOF>' THEN 'EOF' "
    "WHEN regexp_matches(raw, '^(u8|[uUL])?(R?\"|'')') THEN CASE WHEN ends_with(raw, '\"') THEN 'StringLiteral' "
    "WHEN ends_with(raw, '''') THEN 'CharacterLiteral' ELSE 'UserDefinedLiteral' END "
    f"WHEN raw IN {_in(CPP_KEYWORDS)} THEN raw "
    + " ".join(f"WHEN raw = {_text(k)} THEN {_text(v)}" for k, v in CPP_NAMED.items())
    + r" WHEN regexp_matches(raw, '^[A-Za-z_\\]') THEN 'Identifier'"
    r" WHEN regexp_matches(raw, '^\.?[0-9]') THEN CASE"
    r" WHEN regexp_full_match(raw, '(0[xX][0-9a-fA-F](''?[0-9a-fA-F])*|0[bB][01](''?[01])*|[1-9](''?[0-9])*|0(''?[0-7])*)"
    r"([uU](ll|LL|[lL])?|(ll|LL|[lL])[uU]?)?') THEN 'IntegerLiteral'"
    r" WHEN regexp_full_match(raw, '((([0-9](''?[0-9])*)?\.[0-9](''?[0-9])*|[0-9](''?[0-9])*\.)"
    r"([eE][+-]?[0-9](''?[0-9])*)?|[0-9](''?[0-9])*[eE][+-]?[0-9](''?[0-9])*)[flFL]?') THEN 'FloatingLiteral'"
    " ELSE 'UserDefinedLiteral' END"
    " WHEN starts_with(raw, '#') THEN CASE WHEN contains(raw, chr(10)) THEN 'MultiLineMacro' ELSE 'Directive' END"
    " ELSE raw END"
)
_CPP_CHANNEL = "CASE WHEN starts_with(raw, '#') THEN 1 END"
_NO_CHANNEL = "CAST(NULL AS INTEGER)"

_oracle(
    "token_positions", _located(_WORDS_MATCH, _DOCS_SOURCE),
    f"SELECT {_uuid('dataset', 'path', 'token_num')} AS uuid, "
    f"{_token_columns(_WORDS_TYPE, _NO_CHANNEL)} FROM numbered",
)
_oracle(
    "tokenize_cpp_documents", _located(_CPP_MATCH, _DOCS_SOURCE),
    f"SELECT {_token_columns(_CPP_TYPE, _CPP_CHANNEL)} FROM numbered",
)
_oracle(
    "tokenize_cpp_pages", _located(_CPP_MATCH, _PAGES_SOURCE),
    f"SELECT {_token_columns(_CPP_TYPE, _CPP_CHANNEL)} FROM numbered",
)
ORACLES["tokenize_document_parts"] = ORACLES["token_positions"]
ORACLES["tokenize_page_parts"] = ORACLES["tokenize_cpp_pages"]
_oracle(
    "unrecognized_chars", _located(_CPP_MATCH, _DOCS_SOURCE),
    r"""SELECT dataset, path, CAST(sum(length(regexp_replace(w,
  '^([ \t\r\n\f]+|//[^\r\n]*|/\*(?s:.*?)\*/)*', ''))) AS BIGINT) AS lost_chars
FROM u WHERE raw = '' GROUP BY dataset, path HAVING lost_chars > 0""",
)
_oracle(
    "oversized_documents", "",
    f"SELECT {_DOC_PATH}, 'oversized' AS reason FROM documents WHERE length(text) > 10000",
)

# ---------------------------------------------------------------- counts

_HIST_SELECT = "SELECT dataset, key, count FROM hist"

_oracle("tokenize_arrivals", _hist("token_type"), _HIST_SELECT)
_oracle("file_token_counts", _DOCS, "SELECT dataset, path, count(*) AS num_tokens FROM tok GROUP BY ALL")
_oracle("file_value_counts", _files("token_text"), "SELECT dataset, path, key, n FROM counts")
_oracle(
    "event_value_counts", _EVENTS,
    "SELECT dataset, path, token_type AS key, count(*) AS n FROM tok GROUP BY ALL",
)
_oracle(
    "file_bigram_counts", _EVENTS,
    "SELECT dataset, path, key, count(*) AS n FROM pairs WHERE third IS NOT NULL GROUP BY ALL",
)
_oracle(
    "file_bigram_counts_all_pairs", _EVENTS,
    "SELECT dataset, path, key, count(*) AS n FROM pairs WHERE next_type IS NOT NULL GROUP BY ALL",
)
_oracle("file_counts_all_kinds", _EVENT_COUNTS, "SELECT * FROM counts")
_oracle("event_positions", _EVENTS, "SELECT dataset, path, token_num, token_text, token_type FROM tok")
_oracle(
    "event_file_lengths", _EVENTS, "SELECT dataset, path, count(*) AS num_tokens FROM tok GROUP BY ALL"
)


def _entries(kind: str, item: str, separator: str) -> str:
    return f"coalesce(string_agg({item}, '{separator}' ORDER BY key) FILTER (kind = '{kind}'), '')"


_EVENT_ID = _uuid("dataset", "path", "0")
_NUM_TOKENS = "CAST(sum(n) FILTER (kind = 'token_type') AS BIGINT) AS num_tokens"
_PAIR, _OBJECT = "key || '=' || n", """'{"key":"' || key || '","val":' || n || '}'"""

_oracle(
    "file_metric_record", _EVENT_COUNTS,
    f"SELECT {_EVENT_ID} AS id, path, 'events.log' AS filename, dataset, {_NUM_TOKENS}, "
    + ", ".join(
        f"{_entries(kind, _PAIR, ';')} AS {kind}"
        for kind in ("token_text", "token_type", "bigram_text", "bigram_type")
    )
    + " FROM counts GROUP BY dataset, path",
)
_oracle(
    "file_record_parts", _EVENT_COUNTS,
    "SELECT dataset, path, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_pairs FROM counts "
    "WHERE kind = 'bigram_type' GROUP BY dataset, path",
)
_oracle("record_lengths", _EVENTS, "SELECT dataset, path, count(*) AS num_tokens FROM tok GROUP BY ALL")
_oracle(
    "index_documents", _EVENT_COUNTS,
    f"SELECT {_EVENT_ID} AS id, path, 'events.log' AS filename, dataset, {_NUM_TOKENS}, "
    + ", ".join(
        f"'[' || {_entries(kind, _OBJECT, ',')} || ']' AS {kind}" for kind in ("token_text", "token_type", "bigram_text", "bigram_type")
    )
    + " FROM counts GROUP BY dataset, path",
)
_oracle(
    "duplicate_document_ids", _EVENTS,
    "SELECT md5(path) AS id, count(*) AS files FROM tok WHERE token_num = 0 GROUP BY 1 HAVING count(*) > 1",
)
_oracle("dataset_histogram_type", _hist("token_type"), _HIST_SELECT)
_oracle("dataset_histogram_text", _hist("token_text"), _HIST_SELECT)
_oracle("dataset_bigram_histogram", _hist("bigram_text"), _HIST_SELECT)
_oracle("dataset_bigram_type_histogram", _hist("bigram_type"), _HIST_SELECT)
_oracle(
    "event_bigram_histogram", _EVENTS,
    "SELECT dataset, key, count(*) AS count FROM pairs WHERE third IS NOT NULL GROUP BY ALL",
)
_oracle(
    "histogram_without_prefix", _DOCS,
    f"SELECT dataset, {_unk('token_type')} AS key, count(*) AS count FROM tok "
    "WHERE NOT (dataset = 'fr' AND starts_with(split_part(path, '/', 3), '1')) GROUP BY ALL",
)
_LENGTHS = f"""{_DOCS},
lengths AS (SELECT dataset, len(t) AS tokens_count, count(*) AS file_count FROM lex GROUP BY ALL),
logs AS (SELECT dataset, CAST(round_even(log10(tokens_count) * 1000, 0) AS BIGINT) AS bucket,
  CAST(sum(file_count) AS BIGINT) AS file_count FROM lengths GROUP BY ALL),
density AS (SELECT *, file_count / sum(file_count) OVER (PARTITION BY dataset) AS share FROM logs)"""
_oracle("tokens_per_file_histogram", _LENGTHS, "SELECT * FROM lengths")
_oracle("by_file_histogram", _files("token_text"), "SELECT * FROM by_count")
_oracle("by_file_ratio_histogram", _files("token_text"), "SELECT * FROM by_ratio")
_oracle(
    "by_file_pivot", _files("token_type"),
    "SELECT * FROM (PIVOT by_count ON key USING CAST(coalesce(sum(n_files), 0) AS BIGINT) GROUP BY dataset, num)",
)
_oracle(
    "cumulative_shares", _files("token_type"),
    """SELECT dataset, key, num, digits9(sum(n_files) OVER (PARTITION BY dataset, key ORDER BY num)
  / sum(n_files) OVER (PARTITION BY dataset, key)) AS cdf FROM by_ratio""",
)

# ---------------------------------------------------------------- merged tables

_LANGS = ("de", "en", "es", "fr")


def _wide(value: str) -> str:
    return ", ".join(value.format(d=d) + f" AS {d}" for d in _LANGS)


_WIDE_FILLED = _wide("CAST(coalesce(sum(count) FILTER (dataset = '{d}'), 0) AS BIGINT)")
_oracle("merge_outer", _hist("token_text"), f"SELECT key, {_WIDE_FILLED} FROM hist GROUP BY key")
_oracle("metric_csv_merge", _hist("token_text"), f"SELECT key, {_WIDE_FILLED} FROM hist GROUP BY key")
_oracle(
    "merge_min_count", _hist("token_text"),
    f"""SELECT key, {_wide("CAST(sum(count) FILTER (dataset = '{d}') AS BIGINT)")}
FROM hist WHERE count > 5 GROUP BY key""",
)
_oracle(
    "merge_pair_null_keys", f"""{_hist("token_type")},
named AS (SELECT dataset, CASE WHEN regexp_matches(key, '^[A-Z]') THEN key END AS key,
  CAST(sum(count) AS BIGINT) AS count FROM hist GROUP BY ALL)""",
    """SELECT coalesce(l.key, r.key) AS key, l.count AS en, r.count AS de
FROM (SELECT * FROM named WHERE dataset = 'en') l
FULL JOIN (SELECT * FROM named WHERE dataset = 'de') r ON l.key IS NOT DISTINCT FROM r.key""",
)
_oracle(
    "merge_survivors", _hist("token_text"),
    "SELECT dataset, count(*) AS n_keys, count(*) FILTER (count > 5) AS n_kept FROM hist GROUP BY dataset",
)
_oracle("melted", _cells("token_type"), "SELECT key, dataset, CAST(count AS BIGINT) AS count FROM cells")


def _describe(value: str, digits: bool = True) -> str:
    columns = {
        "mean": f"avg({value})", "std": f"stddev_samp({value})", "min": f"min({value})", "max": f"max({value})",
        "q25": f"quantile_cont({value}, 0.25)", "q50": f"quantile_cont({value}, 0.5)",
        "q75": f"quantile_cont({value}, 0.75)",
    }
    whole = () if digits else ("min", "max")
    shown = [f"{sql} AS {n}" if n in whole else f"digits9({sql}) AS {n}" for n, sql in columns.items()]
    return f"count({value}) AS count, " + ", ".join(shown)


_oracle(
    "merged_describe", _cells("token_text"),
    f"SELECT dataset, {_describe('count', digits=False)} FROM cells GROUP BY dataset",
)
_oracle("distinct_keys", _hist("token_type"), "SELECT DISTINCT key FROM hist")
_oracle(
    "missing_keys", _hist("token_text"),
    "SELECT d.dataset, h.key FROM hist h, (SELECT DISTINCT dataset FROM hist WHERE dataset <> 'en') d "
    "WHERE h.dataset = 'en' EXCEPT SELECT dataset, key FROM hist",
)
_oracle(
    "relation_profile", _DOCS,
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct FROM tok"
        for c in ("dataset", "path", "token_text", "token_type")
    ),
)

# ---------------------------------------------------------------- comparison

_GAP = """dataset, count(*) FILTER (count = 0) AS missing,
  digits9(count(*) FILTER (count = 0) / count(*)) AS missing_share,
  digits9(sum(CASE WHEN count = 0 THEN ref_count ELSE 0 END) / max(ref_total)) AS used_share"""
_oracle("vocab_gap", _cells("token_text"), f"SELECT {_GAP} FROM cells GROUP BY dataset")
_oracle(
    "vocab_gap_types", _cells("token_type"),
    f"SELECT {_GAP}, coalesce(string_agg(key, ', ' ORDER BY key) FILTER (count = 0), '') AS tokens "
    "FROM cells GROUP BY dataset",
)
_oracle(
    "absent_keys", _cells("token_text"),
    "SELECT dataset, key, digits9(ref_count / ref_total) AS ref_share FROM cells WHERE count = 0",
)
_oracle(
    "absent_types", _cells("token_type"),
    "SELECT dataset, key, digits9(ref_count / ref_total) AS ref_share FROM cells WHERE count = 0",
)
_oracle(
    "out_of_reference_mass", _cells("bigram_text"),
    "SELECT digits9(round(sum(count / total), 3)) AS mass FROM cells WHERE ref_count = 0 AND dataset <> 'en'",
)
_oracle(
    "max_normalized", _cells("token_type"),
    "SELECT key, dataset, digits9(m) AS norm, digits9(r) AS ref_norm FROM norm",
)
_oracle("pct_diff", _cells("token_text"), "SELECT key, dataset, digits9(diff) AS diff FROM diff")
_oracle(
    "pct_diff_describe", _cells("token_text"),
    f"SELECT dataset, {_describe('abs(diff)')} FROM finite GROUP BY dataset",
)
_SUMMARY = """SELECT dataset, digits9(round(quantile_cont(abs(diff), 0.5) * 100, 1)) AS median,
  digits9(round(avg(abs(diff)) * 100, 1)) AS mean, digits9(round(sum(abs(diff)) * 100, 1)) AS sum FROM finite GROUP BY dataset"""
_oracle("pct_diff_summary", _cells("token_text"), _SUMMARY)
_oracle(
    "pct_diff_summary_means", _cells("token_type"),
    f"""SELECT digits9(avg(median)) AS median, digits9(avg(mean)) AS mean, digits9(avg(sum)) AS sum
FROM ({_SUMMARY.replace("digits9", "")})""",
)
_oracle(
    "pct_diff_box", f"""{_cells("token_text")},
sizes AS (SELECT dataset, abs(diff) AS size FROM finite WHERE diff IS NOT NULL),
q AS (SELECT dataset, quantile_cont(size, 0.25) AS q25, quantile_cont(size, 0.5) AS q50,
  quantile_cont(size, 0.75) AS q75 FROM sizes GROUP BY dataset),
f AS (SELECT s.dataset, size, q25, q50, q75,
  size BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside
  FROM sizes s JOIN q ON q.dataset = s.dataset)""",
    """SELECT dataset, digits9(q25) AS q25, digits9(q50) AS q50, digits9(q75) AS q75,
  digits9(min(size) FILTER (inside)) AS low, digits9(max(size) FILTER (inside)) AS high,
  count(*) FILTER (NOT inside) AS outliers FROM f GROUP BY dataset, q25, q50, q75""",
)


def _topk(k: int) -> str:
    return f"""SELECT dataset, CAST(rank AS INTEGER) AS rank, key, digits9(diff * 100) AS pct FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY abs(diff) DESC, key) AS rank
  FROM finite WHERE diff IS NOT NULL) WHERE rank <= {k}"""


_oracle("pct_diff_topk", _cells("token_text"), _topk(20))
_oracle("pct_diff_topk_bigrams", _cells("bigram_type"), _topk(100))
_SHARES = "SELECT key, dataset, digits9(share) AS share, digits9(ref_share) AS ref_share FROM shares"
_FREQUENT = "(SELECT key FROM shares GROUP BY key HAVING max(share) > 1e-4)"
_oracle("share", _cells("token_text"), _SHARES)
_oracle(
    "reference_frequency", _cells("token_type"),
    "SELECT key, digits9(share) AS share FROM shares WHERE dataset = 'en'",
)
_oracle(
    "share_totals", _cells("bigram_type"),
    "SELECT key, digits9(sum(share)) AS total, digits9(avg(share)) AS mean FROM shares GROUP BY key",
)
_oracle("frequent_shares", _cells("bigram_type"), f"{_SHARES} WHERE key IN {_FREQUENT}")
_oracle("log_ratio", _cells("token_text"), "SELECT key, dataset, digits9(log_ratio) AS log_ratio FROM logs")
_RANGE = "SELECT digits9(min(log_ratio)) AS y_min, digits9(max(log_ratio)) AS y_max FROM logs"
_oracle("log_ratio_range", _cells("token_type"), _RANGE)
_oracle(
    "log_ratio_range_trimmed", f"""{_cells("bigram_type")},
kept AS (SELECT DISTINCT key, ref_share FROM shares WHERE key IN {_FREQUENT}),
ends AS ((SELECT key FROM kept ORDER BY ref_share DESC, key DESC LIMIT 1)
  UNION ALL (SELECT key FROM kept ORDER BY ref_share, key LIMIT 1))""",
    f"{_RANGE} WHERE key IN (SELECT key FROM kept) AND key NOT IN (SELECT key FROM ends)",
)
_DIVERGENCE = """SELECT dataset, digits9(avg(abs(share - ref_share))) AS diff_mean,
  digits9(sum(abs(share - ref_share))) AS diff_sum, digits9(avg(abs(log_ratio))) AS log_diff_mean,
  digits9(sum(abs(log_ratio))) AS log_diff_sum,
  digits9(count(*) FILTER (log_ratio IS NULL) / count(*)) AS missing_share FROM logs {where} GROUP BY dataset"""
_oracle("divergence_table", _cells("token_text"), _DIVERGENCE.format(where=""))
_oracle(
    "divergence_table_bigrams", _cells("bigram_type"), _DIVERGENCE.format(where=f"WHERE key IN {_FREQUENT}")
)
_PRESENT = {d: f"CAST(coalesce(sum(count) FILTER (dataset = '{d}'), 0) > 0 AS INTEGER)" for d in ("de", "es", "fr")}
_oracle(
    "presence_matrix", _hist("token_text"),
    f"""SELECT *, de + es + fr AS total FROM (SELECT key,
  {", ".join(f"{sql} AS {d}" for d, sql in _PRESENT.items())} FROM hist GROUP BY key) WHERE de + es + fr < 3""",
)
_oracle(
    "presence_order", f"""{_hist("token_text")},
flags AS (SELECT {", ".join(f"{sql} AS {d}" for d, sql in _PRESENT.items())} FROM hist GROUP BY key),
sums AS (SELECT unnest(['de', 'es', 'fr']) AS dataset, unnest([sum(de), sum(es), sum(fr)]) AS n FROM flags WHERE de + es + fr < 3)""",
    "SELECT row_number() OVER (ORDER BY n DESC, dataset) - 1 AS place, dataset FROM sums",
)
_oracle(
    "absent_reference_mass", _cells("token_text"),
    """SELECT dataset, digits9(sum(CASE WHEN count = 0 THEN ref_count ELSE 0 END) / max(ref_total) * 100) AS pct
FROM cells WHERE dataset <> 'en' GROUP BY dataset""",
)

# ---------------------------------------------------------------- distances

_oracle(
    "log_length_density", _LENGTHS, "SELECT dataset, bucket, file_count, digits9(share) AS share FROM density"
)


def _kde(source: str, group: str, size: str, variance: str, bounds: str, cut: int, points: int) -> str:
    on = " AND ".join(f"a.{g} = b.{g}" for g in group.split(", "))
    keys = ", ".join(f"a.{g}" for g in group.split(", "))
    return f""", src AS ({source}),
mu AS (SELECT {group}, sum(w * x) / sum(w) AS mean, sum(w) AS w, sum(w * w) AS w2 FROM src GROUP BY {group}),
spread AS (SELECT {keys}, any_value(b.w) AS w, any_value(b.w2) AS w2,
  sum(a.w * (a.x - b.mean) ** 2) AS s, min(a.x) AS own_low, max(a.x) AS own_high
  FROM src a JOIN mu b ON {on} GROUP BY {keys}),
bw AS (SELECT *, CASE WHEN {variance[0]} <> 0 THEN sqrt({variance[1]}) * ({size}) ** (-0.2) END AS h,
  {bounds} FROM spread),
grid AS (SELECT *, unnest(range({points})) AS point FROM bw WHERE h > 0),
pts AS (SELECT *, low - {cut} * h + (high - low + 2 * {cut} * h) / {points - 1} * point AS at FROM grid),
curve AS (SELECT {keys}, CAST(b.point AS INTEGER) AS point, b.at AS x,
  sum(a.w * exp(-0.5 * ((b.at - a.x) / b.h) ** 2)) / (any_value(b.w) * any_value(b.h) * sqrt(2 * pi())) AS density
  FROM src a JOIN pts b ON {on} GROUP BY {keys}, b.point, b.at)"""


_IMPORTANCE = ("w * w / w2", ("1 - w2 / (w * w)", "(s / w) / (1 - w2 / (w * w))"))
_FREQUENCY = ("w", ("w - 1", "s / (w - 1)"))
_ALL_X = "(SELECT min(x) FROM {0}) AS low, (SELECT max(x) FROM {0}) AS high"

_oracle(
    "length_kde",
    _LENGTHS + _kde(
        "SELECT dataset, bucket / 1000.0::DOUBLE AS x, share AS w FROM density", "dataset",
        *_IMPORTANCE, _ALL_X.format("src"), 3, 200,
    ),
    "SELECT dataset, point, digits9(x) AS x, digits9(density) AS density FROM curve",
)


def _tfidf(n_docs: str) -> str:
    return f""",
df AS (SELECT dataset, key, sum(n_files) AS files FROM by_count GROUP BY ALL),
nd AS ({n_docs}),
tfidf AS (SELECT h.dataset, h.key, CAST(round_even(h.num * ln(df.files / nd.n_docs), 0) AS BIGINT) AS num,
  CAST(sum(h.n_files) AS BIGINT) AS n_files FROM by_count h
  JOIN df ON df.dataset = h.dataset AND df.key = h.key JOIN nd ON nd.dataset = h.dataset GROUP BY ALL)"""


_TFIDF = _tfidf("SELECT dataset, max(files) AS n_docs FROM df GROUP BY dataset")
_oracle(
    "key_kde_samples",
    _files("token_type") + _TFIDF + _kde(
        "SELECT dataset, key, num::DOUBLE AS x, n_files::DOUBLE AS w FROM tfidf", "dataset, key",
        *_FREQUENCY, "own_low AS low, own_high AS high", 0, 20,
    ),
    "SELECT dataset, key, point, digits9(x) AS x, digits9(density) AS density FROM curve",
)
_oracle(
    "energy_distance_matrix", f"""{_LENGTHS},
ds AS (SELECT DISTINCT dataset FROM logs), bs AS (SELECT DISTINCT bucket FROM logs),
cdf AS (SELECT d.dataset, s.bucket, sum(coalesce(l.file_count, 0)) OVER (PARTITION BY d.dataset ORDER BY s.bucket)
  / sum(coalesce(l.file_count, 0)) OVER (PARTITION BY d.dataset) AS f,
  lead(s.bucket) OVER (PARTITION BY d.dataset ORDER BY s.bucket) - s.bucket AS gap
  FROM ds d CROSS JOIN bs s LEFT JOIN logs l ON l.dataset = d.dataset AND l.bucket = s.bucket)""",
    """SELECT a.dataset AS dataset_a, b.dataset AS dataset_b,
  digits9(round(sqrt(2 * coalesce(sum((a.f - b.f) ** 2 * (a.gap / 1000)), 0)), 3)) AS distance
FROM cdf a JOIN cdf b ON a.bucket = b.bucket GROUP BY 1, 2""",
)


def _ks(source: str) -> str:
    return f""",
present AS (SELECT DISTINCT key, dataset FROM {source} WHERE dataset <> 'en'),
aligned AS (SELECT p.key, p.dataset, h.num,
  sum(CASE WHEN h.dataset = p.dataset THEN n_files ELSE 0 END) AS a,
  sum(CASE WHEN h.dataset = 'en' THEN n_files ELSE 0 END) AS r
  FROM present p JOIN {source} h ON h.key = p.key AND h.dataset IN (p.dataset, 'en') GROUP BY ALL),
run AS (SELECT *, sum(a) OVER o AS ca, sum(r) OVER o AS cr, sum(a) OVER w AS ta, sum(r) OVER w AS tr FROM aligned
  WINDOW o AS (PARTITION BY key, dataset ORDER BY num), w AS (PARTITION BY key, dataset)),
stat AS (SELECT key, dataset, CAST(max(ta) AS BIGINT) AS n, CAST(max(tr) AS BIGINT) AS n_ref,
  max(abs(ca / ta - cr / tr)) AS statistic FROM run WHERE tr > 0 GROUP BY key, dataset),
lam AS (SELECT *, statistic * sqrt(n::DOUBLE * n_ref / (n + n_ref)) AS z FROM stat),
ks AS (SELECT key, dataset, n, n_ref, statistic, CASE WHEN z < 0.2 THEN 1.0 ELSE least(greatest(
  list_sum(list_transform(range(1, 26), lambda j: 2 * (-1) ** (j - 1) * exp(-2.0 * j * j * z * z))), 0), 1)
  END AS p_value FROM lam)"""


_KS_SELECT = """SELECT key, dataset, n, n_ref, digits9(statistic) AS statistic,
  digits9(CAST(p_value AS DOUBLE)) AS p_value FROM ks"""
_oracle("ks_by_key", _files("token_text") + _ks("by_ratio"), _KS_SELECT)
_oracle("tfidf_ks", _files("token_type") + _TFIDF + _ks("tfidf"), _KS_SELECT)
_oracle(
    "ks_summary", _files("token_type") + _ks("by_ratio"),
    "SELECT dataset, count(*) FILTER (p_value > 0.05) AS p_above, "
    "count(*) FILTER (statistic > 0.05) AS statistic_above FROM ks GROUP BY dataset",
)
_oracle(
    "ks_mean_by_key", _files("token_type") + _ks("by_ratio"),
    "SELECT key, digits9(avg(statistic)) AS avg_statistic FROM ks GROUP BY key",
)
_oracle(
    "ks_describe", _files("token_text") + _ks("by_ratio"),
    f"SELECT dataset, {_describe('statistic')} FROM ks GROUP BY dataset",
)
_oracle(
    "bucket_diff", f"""{_files("token_type")},
w AS (SELECT key, num, coalesce(sum(n_files) FILTER (dataset = 'de'), 0) AS a,
  coalesce(sum(n_files) FILTER (dataset = 'en'), 0) AS r FROM by_ratio WHERE dataset IN ('de', 'en') GROUP BY ALL),
s AS (SELECT key, num, a, r, sum(a) OVER (PARTITION BY key) AS ta, sum(r) OVER (PARTITION BY key) AS tr FROM w)""",
    """SELECT key, num, digits9(CASE WHEN r > 0 THEN (a / ta - r / tr) / (r / tr) ELSE 'inf'::DOUBLE END) AS diff
FROM s WHERE ta > 0 AND tr > 0 AND (a > 0 OR r > 0)""",
)
_TFIDF_SELECT = "SELECT dataset, key, num, n_files FROM tfidf"
_oracle("tfidf_histogram", _files("token_text") + _TFIDF, _TFIDF_SELECT)
_oracle(
    "tfidf_histogram_true_counts",
    _files("token_type") + _tfidf("SELECT dataset, count(*) AS n_docs FROM lex GROUP BY dataset"),
    _TFIDF_SELECT,
)
_oracle(
    "key_density",
    _files("token_type") + _ks("by_ratio") + _kde(
        "SELECT dataset, num / 10000.0::DOUBLE AS x, n_files::DOUBLE AS w FROM by_ratio "
        "WHERE key = '.' AND dataset IN ('de', 'en')",
        "dataset", *_IMPORTANCE,
        "(SELECT min(num) / 10000.0::DOUBLE FROM by_ratio) AS low, "
        "(SELECT max(num) / 10000.0::DOUBLE FROM by_ratio) AS high",
        3, 200,
    ),
    """SELECT c.dataset, point, digits9(x) AS x, digits9(density) AS density, digits9(statistic) AS statistic
FROM curve c LEFT JOIN ks k ON k.dataset = c.dataset AND k.key = '.' WHERE x BETWEEN 0 AND 0.2""",
)

# ---------------------------------------------------------------- storage, quality, re-runs

_GOOD = "CAST(split_part(path, '/', 3) AS BIGINT) NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
_oracle(
    "token_dump_parse", _located(_WORDS_MATCH, _DOCS_SOURCE),
    f"SELECT {_token_columns(_WORDS_TYPE, _NO_CHANNEL)} FROM numbered WHERE {_GOOD}",
)
_oracle(
    "reject_files", "",
    f"SELECT DISTINCT {_DOC_PATH}, 'unparsable' AS reason FROM documents "
    "WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
_oracle(
    "token_csv_round_trip", f"""{_located(_CPP_MATCH, _DOCS_SOURCE)},
shown AS (SELECT dataset, {_shown('raw')} AS token_text FROM numbered)""",
    f"SELECT dataset, {_unk('token_text')} AS key, count(*) AS count FROM shown GROUP BY ALL",
)
_oracle(
    "record_json_round_trip", _EVENTS,
    "SELECT dataset, n AS tokens_count, count(*) AS file_count FROM "
    "(SELECT dataset, path, count(*) AS n FROM tok GROUP BY ALL) GROUP BY ALL",
)
_oracle(
    "record_json_bigrams", _EVENTS,
    "SELECT dataset, key, count(*) AS count FROM pairs WHERE third IS NOT NULL GROUP BY ALL",
)
_oracle(
    "packaged_files", "",
    """SELECT 'lang=' || lang || '/source=' || source AS repo,
  CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size,
  CAST(sum(octet_length(encode(replace(text, chr(13) || chr(10), chr(10)))) + 1) AS BIGINT) AS chars
FROM documents GROUP BY 1""",
)
_RULES = [("not_null", c, f"count(*) FILTER ({c} IS NULL)") for c in (
    "uuid", "dataset", "path", "file_name", "token_num", "char_start", "char_end", "token_text", "token_type",
    "line", "line_char",
)] + [("max_length", c, f"count(*) FILTER (length({c}) > {n})") for c, n in (
    ("uuid", 36), ("dataset", 4), ("file_name", 255), ("token_type", 255),
)] + [("unique", "uuid", "count(uuid) - count(DISTINCT uuid)")]
_oracle(
    "constraint_report", f"""{_located(_WORDS_MATCH, _DOCS_SOURCE)},
full_rows AS (SELECT {_uuid('dataset', 'path', 'token_num')} AS uuid,
  {_token_columns(_WORDS_TYPE, _NO_CHANNEL)} FROM numbered)""",
    " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, '{column}' AS column_name, {sql} AS violations FROM full_rows"
        for rule, column, sql in _RULES
    ),
)
_PATHS = """paths AS (SELECT doc_id, '/corpus/' || lang || '/' || source || '/' || doc_id || '.c' AS src_file,
  '/tokens/' || lang || '/' || source || '/' || doc_id || '.tokens' AS dst_file FROM documents)"""
_oracle("manifest", _PATHS, "SELECT src_file, dst_file FROM paths")
_oracle(
    "pending_files", _PATHS,
    "SELECT src_file, dst_file FROM paths WHERE doc_id NOT IN "
    "(SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1)",
)
_oracle(
    "idempotent_append", _DOCS,
    "SELECT dataset, count(*) AS n_tokens, count(*) FILTER (token_num = 0) AS n_files FROM tok GROUP BY dataset",
)
_oracle(
    "tree_files", "",
    """SELECT lang || '/' || source AS repo, count(*) AS n_files, count(*) FILTER (n_chars % 5 = 0) AS hidden,
  count(*) FILTER (n_chars % 7 = 0 OR text = '') AS empty,
  CAST(sum(CASE WHEN n_chars % 7 = 0 THEN 0 ELSE octet_length(encode(text)) END) AS BIGINT) AS bytes FROM documents GROUP BY 1""",
)
_oracle(
    "tree_tokens", "",
    """SELECT lang || '/' || source AS dataset, count(*) AS n_ends,
  count(*) FILTER (n_chars % 7 = 0 OR NOT regexp_matches(text, '[^ \t\r\n\f]')) AS only_ends FROM documents GROUP BY 1""",
)
_oracle(
    "packaged_chunks", """paths AS (SELECT lang || '/' || source || '/' || doc_id || '.c' AS path FROM documents),
placed AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS position FROM paths)""",
    """SELECT position // 100 AS chunk, min(path) AS first, max(path) AS last, count(*) AS n_files,
  CAST(sum(position) AS BIGINT) AS positions FROM placed GROUP BY 1""",
)
ORACLES["dump_files"] = ORACLES["metric_named_files"] = ORACLES["dataset_histogram_type"]
_oracle("record_count", _EVENTS, "SELECT count(DISTINCT (dataset, path)) AS records, CAST(0 AS BIGINT) AS rejects FROM tok")
ORACLES["manifest_round_trip"] = ORACLES["manifest"]
_oracle(
    "rejects_appended", f"{_PATHS}, marks AS (SELECT doc_id, unnest(['failed', 'timeout']) AS reason, unnest([toxic = 1, quality = 0]) AS hit FROM labels)",
    "SELECT src_file AS path, reason FROM paths JOIN marks USING (doc_id) WHERE hit",
)
_oracle("pending_after_runs", _PATHS, "SELECT src_file, dst_file FROM paths WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
_oracle(
    "committed_outputs", f"""{_DOCS}, sizes AS (SELECT CAST(split_part(path, '/', 3) AS BIGINT) AS doc_id, len(t) AS n FROM lex)""",
    """SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'first' ELSE 'second' END AS run, count(*) AS n_files,
  CAST(sum(n) AS BIGINT) AS n_tokens FROM sizes WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1""",
)
_REPOS = """repos AS (SELECT upper(lang) AS language, source || '/' || doc_id AS full_name,
  n_chars > 1000 AS fork, n_chars AS size, doc_id * 7 % 1000 AS stars FROM documents)"""
_oracle("repo_flatten", _REPOS, "SELECT DISTINCT * FROM repos")
_oracle("repo_csv_round_trip", _REPOS, "SELECT DISTINCT * FROM repos")
_oracle("repo_filter", _REPOS, "SELECT DISTINCT * FROM repos WHERE language = 'FR' AND stars BETWEEN 10 AND 900")
_oracle(
    "path_parts", "rel AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS p FROM pages)",
    """SELECT page_id, array_to_string(p[1:2], '/') AS repo, array_to_string(p[3:], '/') AS path, p[-1] AS name
FROM rel""",
)
_oracle(
    "strict_extensions", "p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages)",
    r"SELECT * FROM p WHERE regexp_matches(path, '\.(com|net)/[^/]+/[0-9]+$')",
)
_oracle(
    "source_extensions", "p AS (SELECT doc_id, lang || '/' || source || '/' || doc_id || ['.c', '.cpp', '.css', '.cc'][n_chars % 4 + 1] AS path FROM documents)",
    "SELECT * FROM p WHERE ends_with(path, '.c') OR ends_with(path, '.cpp')",
)
_oracle(
    "unknown_fill", "",
    """SELECT CASE WHEN lang IN ('es', 'fr') THEN '<<UNK>>' ELSE lang END AS compatible,
  CASE lang WHEN 'es' THEN '<<UNK>>' WHEN 'fr' THEN 'NA' ELSE lang END AS strict, count(*) AS n
FROM documents GROUP BY 1, 2""",
)
