"""Documents to tokens.

Documents are rows ``(dataset, path, text)``. ``tokenize`` and the functions for counting are narrow transformations: a
document's lexemes are one array, so numbering, pairing and positions need no shuffle. ``tokenize_parts`` gives the same
table where single documents are too long for a task.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphstat.functions.lexing import EOF_TEXT, Profile
from glyphstat.functions.text import base_name, escape_dump, token_uuid
from glyphstat.sources.scratch import materialize


def found_tokens(text: Column, profile: Profile) -> Column:
    """All tokens of a text in order, without the end-of-file token."""
    return F.array_remove(F.regexp_extract_all(text, F.lit(profile.pattern), F.lit(1)), "")


def n_tokens(found: Column) -> Column:
    """Number of tokens with the end-of-file token."""
    return (F.size(found) + 1).cast("bigint")


def shown(raw: Column, profile: Profile) -> Column:
    """A lexeme as token tables hold it."""
    return escape_dump(raw) if profile.multiline else raw


def listed_tokens(docs: DataFrame, profile: Profile) -> DataFrame:
    listed = docs.filter(F.col("text").isNotNull()).select(
        "dataset", "path", found_tokens(F.col("text"), profile).alias("found")
    )
    return listed.withColumn("num_tokens", n_tokens(F.col("found")))


def with_eof() -> Column:
    # Appended inside the generator: exploding a plain column would make the optimizer add a filter
    # on its size, which runs the lexer a second time.
    return F.concat("found", F.array(F.lit(EOF_TEXT)))


def document_tokens(docs: DataFrame, profile: Profile) -> DataFrame:
    """(dataset, path, num_tokens, token_num, token_text, token_type): what counting needs."""
    rows = listed_tokens(docs, profile).select(
        "dataset", "path", "num_tokens", F.posexplode(with_eof()).alias("token_num", "raw")
    )
    return rows.select(
        "dataset", "path", "num_tokens", "token_num",
        shown(F.col("raw"), profile).alias("token_text"),
        profile.classify(F.col("raw")).alias("token_type"),
    )


def document_pairs(docs: DataFrame, profile: Profile, all_pairs: bool = False) -> DataFrame:
    """Adjacent tokens of every document: (dataset, path, num_tokens, left/right text and type).

    The pair that ends in the last token is left out unless ``all_pairs`` is set.
    """
    n = F.greatest(F.size("found") - (0 if all_pairs else 1), F.lit(0))
    pairs = listed_tokens(docs, profile).select(
        "dataset", "path", "num_tokens",
        F.explode(
            F.arrays_zip(
                F.slice("found", F.lit(1), n).alias("l"), F.slice(with_eof(), F.lit(2), n).alias("r")
            )
        ).alias("p"),
    )
    return pairs.select(
        "dataset", "path", "num_tokens",
        shown(F.col("p.l"), profile).alias("left_text"), shown(F.col("p.r"), profile).alias("right_text"),
        profile.classify(F.col("p.l")).alias("left_type"),
        profile.classify(F.col("p.r")).alias("right_type"),
    )


_INTS = T.ArrayType(T.IntegerType())
_POSITIONS = T.StructType([T.StructField(n, _INTS) for n in ("char_start", "line", "line_char")])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists in a row, and where each list begins in them."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(n)])


# Matches whose positions are found at a time; a document's matches stay together.
_SLICE = 1 << 18


def _slices(n: np.ndarray) -> list[tuple[int, int]]:
    """Runs of documents, from and to, that begin in the same ``_SLICE`` of all matches; ``n`` are the matches of each."""
    if not len(n):
        return [(0, 0)]
    at = (np.cumsum(n) - n) // _SLICE
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(n)]
    return list(zip(edges, edges[1:]))


def _slice_positions(match_size: pa.Array, token_size: pa.Array, line_size: pa.Array) -> list[pa.Array]:
    matches, bounds = _flat(match_size)
    tokens, _ = _flat(token_size)
    lines, line_bounds = _flat(line_size)
    doc = np.repeat(np.arange(len(match_size)), np.diff(bounds))
    upto = np.concatenate([[0], np.cumsum(matches)])
    start = upto[1:] - upto[bounds[doc]] - tokens
    line_doc = np.repeat(np.arange(len(line_size)), np.diff(line_bounds))
    line_upto = np.concatenate([[0], np.cumsum(lines + 1)])
    line_start = line_upto[:-1] - line_upto[line_bounds[line_doc]]
    # One search for all documents: starts of lines and of tokens are shifted by their document.
    far = np.int64(1) << 32
    line = np.searchsorted(line_doc * far + line_start, doc * far + start, side="right")
    return [pa.array(c.astype(np.int32)) for c in (start, line - line_bounds[doc], start - line_start[line - 1])]


@F.arrow_udf(_POSITIONS)
def _positions(match_size: pa.Array, token_size: pa.Array, line_size: pa.Array) -> pa.Array:
    """Running sums over each document's matches and lines, many documents of a batch at once; only lengths come here."""
    n = match_size.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    parts = [_slice_positions(*(a.slice(first, end - first) for a in (match_size, token_size, line_size))) for first, end in _slices(n)]
    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.concat_arrays(column)) for column in zip(*parts)]
    return pa.StructArray.from_arrays(lists, [f.name for f in _POSITIONS])


def _matched(docs: DataFrame, profile: Profile, *columns: str) -> DataFrame:
    """Lengths ``w`` of matches, their tokens ``t`` and positions ``p`` of every text; the matches tile it, a token ends its match."""
    pattern, text = F.lit(profile.pattern), F.col("text")
    matches = docs.filter(text.isNotNull()).select(
        *columns, F.length(text).alias("size"),
        F.transform(F.split(text, "\n"), F.length).alias("lines"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("w"),
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("t"),
    )
    return matches.select("*", _positions("w", F.transform("t", F.length), "lines").alias("p"))


def _token_parts(raw: Column, start: Column, line: Column, line_char: Column, profile: Profile) -> list[Column]:
    """What the table has of a token besides its file and number."""
    width = F.when(raw == EOF_TEXT, 0).otherwise(F.length(raw))
    return [
        start.alias("char_start"), (start + width - 1).alias("char_end"), shown(raw, profile).alias("token_text"), profile.classify(raw).alias("token_type"),
        profile.channel(raw).alias("channel"), line.alias("line"), line_char.alias("line_char"),
    ]


def _placed() -> Column:
    """The tokens of a row of ``_matched``, as found, with their positions."""
    zipped = F.arrays_zip(
        F.col("t").alias("raw"), F.col("p.char_start").alias("start"),
        F.col("p.line").alias("line"), F.col("p.line_char").alias("line_char"),
    )
    return F.filter(zipped, lambda m: m["raw"] != "")


def _placed_and_eof() -> Column:
    eof = F.struct(
        F.lit(EOF_TEXT).alias("raw"), F.col("size").alias("start"), F.size("lines").alias("line"), F.element_at("lines", -1).alias("line_char"),
    )
    return F.concat(_placed(), F.array(eof))


def _exploded(rows: DataFrame, placed: Column, number: str, profile: Profile, *columns: str) -> DataFrame:
    """``columns``, the number and what the table has of every token. Lambdas are interpreted, so texts are classified after the explosion, in compiled code."""
    found = rows.select(*columns, F.posexplode(placed).alias(number, "m")).select(*columns, number, "m.*")
    return found.select(*columns, number, *_token_parts(*(F.col(c) for c in ("raw", "start", "line", "line_char")), profile))


def _token_columns(rows: DataFrame) -> DataFrame:
    """The token table from files, numbers and the columns of ``_token``."""
    return rows.select(
        token_uuid(F.col("dataset"), F.col("path"), F.col("token_num")).alias("uuid"),
        "dataset", "path", base_name(F.col("path")).alias("file_name"), "token_num",
        "char_start", "char_end", "token_text", "token_type", "channel", "line", "line_char",
    )


def tokenize(docs: DataFrame, profile: Profile) -> DataFrame:
    """The full token table, with character span, line and column of every token."""
    return _token_columns(_exploded(_matched(docs, profile, "dataset", "path"), _placed_and_eof(), "token_num", profile, "dataset", "path"))


# Characters of a part, at least; a part ends at the next safe place.
PART_CHARS = 1_000_000


def text_parts(docs: DataFrame, profile: Profile, part_chars: int = PART_CHARS) -> DataFrame:
    """``(dataset, path, part, text)``: every text cut at places that no token spans.

    One pattern tiles the text in a single pass. Parts are dealt out by their number, so a very long text
    is lexed in many tasks. Some languages have comments that span any such place (``profile.comment``); whether a part
    begins inside one follows from what its predecessors leave open. A part then gets the opening mark in front,
    or the closing one behind, and ``lead`` tells how many characters were put in front.
    """
    cut = F.regexp_extract_all("text", F.lit(profile.part_pattern(part_chars)), F.lit(0))
    filled = F.when(F.size(cut) == 0, F.array(F.lit(""))).otherwise(cut)
    parts = docs.filter(F.col("text").isNotNull()).select("dataset", "path", F.posexplode(filled).alias("part", "text"))
    parts = parts.repartition("dataset", "path", "part")
    if not profile.comment:
        return parts.withColumn("lead", F.lit(0))
    opens, closes = profile.comment
    parts = materialize(parts, "parts")

    def left_open(text: Column) -> Column:
        """Whether a comment that begins in the text has no end there: its mark is lexed as two tokens next to one another."""
        w = F.regexp_extract_all(text, F.lit(profile.pattern), F.lit(0))
        t = F.regexp_extract_all(text, F.lit(profile.pattern), F.lit(1))
        marks = F.zip_with(t, F.slice(w, F.lit(2), F.size(w)), lambda a, b: (a == opens[0]) & b.startswith(opens[1:]))
        return F.when(text.contains(opens), F.exists(marks, lambda x: F.coalesce(x, F.lit(False)))).otherwise(F.lit(False))

    text = F.col("text")
    probed = parts.select(
        "dataset", "path", "part", text.contains(closes).alias("closes"), left_open(text).alias("from_code"),
        F.when(text.contains(closes), left_open(F.concat(F.lit(opens), text))).otherwise(F.lit(True)).alias("from_comment"),
    )
    chain = F.array_sort(F.collect_list(F.struct("part", "closes", "from_code", "from_comment")))
    listed = probed.groupBy("dataset", "path").agg(chain.alias("c"), F.max(F.when(F.col("closes"), F.col("part"))).alias("last_close"))
    none = F.array().cast("array<struct<part:int,inside:boolean,open:boolean>>")

    def step(state: Column, c: Column) -> Column:
        opened = F.when(state["open"], c["from_comment"]).otherwise(c["from_code"]) & F.coalesce(F.col("last_close") > c["part"], F.lit(False))
        row = F.struct(c["part"].alias("part"), state["open"].alias("inside"), opened.alias("open"))
        return F.struct(opened.alias("open"), F.concat(state["rows"], F.array(row)).alias("rows"))

    states = F.aggregate("c", F.struct(F.lit(False).alias("open"), none.alias("rows")), step, lambda s: s["rows"])
    states = listed.select(F.col("dataset").alias("_d"), F.col("path").alias("_p"), F.inline(states)).withColumnRenamed("part", "_part")
    same = F.col("dataset").eqNullSafe(F.col("_d")) & F.col("path").eqNullSafe(F.col("_p")) & (F.col("part") == F.col("_part"))
    return parts.join(states, same).select(
        "dataset", "path", "part",
        F.concat(F.when(F.col("inside"), opens).otherwise(""), text, F.when(F.col("open"), closes).otherwise("")).alias("text"),
        F.when(F.col("inside"), len(opens)).otherwise(0).alias("lead"), F.when(F.col("open"), len(closes)).otherwise(0).alias("trail"),
    )


def tokenize_parts(docs: DataFrame, profile: Profile, part_chars: int = PART_CHARS) -> DataFrame:
    """As ``tokenize`` for documents of any length: parts are lexed in tasks of their own.

    A part's tokens are numbered and placed from its own beginning; running totals over the parts of a document,
    a row of a few numbers each, move them to their place. Several rows of one path are not told apart.
    """
    parts = text_parts(docs, profile, part_chars)
    if "trail" not in parts.columns:
        parts = parts.withColumn("trail", F.lit(0))
    # Texts are stored and lexed twice, first to count: tokens with their positions take many times the room.
    parts = materialize(parts, "text-parts")
    lines = F.split("text", "\n")
    # What a part adds: characters, line breaks, the characters after its last one, tokens.
    sums = materialize(parts.select(
        "dataset", "path", "part", (F.length("text") - F.col("lead") - F.col("trail")).alias("chars"), (F.size(lines) - 1).alias("breaks"),
        (F.length(F.element_at(lines, -1)) - F.col("trail")).alias("tail"), F.size(found_tokens(F.col("text"), profile)).alias("tokens"),
    ), "part-sums")
    chain = F.array_sort(F.collect_list(F.struct("part", "chars", "breaks", "tail", "tokens"))).alias("c")
    names = ["chars0", "breaks0", "column0", "tokens0"]
    none = F.array().cast(f"array<struct<part:int,{','.join(f'{n}:int' for n in names)}>>")
    zero = F.struct(*(F.lit(0).alias(n) for n in names), none.alias("rows"))

    def step(s: Column, c: Column) -> Column:
        row = F.struct(c["part"].alias("part"), *(s[n].alias(n) for n in names))
        column = F.when(c["breaks"] > 0, c["tail"]).otherwise(s["column0"] + c["chars"])
        return F.struct(
            (s["chars0"] + c["chars"]).alias("chars0"), (s["breaks0"] + c["breaks"]).alias("breaks0"), column.alias("column0"),
            (s["tokens0"] + c["tokens"]).alias("tokens0"), F.concat(s["rows"], F.array(row)).alias("rows"),
        )

    totals = sums.groupBy("dataset", "path").agg(chain).withColumn("s", F.aggregate("c", zero, step))
    eof = _token_parts(F.lit(EOF_TEXT), F.col("s.chars0"), F.col("s.breaks0") + 1, F.col("s.column0"), profile)
    ends = totals.select("dataset", "path", F.col("s.tokens0").alias("token_num"), *eof)
    before = totals.select(F.col("dataset").alias("_d"), F.col("path").alias("_p"), F.inline("s.rows")).withColumnRenamed("part", "_part")
    same = F.col("dataset").eqNullSafe(F.col("_d")) & F.col("path").eqNullSafe(F.col("_p")) & (F.col("part") == F.col("_part"))
    kept = ("dataset", "path", "lead", *names)
    rows = _exploded(_matched(parts.join(before, same), profile, *kept), _placed(), "i", profile, *kept)
    first = F.col("line") == 1
    moved = F.col("chars0") - F.col("lead")
    placed = rows.select(
        "dataset", "path", (F.col("tokens0") + F.col("i")).alias("token_num"), (F.col("char_start") + moved).alias("char_start"),
        (F.col("char_end") + moved).alias("char_end"), "token_text", "token_type", "channel", (F.col("breaks0") + F.col("line")).alias("line"),
        (F.col("line_char") + F.when(first, F.col("column0") - F.col("lead")).otherwise(0)).alias("line_char"),
    )
    return _token_columns(placed.unionByName(ends))


def unrecognized(docs: DataFrame, profile: Profile) -> DataFrame:
    """Characters per document that belong to no token, a quality measure of the profile."""
    pattern = F.lit(profile.pattern)
    text = F.col("text")
    pieces = docs.select(
        "dataset", "path",
        F.explode(
            F.arrays_zip(
                F.regexp_extract_all(text, pattern, F.lit(0)).alias("w"),
                F.regexp_extract_all(text, pattern, F.lit(1)).alias("t"),
            )
        ).alias("m"),
    )
    lost = F.regexp_replace("m.w", r"^(?:[ \t\r\n\f]++|//[^\r\n]*+|/\*(?s:.*?)\*/)*+", "")
    return (
        pieces.filter(F.col("m.t") == "")
        .groupBy("dataset", "path")
        .agg(F.sum(F.length(lost)).alias("lost_chars"))
        .filter(F.col("lost_chars") > 0)
    )


def _dump_line(of: Callable[[str], Column]) -> Column:
    """The dump line of a token, whose columns ``of`` gives by name."""
    quoted = F.when(
        of("token_type") == of("token_text"), F.concat(F.lit("'"), of("token_type"), F.lit("'")),
    ).otherwise(of("token_type"))
    channel = F.when(
        of("channel").isNotNull(), F.concat(F.lit("channel="), of("channel"), F.lit(","))
    ).otherwise("")
    return F.concat(
        F.lit("[@"), of("token_num"), F.lit(","), of("char_start"), F.lit(":"), of("char_end"), F.lit("='"),
        of("token_text"), F.lit("',<"), quoted, F.lit(">,"), channel, of("line"), F.lit(":"), of("line_char"),
        F.lit("]"),
    )


def render_dump(tokens: DataFrame) -> DataFrame:
    """The token table as dump lines, the inverse of parsing them."""
    return tokens.select("dataset", "path", "token_num", _dump_line(F.col).alias("value"))


def render_files(docs: DataFrame, profile: Profile) -> DataFrame:
    """(path, content): the dump lines of every path in one text, in the order of their numbers.

    A document's lines are made and joined inside its row. Only the documents of a path that others have too meet.
    """
    docs = docs.filter(F.col("text").isNotNull())
    shared = materialize(docs.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("path"), "shared-paths")

    def dumped(chosen: DataFrame) -> DataFrame:
        tokens = F.transform(_placed_and_eof(), lambda m: F.struct(*_token_parts(*(m[c] for c in ("raw", "start", "line", "line_char")), profile)))
        lines = F.transform(tokens, lambda t, i: F.struct(i.alias("token_num"), _dump_line(lambda name: i if name == "token_num" else t[name]).alias("value")))
        return _matched(chosen, profile, "path").select("path", lines.alias("lines"))

    def joined(lines: Column) -> Column:
        return F.array_join(F.transform(lines, lambda x: x["value"]), "\n").alias("content")

    once = dumped(docs.join(shared, "path", "left_anti")).select("path", joined(F.col("lines")))
    met = dumped(docs.join(shared, "path", "left_semi")).groupBy("path").agg(F.flatten(F.collect_list("lines")).alias("lines"))
    return once.unionByName(met.select("path", joined(F.array_sort("lines"))))


def flag_oversized(docs: DataFrame, max_chars: int) -> DataFrame:
    """Documents with ``oversized``, whether they are longer than ``max_chars``; none is left out."""
    return docs.withColumn("oversized", F.coalesce(F.length("text") > max_chars, F.lit(False)))


def rejected_documents(docs: DataFrame, max_chars: int) -> DataFrame:
    """(path, reason) of documents that cannot be lexed (no text) or are longer than ``max_chars``."""
    reason = F.when(F.col("text").isNull(), "unreadable").when(F.col("oversized"), "oversized")
    return flag_oversized(docs, max_chars).select("path", reason.alias("reason")).filter("reason IS NOT NULL")
