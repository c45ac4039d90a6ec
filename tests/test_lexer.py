"""The C++ lexer against hand-made cases and against a brute-force longest-match lexer."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from glyphstat.functions.lexing import CPP14, CPP_KEYWORDS, CPP_OPERATORS, CPP_SINGLE, WORDS
from glyphstat.operators import counts
from glyphstat.operators import tokenize as lexer
from glyphstat.operators.counts import document_lengths
from glyphstat.operators.tokenize import (
    document_pairs,
    document_tokens,
    flag_oversized,
    rejected_documents,
    text_parts,
    tokenize,
    tokenize_parts,
    unrecognized,
)


def docs(spark, texts):
    rows = [("D", f"{i:05d}", text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "dataset string, path string, text string")


def lexed(spark, texts, profile=CPP14):
    rows = tokenize(docs(spark, texts), profile).orderBy("path", "token_num").collect()
    result = [[] for _ in texts]
    for row in rows:
        result[int(row["path"])].append(row)
    return result


# ------------------------------------------------------------ brute force
# One pattern per rule, in the order that breaks ties between equally long matches.

HEX = "[0-9a-fA-F]"
UCN = rf"\\u{HEX}{{4}}|\\U{HEX}{{8}}"
IDENT = rf"(?:[A-Za-z_]|{UCN})(?:[A-Za-z_0-9]|{UCN})*"
ESC = rf"\\['\"?\\abfnrtv]|\\\r\n?|\\\n|\\[0-7]{{1,3}}|\\x{HEX}+"
DIGITS = r"[0-9](?:'?[0-9])*"
INT_CORE = rf"(?:[1-9](?:'?[0-9])*|0(?:'?[0-7])*|0[xX]{HEX}(?:'?{HEX})*|0[bB][01](?:'?[01])*)"
INT_END = r"(?:[uU](?:ll|LL|[lL])?|(?:ll|LL|[lL])[uU]?)?"
FRACTION = rf"(?:(?:{DIGITS})?\.{DIGITS}|{DIGITS}\.)"
EXPONENT = rf"[eE][+-]?{DIGITS}"
FLOAT_CORE = rf"(?:{FRACTION}(?:{EXPONENT})?|{DIGITS}{EXPONENT})"
CHAR = rf"[uUL]?'(?:[^'\\\r\n]|{ESC}|{UCN})+'"
RAW = r'"[^\r\n(]*\([^\r\n)]*\)[^\r\n"]*"'
STRING = rf'(?:(?:u8|[uUL])?"(?:[^"\\\r\n]|{ESC}|{UCN})*"|(?:u8|[uUL])?R{RAW})'
RULES = [
    ("IntegerLiteral", INT_CORE + INT_END),
    ("CharacterLiteral", CHAR),
    ("FloatingLiteral", FLOAT_CORE + "[flFL]?"),
    ("StringLiteral", STRING),
    ("BooleanLiteral", "false|true"),
    ("PointerLiteral", "nullptr"),
    ("UserDefinedLiteral", rf"(?:{INT_CORE}|{FLOAT_CORE}|{STRING}|{CHAR}){IDENT}"),
    ("MultiLineMacro", r"#(?:[^\n]*?\\\r?\n)+[^\n]+"),
    ("Directive", r"#[^\n]*"),
    *[(word, word) for word in CPP_KEYWORDS],
    ("Not", "!|not"), ("AndAnd", "&&|and"), ("OrOr", r"\|\||or"),
    *[(op, regex.escape(op)) for op in [*CPP_OPERATORS, *CPP_SINGLE] if op not in ("!", "&&", "||")],
    ("Identifier", IDENT),
    ("skip", r"[ \t]+|\r\n?|\n|/\*(?s:(?:(?!\*/).)*)\*/|//[^\r\n]*"),
]
COMPILED = [(name, regex.compile(pattern)) for name, pattern in RULES]


def brute_force(text):
    tokens, at = [], 0
    while at < len(text):
        best, viable = None, 0
        for end in range(at + 1, len(text) + 1):
            piece = text[at:end]
            alive = False
            for name, pattern in COMPILED:
                match = pattern.fullmatch(piece, partial=True)
                if match is None:
                    continue
                alive = True
                if not match.partial and (best is None or end > best[0]):
                    best = (end, name)
            if not alive:
                break
            viable = end
        if best:
            if best[1] != "skip":
                tokens.append((at, text[at : best[0]], best[1]))
            at = best[0]
        else:
            # The viable prefix and the character that ended it are lost.
            at = max(viable, at) + 1
    return tokens


def _shown(text):
    return text.replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def check(spark, texts):
    for text, rows in zip(texts, lexed(spark, texts), strict=True):
        expected = brute_force(text)
        got = [(r["char_start"], r["token_text"], r["token_type"]) for r in rows[:-1]]
        assert got == [(at, _shown(raw), name) for at, raw, name in expected], text
        for row, (at, raw, _) in zip(rows, expected, strict=False):
            before = text[:at]
            assert row["char_end"] == at + len(raw) - 1
            assert row["line"] == 1 + before.count("\n"), text
            assert row["line_char"] == at - (before.rfind("\n") + 1), text
            assert row["channel"] == (1 if raw.startswith("#") else None)
        last = rows[-1]
        assert (last["token_text"], last["token_type"]) == ("<EOF>", "EOF")
        assert (last["char_start"], last["char_end"]) == (len(text), len(text) - 1)
        assert [r["token_num"] for r in rows] == list(range(len(rows)))


def test_ties_and_longest_matches(spark):
    check(
        spark,
        [
            "10 10u 10ull 10lul 10foo 0 00 09 08.5 08e1 0x1F 0xZZ 0x 0b101 0b12 0b1'12 10'000u 1''0 1'a'",
            "1. .5 1..2 1.f 1.foo 1e5 1e5f 1e5fx 1e+5 1e+ 1e 0x1.8p3 0x1e+5 1.5e+ 0b1e5 0'7 1_000",
            "true false nullptr trueish LL u8 and or not bitand int interior _int",
            "<<= >>= << >> <= >= < -> ->* --> ... .. .* . :: ::: ++ +++ += && &&& &= || |= != ! == ===",
            '"a" "a"foo u8"z" L\'a\' u8\'a\' R"x(abc)x" R"(a"b)" LR"(q)"_s R"no" "\\x41" "\\u00e9" "\\777" "a\'b" \'"\'',
            '"open\nint x; "\\d+" \'\' \'\\q\' "\\u12" \'ab',
            "#define A 1\n#define B \\\n  2 \\\n  3\nint c;\n#if X \\\n\nx #",
            "#a \\\r\n b\r\nc // note \\\nd /* e \n f */ g /* open",
            "\\u00e9x a\\u00e9 \\u12 \\n \\ @ $ ` é int\x0cx",
            "", " ", "a", "a b", "// only", "x\n", "\n\n  x",
        ],
    )


def test_random_texts(spark):
    rng = random.Random(7)
    pieces = list("01789.eExXbBuUlLfRp'\"\\#/*<>=&|+-:;!_ \n\r\t(){}@é") + [
        "\\\n", "//", "/*", "*/", "u8", "0x", "0b", "1e", "\\u00e9", "\\x4", 'R"(', ')"', "int", "not", "true", "...",
    ]
    check(spark, ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(300)])


def test_long_literals_do_not_overflow_the_stack(spark):
    texts = [
        '"' + "x" * 50_000 + '"', '"' + "\\n" * 20_000 + '"', "#" + "a\\\n" * 20_000 + "b",
        "/*" + "y" * 50_000 + "*/", "1" + "'1" * 20_000, "a" * 50_000, "//" + "z" * 50_000, '"' + "\\n" * 20_000,
        "'" + "\\n" * 20_000 + "'", "0x" + "'f" * 20_000, "0x1" + "'f" * 20_000, "\\u00e9" * 10_000, " \n" * 40_000,
    ]
    n = {int(r["path"]): r["num_tokens"] for r in document_lengths(docs(spark, texts), CPP14).collect()}
    assert [n[i] for i in (0, 1, 2, 4, 5, 8, 10, 11)] == [2] * 8
    assert [n[i] for i in (3, 6, 7, 12)] == [1] * 4


def test_fixture_values(spark):
    """One small program whose counts are known from an independent computation."""
    text = (
        "int main(int argc, char *argv[])\n{\n  char buf[10];\n\n\n\n  buf[4105] = 'A';\n\n\n  return 0;\n}\n"
    )
    tokens = document_tokens(docs(spark, [text]), CPP14)
    types = {r["token_type"]: r["count"] for r in tokens.groupBy("token_type").count().collect()}
    texts = {r["token_text"]: r["count"] for r in tokens.groupBy("token_text").count().collect()}
    assert sum(types.values()) == 31 and len(types) == 17 and len(texts) == 22
    assert types["Identifier"] == 5 and types["char"] == types["int"] == 2
    assert types[";"] == types["["] == types["]"] == types["IntegerLiteral"] == 3
    pairs = document_pairs(docs(spark, [text]), CPP14)
    assert pairs.count() == 29
    by_type = {(r[0], r[1]): r["count"] for r in pairs.groupBy("left_type", "right_type").count().collect()}
    assert len(by_type) == 24 and ("}", "EOF") not in by_type
    assert by_type["Identifier", "["] == 3 and by_type["int", "Identifier"] == 2
    assert by_type["[", "IntegerLiteral"] == by_type["IntegerLiteral", "]"] == 2
    assert pairs.select("left_text", "right_text").distinct().count() == 28


def test_words(spark):
    (rows,) = lexed(spark, ["Été à 3.14, x<<=2 l’eau\n\tnaïve_2 10%"], WORDS)
    assert [r["token_text"] for r in rows] == [
        "Été", "à", "3.14", ",", "x", "<<=", "2", "l", "’", "eau", "naïve_2", "10", "%", "<EOF>",
    ]
    assert [r["token_type"] for r in rows][:4] == ["Identifier", "Identifier", "FloatingLiteral", ","]
    assert (rows[10]["line"], rows[10]["line_char"]) == (2, 1)


def test_unrecognized_and_size_split(spark):
    frame = docs(spark, ["int x;", "@ y $", "// @\n"])
    lost = {r["path"]: r["lost_chars"] for r in unrecognized(frame, CPP14).collect()}
    assert lost == {"00001": 2}
    assert [r["oversized"] for r in flag_oversized(frame, 5).orderBy("path").collect()] == [True, False, False]
    more = frame.unionByName(frame.limit(1).withColumns({"path": F.lit("null"), "text": F.lit(None).cast("string")}))
    rejects = {tuple(r) for r in rejected_documents(more, 5).collect()}
    assert rejects == {("00000", "oversized"), ("null", "unreadable")}


def words_by_hand(text):
    """The tokens of ``words``, read character by character."""
    letter = lambda c: c == "_" or unicodedata.category(c)[0] == "L"
    digit = lambda c: c in "0123456789"
    found, i = [], 0
    while i < len(text):
        j = i + 1
        if text[i] in " \t\r\n\f":
            i += 1
            continue
        if letter(text[i]):
            while j < len(text) and (letter(text[j]) or unicodedata.category(text[j]) in ("Mn", "Mc", "Me", "Nd")):
                j += 1
        elif digit(text[i]):
            while j < len(text) and digit(text[j]):
                j += 1
            if j + 1 < len(text) and text[j] == "." and digit(text[j + 1]):
                j += 2
                while j < len(text) and digit(text[j]):
                    j += 1
        else:
            two = text[i] in "-+*/%^&|=!<>" and text[i + 1 : i + 2] == "="
            j = i + (3 if text[i : i + 3] in ("<<=", ">>=") else 2 if two else 1)
        found.append(text[i:j])
        i = j
    return found


def test_words_match_reading_by_hand(spark):
    rng = random.Random(12)
    pieces = ["été", "straße", "niño", "the", "x", "12", "3.14", ".", ",", "<<=", "->*", "::", "'", "\"", " ", "\n", "\t", "_", "%", "…", "日本"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for text, rows in zip(texts, lexed(spark, texts, WORDS), strict=True):
        assert [r["token_text"] for r in rows] == [*words_by_hand(text), "<EOF>"], text


def test_parts_are_lexed_as_the_whole(spark):
    rng = random.Random(8)
    bits = (
        "/* */ / * // \\ \" ' # *= /= R\"( )\" x a1 12.5 /**/ /*/ u8\"é\" ^ \"a\\\nb\"".split(" ")
        + ["\n"] * 4 + ["\r\n", "\\\n", "\\\r\n", " ", "  ", "\t", "\f", "#define x"]
    )
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 70))) for _ in range(300)] + [None, "", "\n", "/*\n" * 5, "/*\n" * 5 + "*/"]
    docs = spark.createDataFrame([("d", f"p{i}", t) for i, t in enumerate(texts)], "dataset string, path string, text string")
    for profile in (CPP14, WORDS):
        whole = sorted(map(str, tokenize(docs, profile).collect()))
        for chars in (1, 9, 1_000):
            assert sorted(map(str, tokenize_parts(docs, profile, chars).collect())) == whole, (profile.name, chars)


def test_one_long_text_is_lexed_in_many_parts(spark):
    text = "".join(f"word{i} /* a\nb */ x = \"s{i}\"; // {i}\n" for i in range(30_000))
    docs = spark.createDataFrame([("d", "long", text)], "dataset string, path string, text string")
    assert text_parts(docs, CPP14, 50_000).count() > 10
    parts, whole = tokenize_parts(docs, CPP14, 50_000), tokenize(docs, CPP14)
    assert parts.count() == whole.count() and parts.exceptAll(whole).isEmpty()


def test_parts_store_texts_and_no_tokens(spark, monkeypatch):
    stored, kept = [], lexer.materialize
    monkeypatch.setattr(lexer, "materialize", lambda df, name: stored.append(df.columns) or kept(df, name))
    frame = spark.createDataFrame([("D", "a.c", "a b\n/* c\nd */ e\n" * 5)], "dataset string, path string, text string")
    for profile in (WORDS, CPP14):
        parts = lexer.tokenize_parts(frame, profile, 6)
        assert sorted(map(tuple, parts.collect()), key=repr) == sorted(map(tuple, lexer.tokenize(frame, profile).collect()), key=repr)
    assert stored and not any({"found", "t"} & set(columns) for columns in stored)


def test_positions_are_found_in_slices():
    half = lexer._SLICE // 2
    assert lexer._slices(np.full(4, half)) == [(0, 2), (2, 4)] and lexer._slices(np.array([], int)) == [(0, 0)]
    sizes = [pa.array([[1] * half, [2] * half, [3, 1]]), pa.array([[1] * half, [1] * half, [1, 1]]), pa.array([[half], [2 * half], [4]])]
    found = lexer._positions.func(*sizes)
    assert found.field("char_start").to_pylist() == [list(range(half)), list(range(1, 2 * half, 2)), [2, 3]]
    assert found.field("line").to_pylist()[2] == [1, 1]


def test_a_type_is_found_once(spark):
    frame = spark.createDataFrame([("D", "a.c", "a 1 nan")], "dataset string, path string, text string")
    made = counts.listed_keys(frame, WORDS, "token_type")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("FloatingLiteral") == 1
    assert made.first()["keys"] == ["Identifier", "IntegerLiteral", "Identifier", "EOF"]
