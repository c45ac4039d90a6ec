"""Lexer profiles: one regular expression per language and a type for each lexeme.

A profile's pattern matches a run of skipped text and then either a token (group 1), something
that is no token, or the end of the text. Extracting group 1 therefore yields the tokens in order
with empty strings for everything else, and the whole matches tile the text without a gap, so
positions can be derived from their lengths.

Repeated groups are possessive: the JVM's matcher recurses on the others and a long literal would
overflow its stack.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EOF_TEXT, EOF_TYPE = "<EOF>", "EOF"


@dataclass(frozen=True)
class Profile:
    name: str
    pattern: str
    classify: Callable[[Column], Column]
    channel: Callable[[Column], Column]
    # Whether a token can contain line breaks or tabs, which token tables show escaped.
    multiline: bool = False
    # What has to follow the least number of characters of a part, so that no token spans its end.
    part_end: str = ""
    # Marks around skipped text that can span the end of a part.
    comment: tuple[str, str] | None = None

    def part_pattern(self, chars: int) -> str:
        """A pattern whose matches tile a text in parts of at least so many characters."""
        return rf"(?s)(?:.{{{chars}}}{self.part_end}|.+)"


def _starts_between(text: Column, first: str, last: str) -> Column:
    # Strings compare bytewise, so a range check on the first letter needs no regular expression.
    return (text >= first) & (text < chr(ord(last) + 1))


def _ascii_letter(text: Column) -> Column:
    return _starts_between(text, "a", "z") | _starts_between(text, "A", "Z") | text.startswith("_")


def _digit(text: Column) -> Column:
    return _starts_between(text, "0", "9")


def _no_channel(text: Column) -> Column:
    return F.lit(None).cast("int")


# ---------------------------------------------------------------- words: prose in any language

WORDS_TOKEN = (
    r"[\p{L}_][\p{L}\p{M}\p{Nd}_]*|[0-9]+(?:\.[0-9]+)?|<<=|>>=|[-+*/%^&|=!<>]=|[^ \t\r\n\f]"
)


def _words_type(text: Column) -> Column:
    return (
        F.when(text == EOF_TEXT, EOF_TYPE)
        .when(_ascii_letter(text), "Identifier")
        .when(_digit(text), F.when(text.contains("."), "FloatingLiteral").otherwise("IntegerLiteral"))
        .when((text >= "\x7f") & text.rlike(r"^\p{L}"), "Identifier")
        .otherwise(text)
    )


WORDS = Profile(
    "words", rf"[ \t\r\n\f]*+(?:({WORDS_TOKEN})|\z)", _words_type, _no_channel,
    # No token holds white space.
    part_end=r"[^ \t\r\n\f]*+",
)


# ---------------------------------------------------------------- cpp14: C and C++ sources

# The keywords of C++14 whose token type is their own spelling.
CPP_KEYWORDS = """
alignas alignof asm auto bool break case catch char char16_t char32_t class const constexpr
const_cast continue decltype default delete do double dynamic_cast else enum explicit export
extern final float for friend goto if inline int long mutable namespace new noexcept operator
override private protected public register reinterpret_cast return short signed sizeof static
static_assert static_cast struct switch template this thread_local throw try typedef typeid
typename union unsigned using virtual void volatile wchar_t while
""".split()

# Words and signs whose token type is a name of its own.
CPP_NAMED = {
    "true": "BooleanLiteral", "false": "BooleanLiteral", "nullptr": "PointerLiteral",
    "not": "Not", "and": "AndAnd", "or": "OrOr", "!": "Not", "&&": "AndAnd", "||": "OrOr",
}

# Operators of more than one character, longest first.
CPP_OPERATORS = (
    "<<= >>= ->* ... += -= *= /= %= ^= &= |= == != <= >= && || ++ -- -> :: .*".split()
)
CPP_SINGLE = "()[]{}+-*/%^&|~!=<>,?:;."


def cpp_pattern(possessive: bool = True) -> str:
    """The C++14 lexical grammar as one longest-match-first pattern.

    ``possessive=False`` spells the same language without possessive quantifiers, for engines
    that never backtrack. Text that no rule accepts is consumed the way a table-driven lexer
    recovers: the longest viable prefix and the character that ended it.
    """
    p = "+" if possessive else ""
    hex4, hex8 = "[0-9a-fA-F]{4}", "[0-9a-fA-F]{8}"
    universal = rf"\\u{hex4}|\\U{hex8}"
    identifier = rf"(?:[A-Za-z_]|{universal})(?:[A-Za-z_0-9]|{universal})*{p}"
    suffix = rf"(?:{identifier})?"

    digits = rf"[0-9](?:'?[0-9])*{p}"
    exponent = rf"[eE][+-]?{digits}"
    floating = rf"(?:(?:(?:{digits})?\.{digits}|{digits}\.)(?:{exponent})?|{digits}{exponent})"
    integer = (
        rf"(?:0[xX][0-9a-fA-F](?:'?[0-9a-fA-F])*{p}"
        rf"|0[bB][01]+(?:'[01]+)+{p}"
        rf"|[1-9](?:'?[0-9])*{p}|0(?:'?[0-7])*{p})"
    )

    escape = r"\\(?:['\"?\\abfnrtv]|\r\n?|\n|[0-7]|x[0-9a-fA-F]+)" rf"|{universal}"
    cut_universal = r"u[0-9a-fA-F]{0,3}|U[0-9a-fA-F]{0,7}"
    cut_escape = rf"\\(?:x|{cut_universal})?"
    string_body = rf"(?:[^\"\\\r\n]|{escape})*{p}"
    char_body = rf"(?:[^'\\\r\n]|{escape})+{p}"
    raw = r"R\"[^\r\n(]*\([^\r\n)]*\)[^\r\n\"]*\""
    string = rf"(?:u8|[uUL])?(?:{raw}|\"{string_body}\")"
    char = rf"[uUL]?'{char_body}'"

    if possessive:
        directive = r"#[^\n]*+(?:(?:(?<=\\)|(?<=\\\r))\n[^\n]++)*+"
    else:
        directive = r"#(?:[^\n]*\\\r?\n)+[^\n]+|#[^\n]*"

    operators = "|".join(
        "".join("\\" + sign for sign in op) for op in [*CPP_OPERATORS, *CPP_SINGLE]
    )
    token = (
        rf"(?:{string}|{char}){suffix}|{identifier}|{floating}{suffix}|{integer}{suffix}"
        rf"|{directive}|{operators}"
    )
    stop = r"(?:(?s:.)|\z)"
    error = (
        rf"\"{string_body}(?:{cut_escape})?{stop}"
        rf"|'(?:{char_body})?(?:{cut_escape})?{stop}"
        rf"|\\(?:{cut_universal})?{stop}|(?s:.)"
    )
    skip = rf"(?:[ \t\r\n]+{p}|//[^\r\n]*{p}|/\*(?s:.*?)\*/)*{p}"
    return rf"{skip}(?:({token})|{error}|\z)"


_INTEGER_LITERAL = (
    r"^(?:0[xX][0-9a-fA-F](?:'?[0-9a-fA-F])*+|0[bB][01](?:'?[01])*+|[1-9](?:'?[0-9])*+|0(?:'?[0-7])*+)"
    r"(?:[uU](?:ll|LL|[lL])?|(?:ll|LL|[lL])[uU]?)?$"
)
_FLOATING_LITERAL = (
    r"^(?:(?:(?:[0-9](?:'?[0-9])*+)?\.[0-9](?:'?[0-9])*+|[0-9](?:'?[0-9])*+\.)"
    r"(?:[eE][+-]?[0-9](?:'?[0-9])*+)?|[0-9](?:'?[0-9])*+[eE][+-]?[0-9](?:'?[0-9])*+)[flFL]?$"
)


def _cpp_type(text: Column) -> Column:
    quoted = text.rlike("^(?:u8|[uUL])?(?:R?\"|')")
    named = F.lit(None)
    for spelling, type_name in CPP_NAMED.items():
        named = F.when(text == spelling, type_name).otherwise(named)
    literal = (
        F.when(text.endswith('"'), "StringLiteral")
        .when(text.endswith("'"), "CharacterLiteral")
        .otherwise("UserDefinedLiteral")
    )
    number = (
        F.when(text.rlike(_INTEGER_LITERAL), "IntegerLiteral")
        .when(text.rlike(_FLOATING_LITERAL), "FloatingLiteral")
        .otherwise("UserDefinedLiteral")
    )
    return (
        F.when(text == EOF_TEXT, EOF_TYPE)
        .when((_ascii_letter(text) | text.startswith('"') | text.startswith("'")) & quoted, literal)
        .when(text.isin(CPP_KEYWORDS), text)
        .when(text.isin(list(CPP_NAMED)), named)
        .when(_ascii_letter(text) | text.startswith("\\"), "Identifier")
        .when(_digit(text) | text.rlike(r"^\.[0-9]"), number)
        .when(
            text.startswith("#"),
            F.when(text.contains("\n"), "MultiLineMacro").otherwise("Directive"),
        )
        .otherwise(text)
    )


def _cpp_channel(text: Column) -> Column:
    return F.when(text.startswith("#"), F.lit(1))


CPP14 = Profile(
    "cpp14", cpp_pattern(), _cpp_type, _cpp_channel, multiline=True,
    # Literals, directives and line comments go on after a line break only where a backslash stands before it; what recovers from
    # an error takes the line break as its last character.
    part_end=r".*?(?<!\\)(?<!\\\r)\n", comment=("/*", "*/"),
)

PROFILES = {profile.name: profile for profile in (WORDS, CPP14)}
