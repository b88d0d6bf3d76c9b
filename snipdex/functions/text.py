"""Token estimates, truncation, chunking and line helpers as Column expressions.

Everything here stays in the JVM.  Lengths count code points, so characters outside the
basic plane count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r"
TRIM_END = " \t\n\r\f\u000b\u0085 "

# Fixed values
CHARS_PER_TOKEN = 4
SNIPPET_LIMIT = 2000
SNIPPET_KEPT = 1950
SNIPPET_MARKER = "\n// ... 代码过长已截取 ..."


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once.

    A column that a lambda mentions from outside is computed anew for every element; bound like
    this it is a variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    """Words separated by space, tab, line feed or carriage return.

    Every word with the blanks before it becomes one mark; building marks is much cheaper than
    an array of words.
    """
    marks = F.regexp_replace(text, "[ \\t\\n\\r]*[^ \\t\\n\\r]+", "x")
    return F.length(F.rtrim(marks, F.lit(BLANKS)))


def cjk_count(text: Column) -> Column:
    """Characters U+4E00 to U+9FFF."""
    return F.length(F.regexp_replace(text, "[^\\u4e00-\\u9fff]+", ""))


def _div(a: Column, n: int) -> Column:
    return F.call_function("div", a, F.lit(n)).cast("int")


def estimate_tokens(text: Column) -> Column:
    """Words plus CJK characters plus a quarter of the rest, at least a quarter of the length."""
    size = F.length(text)

    def mixed(dense: Column) -> Column:
        return dense + _div(size - dense, CHARS_PER_TOKEN)

    dense = word_count(text) + cjk_count(text)
    return F.greatest(bind(dense, mixed), _div(size, CHARS_PER_TOKEN))


def estimate_tokens_simple(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("int")


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(TRIM_END))


def truncate_lines(text: Column, max_tokens: int) -> Column:
    """Whole leading lines while their running token estimate fits; may become empty."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("tokens"))

    def step(acc: Column, line: Column) -> Column:
        # Once over the limit the rest is not looked at any more.
        more = estimate_tokens(F.concat(line, F.lit("\n")))
        grown = F.struct((acc["seen"] + 1).alias("seen"), (acc["tokens"] + more).alias("tokens"))
        return F.when(acc["tokens"] > max_tokens, acc).otherwise(grown)

    def kept(acc: Column) -> Column:
        return acc["seen"] - F.when(acc["tokens"] > max_tokens, 1).otherwise(0)

    first = F.slice(lines, F.lit(1), F.aggregate(lines, start, step, kept))
    cut = rstrip(F.array_join(first, "\n"))
    # A character counts twice at most, so short texts need no estimate.
    fits = (F.length(text) * 2 <= max_tokens) | (estimate_tokens(text) <= max_tokens)
    return F.when(fits, text).otherwise(cut)


def truncate_chars(text: Column, max_tokens: int) -> Column:
    return F.substring(text, 1, max_tokens * CHARS_PER_TOKEN)


def cap_snippet(code: Column) -> Column:
    short = F.concat(F.substring(code, 1, SNIPPET_KEPT), F.lit(SNIPPET_MARKER))
    return F.when(F.length(code) > SNIPPET_LIMIT, short).otherwise(code)


def chunks(text: Column, size: int = 200, overlap: int = 50) -> Column:
    """Array of fixed-size windows that overlap by `overlap` characters.

    The text is cut once into blocks of one step; each window is joined from its blocks,
    so the cost stays linear in the length of the text.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    span = -(-size // step)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    # A window that starts inside the last overlap would only repeat the window before it.
    windows = F.greatest(
        F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(step)).cast("int")
    )
    starts = F.sequence(F.lit(1), windows)
    cut = bind(
        blocks,
        lambda b: F.transform(starts, lambda i: F.substring(F.array_join(F.slice(b, i, F.lit(span)), ""), 1, size)),
    )
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.btrim(text, F.lit(TRIM_END)) == "")


def line_number(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def leading_indent(line: Column) -> Column:
    return F.regexp_extract(line, "^([ \\t]*)", 1)
