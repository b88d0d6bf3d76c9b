"""Snippets of indented code as windows over lines.

A file becomes a row per line. What a line means depends on lines before it: how many brackets are open, whether the
line before goes on, and which header was the last. Files of up to `RANGE` lines need one window each. A window over a
longer file would put it into one task, so there windows run inside ranges of `RANGE` lines (`ranged`); what has to cross
a border is worked out on a small table with a row per file and range, and joined to the lines of the range.

Windows see masks alone, and give places: where a snippet begins and how far it goes. The text stays with its file, in one
stored table, and meets all places of the file in one join (`snippets_at`), which also cuts the lines that no place has.

Only comments and strings are blanked out by a Python function (`masking.python_mask`); all else are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snipdex.functions import paths as P
from snipdex.operators.masking import python_mask
from snipdex.session import stored

RANGE = 4096
#: White space of Unicode, as Python's text functions have it, but for the line feed.
BLANKS = " \t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where a snippet lies among the parts (lines or pieces) of its file: `count` parts from `first` on and `tail` characters of the
#: next one, without `lead` characters at the beginning. Without an owner it belongs to the file; without an end it ends
#: with its code. A place of kind `rest` counts in lines, and goes to the end of the file if it has no count.
PLACE = "struct<first:int,count:int,tail:int,lead:int,start_line:int,end_line:int,namespace:string,owner:string,name:string,kind:string>"
REST = "Rest (File)"
TO_END = 2**31 - 1
HEADER = rf"^[{BLANKS}]*(?:async[{BLANKS}]+)?(class|def)[{BLANKS}]+([\p{{L}}\p{{N}}\p{{M}}_]+)"


def _count(column: str, brackets: str) -> Column:
    return F.length(column) - F.length(F.translate(column, brackets, ""))


def _is_header(column: str) -> Column:
    """The pattern is tried only on lines that hold one of the words."""
    return (F.contains(F.col(column), F.lit("def")) | F.contains(F.col(column), F.lit("class"))) & F.col(column).rlike(HEADER)


def masked_files(files: DataFrame, mask: Column, path: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Stored rows (file, meta, text, mask, n_lines) of files with text: masking runs once, and a file keeps its number.

    `meta` has path and `keep`. Files without text are left out when the rows are read: see `extract_snippets`.
    """
    meta = F.struct(F.col(path).alias("path"), *keep)
    ready = files.select(meta.alias("meta"), F.col(text).alias("text"), mask.alias("mask"), F.size(F.split(text, "\n")).alias("n_lines"))
    return stored(ready.withColumn("file", F.monotonically_increasing_id()), "masked").filter(F.col("text").rlike("\\S"))


def file_lines(ready: DataFrame, range_lines: int) -> DataFrame:
    """Rows (file, range, n, mask) of the lines of files."""
    # The plain explode would have masks split again, in a filter that it brings along.
    lines = ready.select("file", F.posexplode_outer(F.split("mask", "\n")).alias("n", "mask")).filter("n IS NOT NULL")
    # Blanks at the end of a mask, most of it where strings were, mean nothing.
    return lines.select("file", F.expr(f"n div {range_lines}").alias("range"), "n", F.rtrim("mask").alias("mask"))


def windows(ranged: bool, place: str):
    """Windows over the rows of a file or of a range of it, up to each row, and over ranges, before each range."""
    inside = Window.partitionBy("file", "range").orderBy(place) if ranged else Window.partitionBy("file").orderBy(place)
    ranges = Window.partitionBy("file").orderBy("range")
    return inside, inside.rowsBetween(Window.unboundedPreceding, 0), ranges, ranges.rowsBetween(Window.unboundedPreceding, -1)


def short_and_long(ready: DataFrame, size: Column, limit: int, form) -> DataFrame:
    """`form(files, ranged)` of the files with up to `limit` rows, and of the longer ones if there are any."""
    longer = ready.filter(size > limit)
    found = form(ready.filter(size <= limit), False)
    return found if longer.isEmpty() else found.unionByName(form(longer, True))


def logical_lines(lines: DataFrame, ranged: bool = True) -> DataFrame:
    """Adds `logical`: the line begins a statement, since it has text, no bracket is open and the line before has ended.

    Closing brackets without an opening one are ignored: the depth is the sum so far less its lowest value below 0.
    """
    inside, so_far, ranges, before = windows(ranged, "n")
    rows = lines.withColumns(
        {
            "delta": _count("mask", "([{") - _count("mask", ")]}"),
            "blank": F.trim("mask", F.lit(BLANKS)) == "",
            "goes_on": F.rtrim("mask", F.lit(BLANKS)).endswith("\\"),
        }
    )
    rows = rows.withColumns({"total": F.sum("delta").over(so_far), "joined": F.lag("goes_on").over(inside)})
    rows = rows.withColumns({"lowest": F.min("total").over(so_far), "lowest_before": F.min("total").over(inside.rowsBetween(Window.unboundedPreceding, -1))})
    if ranged:
        rows = stored(rows, "summed")  # used twice
        ends = rows.groupBy("file", "range").agg(F.sum("delta").alias("sum"), F.min("total").alias("least"), F.max_by("goes_on", "n").alias("last"))
        carried = ends.withColumn("sum_in", F.coalesce(F.sum("sum").over(before), F.lit(0)))
        carried = carried.select(
            "file", "range", "sum_in", F.coalesce(F.min(F.col("sum_in") + F.col("least")).over(before), F.lit(0)).alias("least_in"), F.lag("last").over(ranges).alias("joined_in")
        )
        rows = rows.join(carried, ["file", "range"])
    else:
        rows = rows.withColumns({"sum_in": F.lit(0), "least_in": F.lit(0), "joined_in": F.lit(False)})
    depth = F.col("sum_in") + F.col("total") - F.col("delta") - F.least(F.lit(0), "least_in", F.col("sum_in") + F.col("lowest_before"))
    joined = F.coalesce("joined", "joined_in", F.lit(False))
    rows = rows.withColumn("logical", ~F.col("blank") & (depth == 0) & ~joined)
    return rows.select("file", "range", "n", "mask", "logical")


def under_headers(rows: DataFrame, ranged: bool = True) -> DataFrame:
    """Adds `header` (line, indent, word, name) of the last header so far, and `closes`: this line is no longer in its block."""
    _, so_far, _, before = windows(ranged, "n")
    indent = F.length("mask") - F.length(F.ltrim("mask", F.lit(BLANKS)))
    own = F.struct(F.col("n").alias("n"), indent.alias("indent"), F.regexp_extract("mask", HEADER, 1).alias("word"), F.regexp_extract("mask", HEADER, 2).alias("name"))
    rows = rows.withColumn("own", F.when(F.col("logical") & _is_header("mask"), own)).withColumn("indent", indent)
    if ranged:
        rows = stored(rows, "headers")  # used twice
        lasts = rows.groupBy("file", "range").agg(F.max("own").alias("last"))
        carried = lasts.select("file", "range", F.last("last", True).over(before).alias("header_in"))
        rows = rows.withColumn("header", F.last("own", True).over(so_far)).join(carried, ["file", "range"])
        rows = rows.withColumn("header", F.coalesce("header", "header_in"))
    else:
        rows = rows.withColumn("header", F.last("own", True).over(so_far))
    closes = F.col("logical") & (F.col("n") > F.col("header.n")) & (F.col("indent") <= F.col("header.indent"))
    return rows.select("file", "n", "header", F.coalesce(closes, F.lit(False)).alias("closes"))


def place(kind: Column, name: Column, first: Column, count: Column, start_line: Column, end_line: Column, **more: Column) -> Column:
    """A `PLACE`; what is not named is empty."""
    values = {"first": first, "count": count, "start_line": start_line, "end_line": end_line, "name": name, "kind": kind, "tail": F.lit(0), "lead": F.lit(0), "namespace": F.lit("")} | more
    fields = [part.split(":") for part in PLACE[len("struct<") : -1].split(",")]
    return F.struct(*(values.get(field, F.lit(None)).cast(type_).alias(field) for field, type_ in fields))


def _rest(behind: Column, until: Column | None = None) -> Column:
    """The place of the lines behind a line and before another one, or up to the end of the file."""
    count = F.lit(None) if until is None else until - behind - 1
    return place(F.lit("rest"), F.lit(REST), behind, count, behind + 1, F.lit(None))


def _per_file(places: DataFrame, keys: list[str], rest: bool) -> DataFrame:
    """One row per file with its `places`; with `rest`, also those of the lines between and behind them.

    Lines are covered up to the greatest end so far, as places may lie in each other.
    """
    if not rest:
        return places.groupBy(*keys).agg(F.collect_list("place").alias("places"))
    before = Window.partitionBy(*keys).orderBy("place.start_line").rowsBetween(Window.unboundedPreceding, -1)
    covered, start = F.coalesce(F.max("place.end_line").over(before), F.lit(0)), F.col("place.start_line")
    places = places.withColumn("gap", F.when(start > covered + 1, _rest(covered, start)))
    found = places.groupBy(*keys).agg(F.collect_list("place").alias("places"), F.collect_list("gap").alias("gaps"), F.max("place.end_line").alias("covered"))
    return found.select(*keys, "places", F.concat("gaps", F.array(_rest(F.coalesce("covered", F.lit(0))))).alias("gaps"))


def breaks(text: Column | str) -> Column:
    """How many line feeds a text has."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def snippets_at(ready: DataFrame, places: DataFrame, between: str, keep: tuple[str, ...], language: Column, whole: Column | None = None, rest: bool = False) -> DataFrame:
    """Snippets of files (file, meta, parts) at the places (file, place), by one join of the texts.

    Parts are joined by `between`. A file without a place is one snippet named `whole`, if that is given; with `rest`,
    lines with text that no place has are snippets too. Codes are put together of parts, so a file of many snippets is
    not walked again for each.
    """
    # Places lie where windows left them. A broadcast would be planned when the texts are moved already, and pass the driver.
    found = ready.join(_per_file(places, ["file"], rest).hint("merge"), "file", "left")
    none = F.col("places").isNull()
    all_places = F.coalesce("places", F.array().cast(f"array<{PLACE}>"))
    if whole is not None:
        one = place(F.lit("file"), whole, F.lit(0), F.size("parts"), F.lit(1), F.lit(None))
        all_places = F.when(none, F.array(one)).otherwise(all_places)
    lines = F.array().cast("array<string>")
    if rest:
        left = F.array(_rest(F.lit(0))) if whole is None else F.array().cast(f"array<{PLACE}>")
        all_places = F.concat(all_places, F.when(none, left).otherwise(F.col("gaps")))
        lines = F.col("parts") if between == "\n" else F.split(F.array_join("parts", between), "\n")
    cut = found.select("meta", "parts", lines.alias("lines"), all_places.alias("places"))
    return _codes(cut.select("meta", "parts", "lines", F.explode_outer("places").alias("at")).filter("at IS NOT NULL"), between, keep, language)


def _codes(cut: DataFrame, between: str, keep: tuple[str, ...], language: Column) -> DataFrame:
    """Snippets of rows (meta, parts, lines, at), each with one place of its file."""
    first, count, is_rest = F.col("at.first"), F.col("at.count"), F.col("at.kind") == "rest"
    loose = F.array_join(F.slice("lines", first + 1, F.coalesce(count, F.size("lines") - first)), "\n")
    # Only of the rest is it not known whether it has text.
    cut = cut.filter(~is_rest | (F.trim(loose, F.lit(BLANKS + "\n")) != ""))
    joined = F.array_join(F.slice("parts", first + 1, count), between)
    tail = F.when(F.col("at.tail") > 0, F.substring(F.coalesce(F.get("parts", first + count), F.lit("")), F.lit(1), F.col("at.tail"))).otherwise("")
    whole = F.concat(joined, tail)
    code = F.when(F.col("at.lead") > 0, F.substring(whole, F.col("at.lead") + 1, F.lit(TO_END))).otherwise(whole)
    cut = cut.select("meta", "at", F.when(is_rest, F.rtrim(loose, F.lit(BLANKS + "\n"))).otherwise(code).alias("code"))
    # The rest begins with its first line with text, and keeps the blanks of that line.
    bare = F.ltrim("code", F.lit(BLANKS + "\n"))
    blank = F.substring("code", F.lit(1), F.length("code") - F.length(bare))
    skipped = F.when(is_rest, breaks(blank)).otherwise(0)
    code = F.when(skipped > 0, F.concat(F.substring_index(blank, "\n", -1), bare)).otherwise(F.col("code"))
    cut = cut.select("meta", "at", code.alias("code"), (F.col("at.start_line") + skipped).alias("start_line"))
    return cut.select(
        *[F.col("meta")[k].alias(k) for k in keep],
        F.col("meta.path").alias("path"),
        language.alias("language"),
        F.col("at.namespace").alias("namespace"),
        F.coalesce("at.owner", P.file_stem(F.col("meta.path"))).alias("class_name"),
        F.col("at.name").alias("member_name"),
        F.col("at.kind").alias("kind"),
        "code",
        "start_line",
        F.coalesce("at.end_line", F.col("start_line") + breaks("code")).cast("int").alias("end_line"),
    )


def python_snippets(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), range_lines: int = RANGE, rest: bool = False) -> DataFrame:
    """Classes and functions of Python files; a block ends at the latest before the next header.

    Rows (keep, path, language, namespace, class_name, member_name, kind, code, start_line, end_line). A file without a
    header is one snippet; blank and null texts give none. With `rest`, lines outside of blocks are snippets too.
    """
    from snipdex.operators.extract import WHOLE_FILE

    ready = masked_files(files, python_mask(F.col(text)), path, text, keep)
    rows = short_and_long(ready, F.col("n_lines"), range_lines, lambda some, ranged: under_headers(logical_lines(file_lines(some, range_lines), ranged), ranged))
    # Lines before the first header belong to no block.
    blocks = rows.filter(F.col("header").isNotNull()).groupBy("file", "header").agg(F.max("n").alias("last"), F.min(F.when(F.col("closes"), F.col("n"))).alias("stop"))
    word, name, first = F.col("header.word"), F.col("header.name"), F.col("header.n")
    behind = F.coalesce(F.col("stop"), F.col("last") + 1)
    kind = F.when(word == "class", "Class").otherwise("Function")
    at = place(F.lower(kind), F.concat(name, F.lit(" ("), kind, F.lit(")")), first, behind - first, first + 1, behind, owner=F.when(word == "class", name))
    parts = ready.select("file", "meta", F.split("text", "\n").alias("parts"))
    return snippets_at(parts, blocks.select("file", at.alias("place")), "\n", keep, F.lit("python"), F.lit(WHOLE_FILE[""]), rest)


def rest_of_lines(files: DataFrame, snippets: DataFrame, path: str, text: str, keep: tuple[str, ...] = (), range_lines: int = RANGE) -> DataFrame:
    """Runs of lines with text that no snippet has, as snippets of kind `rest`.

    Only first and last lines of the snippets are moved, and each text once. Texts are not cut into rows, so
    `range_lines` changes nothing.
    """
    key = F.struct(F.col(path).alias("path"), *keep)
    ready = files.select(key.alias("meta"), F.split(text, "\n").alias("lines"))
    own = F.struct("path", *keep).alias("meta")
    at = place(F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.col("start_line"), F.col("end_line"))
    found = ready.join(_per_file(snippets.select(own, at.alias("place")), ["meta"], True).drop("places"), "meta", "left")
    gaps = F.coalesce("gaps", F.array(_rest(F.lit(0))))
    cut = found.select("meta", F.col("lines").alias("parts"), "lines", F.explode(gaps).alias("at"))
    return _codes(cut, "\n", keep, P.detect_language(F.col("meta.path")))
