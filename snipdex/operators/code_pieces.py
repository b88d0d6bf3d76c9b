"""Snippets of code in braces as windows over pieces of text.

A Python function blanks out comments and strings and cuts the text behind every bracket and semicolon, and before lines
that begin like a declaration (`masking.script_pieces`). The mask of a piece is a row. How deep it lies is a running sum of
brackets; files of many pieces are windowed in ranges with what crosses a border carried over a small table, as for lines
(`code_lines`). The code itself stays in the stored table of files until `code_lines.snippets_at` cuts it.

Pieces at the outermost depth, with every group in brackets collapsed to its two brackets, are the skeleton of a file.
It falls into segments, one for each start of a declaration; in a segment a pattern over the skeleton tells kind and
name and which group is the body, and the pieces up to the end of that group are the code. All of that is seen in masks,
which have the lengths and line feeds of the code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snipdex.functions import paths as P
from snipdex.operators.code_lines import BLANKS, breaks, place, short_and_long, snippets_at, windows
from snipdex.operators.masking import csharp_pieces, script_pieces
from snipdex.session import stored

RANGE = 4096
#: Words that begin a declaration, and words before them.
KEYWORDS = "export|default|declare|abstract|async|function|class|interface|enum|type|const|let|var"
START = rf"^\s*(?:{KEYWORDS})\b"
BEFORE = r"^\s*(?:(?:export|default|declare|abstract|async)\s+)*"
NAME = r"([\p{L}_$][\p{L}\p{N}_$]*)"
ANGLES = r"(?:<[^;]*?>\s*)?"
# A brace behind one of these begins a type or a value, not a body.
GOES_ON = r"(?:[:|&<,=?]|=>|\b(?:is|extends|keyof))\s{0,100}"
BODY = rf"[^;{{]*(?:(?<={GOES_ON})\{{\}}[^;{{]*)*(?<!{GOES_ON})\{{"
ASSIGNED = r"(?:[^;=]|=>)*?=(?![=>])\s*(?:async\b\s*)?"
MORE = r"(?:[:|&<,=?>]|(?:is|extends|keyof)\b)"
ALIAS_LINES = rf"(?:[^;\n]|(?<={GOES_ON})\n|\n(?=\s*{MORE}))*"
#: Kind, whether only typed scripts have it, and the pattern up to the brace of the body (of an alias: to its end).
DECLARATIONS = [
    ("Function", False, rf"^\s*(?:(?:export|default|abstract|async)\s+)*function\b\s*\*?\s*{NAME}\s*{ANGLES}\(\){BODY}"),
    ("Class", False, rf"{BEFORE}class\s+{NAME}{BODY}"),
    ("Interface", True, rf"{BEFORE}interface\s+{NAME}{BODY}"),
    ("Enum", True, rf"{BEFORE}(?:const\s+)?enum\s+{NAME}{BODY}"),
    ("Arrow Function", False, rf"{BEFORE}(?:const|let|var)\s+{NAME}\b{ASSIGNED}{ANGLES}(?:\(\)(?:\s*:[^;]*?)?|[\p{{L}}_$][\p{{L}}\p{{N}}_$]*)\s*=>\s*\{{"),
    ("Type Alias", True, rf"{BEFORE}type\s+{NAME}\s*{ANGLES}=\s*[^;\s]{ALIAS_LINES};?"),
]


# C#: a declaration begins behind one of these, and ends with a brace or a semicolon; an initializer may go on.
NAMESPACE = r"(?U)\bnamespace\s+([\w.]+)\s*[{;]$"
TYPE = r"(?U)\b(class|interface|struct|record|enum)\s+(?:(?:class|struct)\s+)?(\w+)"
TAIL = r"^\s*(=[^;{}]*|[,.)][^;{}]*)?;$"
ATTRIBUTES = r"^\s*(\[[^\]]*\]\s*)*"
CALL = r"(?U)(\w+)\s*(?:<[^<>()]*(?:<[^<>()]*>[^<>()]*)*>)?\s*\("
NO_MEMBER = r"(?U)\b(delegate|operator)\b|~\w+\s*\(|\bthis\s*\["
LAST_WORD = r"(?U)(\w+)\s*$"


def _last_is(column: str, characters: str) -> Column:
    last = F.expr(f"right({column}, 1)")
    return last.isin(list(characters))


def cut_files(files: DataFrame, pieces: Column, path: str, language: Column, keep: tuple[str, ...]) -> DataFrame:
    """Stored rows (file, meta, pieces, n_pieces) of files with text: a file is cut once and keeps its number.

    `meta` has path, language and `keep`. Files without text are left out when codes are cut: see `extract_snippets`.
    """
    meta = F.struct(F.col(path).alias("path"), language.alias("language"), *keep)
    cut = files.select(meta.alias("meta"), pieces.alias("pieces")).withColumn("n_pieces", F.size("pieces"))
    return stored(cut.withColumn("file", F.monotonically_increasing_id()), "pieces")


def file_pieces(ready: DataFrame, range_pieces: int) -> DataFrame:
    """Rows (file, range, i, mask, typed) of the pieces of files; `typed` is for scripts."""
    typed = F.col("meta.language") == "typescript"
    rows = ready.select("file", typed.alias("typed"), F.posexplode("pieces.mask").alias("i", "mask"))
    return rows.select("file", F.expr(f"i div {range_pieces}").alias("range"), "i", "mask", "typed")


def _codes_of(ready: DataFrame) -> DataFrame:
    """Rows (file, meta, parts) of the files with text."""
    codes = ready.select("file", "meta", F.col("pieces.code").alias("parts"))
    return codes.filter(F.exists("parts", lambda code: code.rlike("\\S")))


def with_depth(rows: DataFrame, opening: str, closing: str, ranged: bool) -> DataFrame:
    """Adds `depth` (before the piece), `after`, `line` (lines before the piece) and `last` (last character before it).

    Closing brackets without an opening one are ignored: the depth is the sum so far less its lowest value below 0.
    """
    inside, so_far, ranges, before = windows(ranged, "i")
    delta = F.when(_last_is("mask", opening), 1).when(_last_is("mask", closing), -1).otherwise(0)
    rows = rows.withColumns({"delta": delta, "breaks": breaks("mask"), "ends": F.expr("right(mask, 1)")})
    rows = rows.withColumns({"total": F.sum("delta").over(so_far), "lines": F.sum("breaks").over(so_far), "last": F.lag("ends").over(inside)})
    rows = rows.withColumns({"lowest": F.min("total").over(so_far), "lowest_before": F.min("total").over(inside.rowsBetween(Window.unboundedPreceding, -1))})
    if ranged:
        rows = stored(rows, "summed")  # used twice
        ends = rows.groupBy("file", "range").agg(F.sum("delta").alias("sum"), F.min("total").alias("least"), F.sum("breaks").alias("breaks_here"), F.max_by("ends", "i").alias("end"))
        carried = ends.withColumns({"sum_in": F.coalesce(F.sum("sum").over(before), F.lit(0)), "lines_in": F.coalesce(F.sum("breaks_here").over(before), F.lit(0)), "last_in": F.lag("end").over(ranges)})
        carried = carried.withColumn("least_in", F.coalesce(F.min(F.col("sum_in") + F.col("least")).over(before), F.lit(0)))
        rows = rows.join(carried.select("file", "range", "sum_in", "least_in", "lines_in", "last_in"), ["file", "range"])
    else:
        rows = rows.withColumns({"sum_in": F.lit(0), "least_in": F.lit(0), "lines_in": F.lit(0), "last_in": F.lit(None).cast("string")})
    total = F.col("sum_in") + F.col("total")
    depth = total - F.col("delta") - F.least(F.lit(0), "least_in", F.col("sum_in") + F.col("lowest_before"))
    after = total - F.least(F.lit(0), "least_in", F.col("sum_in") + F.col("lowest"))
    rows = rows.withColumns({"depth": depth, "after": after, "line": F.col("lines_in") + F.col("lines") - F.col("breaks"), "last": F.coalesce("last", "last_in")})
    return rows.select("file", "range", "i", "mask", "typed", "depth", "after", "line", "last")


def head_so_far(rows: DataFrame, starts: Column, columns: list[str], name: str, ranged: bool) -> DataFrame:
    """Adds `name`: i and the given columns of the last start so far, over the borders of ranges."""
    _, so_far, _, before = windows(ranged, "i")
    rows = rows.withColumn("own", F.when(starts, F.struct("i", *columns)))
    if not ranged:
        return rows.withColumn(name, F.last("own", True).over(so_far)).drop("own")
    rows = stored(rows, "heads")  # used twice
    lasts = rows.groupBy("file", "range").agg(F.max_by("own", F.col("own.i")).alias("last_own"))
    carried = lasts.select("file", "range", F.last("last_own", True).over(before).alias("own_in"))
    rows = rows.withColumn(name, F.last("own", True).over(so_far)).join(carried, ["file", "range"])
    return rows.withColumn(name, F.coalesce(name, "own_in")).drop("own", "own_in")


def _lead(mask: Column) -> Column:
    """How many blanks and line feeds a text begins with."""
    return F.length(mask) - F.length(F.ltrim(mask, F.lit(BLANKS + "\n")))


def _leading_breaks(mask: Column) -> Column:
    return breaks(F.substring(mask, F.lit(1), _lead(mask)))


def script_snippets(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), range_pieces: int = RANGE, rest: bool = False) -> DataFrame:
    """Declarations at the outermost level of JavaScript and TypeScript files.

    Rows (keep, path, language, namespace, class_name, member_name, kind, code, start_line, end_line). A file without a
    declaration is one snippet; blank and null texts give none. With `rest`, lines outside of declarations are snippets too.
    """
    from snipdex.operators.extract import WHOLE_FILE

    language = P.detect_language(F.col(path))
    ready = cut_files(files, script_pieces(F.col(text)), path, language, keep)

    def segments(some: DataFrame, ranged: bool) -> DataFrame:
        rows = with_depth(file_pieces(some, range_pieces), "([{", ")]}", ranged)
        new_line = (F.col("i") == 0) | F.col("mask").startswith("\n") | F.col("last").isin(";", "}")
        rows = head_so_far(rows, (F.col("depth") == 0) & new_line & F.col("mask").rlike(START), [], "start", ranged)
        return rows.withColumn("segment", F.col("start.i")).drop("start", "range")

    rows = short_and_long(ready, F.col("n_pieces"), range_pieces, segments).filter("segment IS NOT NULL")
    # Of a group in brackets only the two brackets are seen.
    outer = rows.filter((F.col("depth") == 0) | (F.col("after") == 0))
    found = outer.groupBy("file", "segment").agg(F.sort_array(F.collect_list(F.struct("i", "mask", "depth", "after", "line"))).alias("pieces"), F.first("typed").alias("typed"))
    skeleton = F.array_join(F.transform("pieces", lambda p: F.when(p["depth"] == 0, p["mask"]).otherwise(F.right(p["mask"], F.lit(1)))), "")
    found = found.withColumn("skeleton", skeleton)
    judged = F.coalesce(
        *(
            F.when((F.col("typed") if only else F.lit(True)) & F.col("skeleton").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("skeleton", pattern, 1).alias("name"), F.regexp_extract("skeleton", pattern, 0).alias("front")))
            for kind, only, pattern in DECLARATIONS
        )
    )
    found = found.withColumn("d", judged).filter("d IS NOT NULL")
    # The body is the group that opens last in the front; its end is the closing piece of the same number.
    groups = F.length(F.regexp_replace("d.front", r"[^(\[{]", ""))
    closing = F.filter("pieces", lambda p: (p["depth"] > 0) & (p["after"] == 0))
    found = found.withColumns({"groups": groups, "closing": closing}).filter(F.size("closing") >= F.col("groups"))
    last = F.when(F.col("groups") > 0, F.element_at("closing", F.greatest(F.col("groups"), F.lit(1))))
    # Behind the last group an alias may go on within the next piece.
    tail = F.when(F.col("d.kind") == "Type Alias", F.rtrim(F.regexp_extract("d.front", r"[^)\]}]*$", 0), F.lit(BLANKS + "\n"))).otherwise("")
    found = found.withColumns({"last": last, "tail": F.length(tail), "behind": F.coalesce(last["i"] + 1, F.col("segment"))})
    following = F.get(F.filter("pieces", lambda p: p["i"] == F.col("behind")), F.lit(0))
    end = F.coalesce(following["line"] + breaks(F.substring(following["mask"], F.lit(1), F.col("tail"))), F.col("last.line") + breaks(F.col("last.mask")))
    first = F.get("pieces", F.lit(0))
    name = F.concat("d.name", F.lit(" ("), "d.kind", F.lit(")"))
    start = first["line"] + _leading_breaks(first["mask"]) + 1
    at = place(F.lower("d.kind"), name, F.col("segment"), F.col("behind") - F.col("segment"), start, end + 1, tail=F.col("tail"), lead=_lead(first["mask"]))
    label = F.when(F.col("meta.language") == "javascript", WHOLE_FILE["javascript"]).otherwise(WHOLE_FILE[""])
    return snippets_at(_codes_of(ready), found.select("file", at.alias("place")), "", keep, F.col("meta.language"), label, rest)


def _declarations(rows: DataFrame, level: Column, name: str, columns: list[str], ranged: bool) -> DataFrame:
    """Adds `name`: i and the given columns of the first piece of the declaration that a piece belongs to, at the level's depth."""
    at_level = F.col("depth") == level
    rows = rows.withColumn("assigns", F.contains("mask", F.lit("=")))
    rows = head_so_far(rows, at_level & F.col("mask").endswith("{"), ["assigns"], "opener", ranged).drop("assigns")
    tail = F.col("mask").rlike(TAIL) & (F.col("opener.assigns") | (F.regexp_extract("mask", TAIL, 1) != ""))
    begins = (F.col("i") == 0) | F.col("last").isin("{", ";") | ((F.col("last") == "}") & ~F.coalesce(tail, F.lit(False)))
    return head_so_far(rows, at_level & begins, columns, name, ranged).drop("opener")


def _namespaces(rows: DataFrame, blocks: bool, ranged: bool) -> DataFrame:
    """Adds `level`, the number of namespace blocks around a piece, and `space`, the name of its namespace.

    One step for each depth at which some file opens a namespace; `blocks` tells whether any does.
    """
    rows = rows.withColumn("names", F.when(F.contains("mask", F.lit("namespace")), F.regexp_extract("mask", NAMESPACE, 1)).otherwise(""))
    file_scoped = (F.col("depth") == 0) & F.col("mask").endswith(";") & (F.col("names") != "")
    rows = head_so_far(rows, file_scoped, ["names"], "own_space", ranged)
    rows = rows.withColumns({"level": F.lit(0), "space": F.coalesce("own_space.names", F.lit(""))}).drop("own_space")
    rows = rows.withColumn("opens_space", F.col("mask").endswith("{") & (F.col("names") != ""))
    depth = 0
    while blocks:
        rows = stored(rows, "namespaces")
        if rows.filter((F.col("level") == depth) & (F.col("depth") == depth) & F.col("opens_space")).isEmpty():
            break
        rows = _declarations(rows, F.lit(depth), "head", ["names", "opens_space"], ranged)
        inside = (F.col("level") == depth) & (F.col("depth") > depth) & F.col("head.opens_space")
        inner = F.concat_ws(".", F.nullif(F.col("space"), F.lit("")), F.col("head.names"))
        rows = rows.withColumns({"space": F.when(inside, inner).otherwise(F.col("space")), "level": F.when(inside, depth + 1).otherwise(F.col("level"))}).drop("head")
        depth += 1
    return rows


def _bare(head: Column) -> Column:
    """The text before a body, without attributes and the blanks of comments before it."""
    return F.trim(F.regexp_replace(F.regexp_replace(head, r"[{;]$", ""), ATTRIBUTES, ""))


def _with_members(found: DataFrame, modifiers: list[str]) -> DataFrame:
    """Adds `found`: an array of (kind, name) that a type or a member declaration declares.

    What several patterns look at are columns of their own: within one expression each pattern would work it out again.
    """
    found = found.withColumn("head", F.when(~F.col("role.whole"), _bare(F.col("first.mask"))))
    found = found.withColumns({"front": F.regexp_extract("head", r"(?s)^(.*?)(?:=>|=(?!=)|$)", 1), "value": F.regexp_extract("head", r"=>|=(?!=)", 0)})
    call = F.get(F.filter(F.regexp_extract_all("front", F.lit(CALL), F.lit(1)), lambda c: ~c.isin(modifiers)), F.lit(0))
    found = found.withColumns({"last_word": F.regexp_extract("front", LAST_WORD, 1), "call": call})
    members = _members(F.col("head"), F.col("front"), F.col("value"), F.col("last_word"), F.col("call"), F.col("first.mask").endswith("{"), F.col("owner"))
    return found.withColumn("found", F.when(F.col("role.whole"), F.array(F.struct("kind", F.col("owner").alias("name")))).otherwise(members))


def _members(head: Column, front: Column, value: Column, last_word: Column, call: Column, has_body: Column, owner: Column) -> Column:
    """An array of (kind, name) that a member declaration declares."""
    flat = F.regexp_replace(head, r"<[^;=]*>|\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " ")
    names = F.filter(F.transform(F.split(flat, ","), lambda part: F.regexp_extract(F.get(F.split(part, "="), F.lit(0)), LAST_WORD, 1)), lambda n: n != "")
    none = F.array().cast("array<struct<kind:string,name:string>>")
    one = lambda kind, name: F.array(F.struct(kind.alias("kind"), name.alias("name")))
    return (
        F.when(front.rlike(NO_MEMBER) | front.rlike(TYPE), none)
        .when(front.rlike(r"\bevent\b"), F.when(has_body & (last_word != ""), one(F.lit("event"), last_word)).otherwise(none))
        .when(call.isNotNull(), one(F.when(call == owner, "constructor").otherwise(F.lit("method")), call))
        .when((value == "=") | (~has_body & (value == "")), F.transform(names, lambda n: F.struct(F.lit("field").alias("kind"), n.alias("name"))))
        .when(last_word != "", one(F.lit("property"), last_word))
        .otherwise(none)
    )


def csharp_snippets(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), range_pieces: int = RANGE, rest: bool = False) -> DataFrame:
    """Types of C# files that are not nested in types, and their direct members, with their whole code.

    In damaged files, what is closed is found even where a type around it is not. With `rest`, lines outside of types are
    snippets too.

    Rows (keep, path, language, namespace, class_name, member_name, kind, code, start_line, end_line).
    """
    from snipdex.operators.extract import CSHARP_LABELS, CSHARP_MODIFIERS

    ready = cut_files(files, csharp_pieces(F.col(text)), path, F.lit("csharp"), keep)
    opens = F.exists("pieces.mask", lambda mask: mask.endswith("{") & F.contains(mask, F.lit("namespace")))
    blocks = not ready.filter(opens).isEmpty()

    def declared(some: DataFrame, ranged: bool) -> DataFrame:
        rows = _namespaces(with_depth(file_pieces(some, range_pieces), "{", "}", ranged), blocks, ranged)
        rows = rows.withColumn("bare", _bare(F.col("mask")))
        kind = F.when(F.col("names") == "", F.regexp_extract("bare", TYPE, 1)).otherwise("")
        rows = rows.withColumns({"kind": kind, "owner": F.regexp_extract("bare", TYPE, 2), "opens": F.col("mask").endswith("{")}).drop("bare")
        rows = _declarations(rows, F.col("level"), "type", ["kind", "owner", "opens"], ranged)
        rows = rows.filter((F.col("type.kind") != "") & (F.col("after") >= F.col("level")))
        return _declarations(rows, F.col("level") + 1, "member", ["opens"], ranged)

    rows = short_and_long(ready, F.col("n_pieces"), range_pieces, declared)
    # A piece belongs to its type, and to the member that it lies in: both are gathered by one shuffle.
    in_type = F.struct(F.lit(True).alias("whole"), F.col("type.i").alias("first"), F.col("level").alias("at"))
    holds = (F.col("depth") > F.col("level")) & (F.col("after") > F.col("level")) & (F.col("type.kind") != "enum") & F.col("type.opens") & (F.col("member.i") > F.col("type.i"))
    in_member = F.struct(F.lit(False).alias("whole"), F.col("member.i").alias("first"), (F.col("level") + 1).alias("at"))
    roles = F.when(holds, F.array(in_type, in_member)).otherwise(F.array(in_type))
    rows = rows.select("file", "i", "mask", "after", "line", "space", F.col("type.kind").alias("kind"), F.col("type.owner").alias("owner"), F.explode(roles).alias("role"))
    # The pieces of a role follow each other: only the first and the last are looked at.
    found = rows.groupBy("file", "role").agg(
        F.min(F.struct("i", "mask", "line")).alias("first"), F.max(F.struct("i", "mask", "line", "after")).alias("end"), F.first("space").alias("space"), F.first("kind").alias("kind"), F.first("owner").alias("owner")
    )
    first, end = F.col("first"), F.col("end")
    # A declaration that is not ended, or that has no text, is none.
    found = found.filter((end["after"] == F.col("role.at")) & end["mask"].rlike(r"[};]$"))
    found = _with_members(found, sorted(CSHARP_MODIFIERS))
    labels = F.create_map(*(F.lit(x) for pair in CSHARP_LABELS.items() for x in pair))
    # The plain explode would have members worked out again, in a filter that it brings along.
    found = found.select("file", "first", "end", "space", "owner", F.explode_outer("found").alias("one")).filter("one IS NOT NULL")
    name = F.concat("one.name", F.lit(" ("), labels[F.col("one.kind")], F.lit(")"))
    start = first["line"] + _leading_breaks(first["mask"]) + 1
    at = place(
        F.col("one.kind"), name, first["i"], end["i"] - first["i"] + 1, start, end["line"] + breaks(end["mask"]) + 1, lead=_lead(first["mask"]), namespace=F.col("space"), owner=F.col("owner")
    )
    return snippets_at(_codes_of(ready), found.select("file", at.alias("place")), "", keep, F.lit("csharp"), rest=rest)
