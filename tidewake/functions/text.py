"""Text of logs and source files as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {"py": "python", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "h": "cpp", "md": "markdown", "yaml": "yaml", "yml": "yaml", "json": "json", "sh": "shell", "txt": "text"}
#: Line comment, block begin and block end of each language.
COMMENTS = {"python": ("#", '"""', '"""'), "cpp": ("//", "/*", "*/"), "shell": ("#", None, None), "yaml": ("#", None, None)}


def readable(content: Column) -> Column:
    """Bytes as text; what isn't UTF-8 is left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _line_fold(text: Column, language: str, start: Column, add: Callable[[Column, Column], Column], done: Callable[[Column], Column]) -> Column:
    """A fold of ``add`` over the lines' kinds, blank, comment or code; it carries whether a block comment is open."""
    mark, begin, end = COMMENTS.get(language, (None, None, None))

    def next_line(state: Column, line: Column) -> Column:
        bare = F.trim(line)
        blank = bare == ""
        if begin is None:
            opens, closes = F.lit(False), F.lit(False)
        elif begin == end:
            quotes = F.regexp_count(bare, F.lit(begin))
            opens, closes = bare.startswith(begin) & (quotes % 2 == 1), quotes > 0
        else:
            opens, closes = bare.startswith(begin) & ~bare.contains(end), bare.contains(end)
        single = bare.startswith(mark) if mark else F.lit(False)
        whole_block = bare.startswith(begin) if begin else F.lit(False)
        kind = F.when(blank, "blank").when(state.open | single | whole_block, "comment").otherwise("code")
        still = F.when(blank, state.open).when(state.open, ~closes).otherwise(opens)
        return F.struct(still.alias("open"), add(state.made, kind).alias("made"))

    return F.aggregate(lines(text), F.struct(F.lit(False).alias("open"), start.alias("made")), next_line, lambda s: done(s.made))


def line_kinds(text: Column, language: str) -> Column:
    """An array with blank, comment or code for each line."""
    return _line_fold(text, language, F.array().cast("array<string>"), lambda made, kind: F.concat(made, F.array(kind)), lambda made: made)


def line_counts(text: Column, language: str) -> Column:
    """How many lines a text has, and how many of them are comment and blank, as a struct (n, comment, blank); all others are code.

    Where no block comment begins, patterns over the whole text count; else a fold does, in one number, where ``line_kinds`` copies an array for each line.
    """
    mark, begin, _ = COMMENTS.get(language, (None, None, None))
    whole, most = F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), 1 << 31  # each line follows its own line feed
    n = F.size(lines(text))
    comment = F.regexp_count(whole, F.lit(rf"\n *{re.escape(mark)}")) if mark else F.lit(0)
    plain = F.struct(n.alias("n"), comment.alias("comment"), F.regexp_count(whole, F.lit(r"\n(?= *(?:\n|\z))")).alias("blank"))
    if begin is None:
        return plain
    unpacked = lambda made: F.struct(n.alias("n"), F.floor(made / most).cast("int").alias("comment"), (made % most).cast("int").alias("blank"))
    fold = _line_fold(text, language, F.lit(0).cast("long"), lambda made, kind: made + F.when(kind == "code", 0).when(kind == "comment", F.lit(most)).otherwise(1), unpacked)
    return F.when(whole.contains(begin), fold).otherwise(plain)


def count_of(values: Column, what: str) -> Column:
    return F.size(F.filter(values, lambda x: x == what))


def branch_tokens(text: Column, tokens: Sequence[str]) -> Column:
    """Lines that hold each token anywhere, summed over the tokens: one hit a token and line."""
    return F.aggregate(lines(text), F.lit(0), lambda n, line: n + sum((line.contains(t).cast("int") for t in tokens), F.lit(0)))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def distinct_tokens(text: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(extracted(text, pattern)))


def number_and_unit(text: Column) -> Column:
    """``1.433V`` as (value, unit); nulls where the text isn't a number with a unit."""
    value = F.regexp_extract(F.trim(text), r"^([+-]?\d+(?:\.\d+)?)\s*([A-Za-z%]+)$", 1)
    unit = F.regexp_extract(F.trim(text), r"^([+-]?\d+(?:\.\d+)?)\s*([A-Za-z%]+)$", 2)
    return F.struct(value.try_cast("double").alias("value"), F.when(unit != "", unit).alias("unit"))


def top_directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.element_at(F.split(path, "/"), 1)).otherwise(F.lit("."))


def directory_key(path: Column, depth: int) -> Column:
    """The first ``depth`` directories of a path, ``.`` for files at the top."""
    parts = F.split(path, "/")
    n = F.least(F.lit(depth), F.size(parts) - 1)
    return F.when(n < 1, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(n, F.lit(1))), "/"))


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.element_at(table, F.lower(F.element_at(F.split(path, r"\."), -1))), F.lit("other"))


def frames_with_checksum(data: Column, types: tuple[int, int] = (0, 255)) -> Column:
    """(valid, loose): 11-byte frames that begin with 0x55 and a byte between ``types`` and whose last byte is the sum of the others, and all that begin so."""
    text = F.hex(data)
    # most data hold no such start: one pattern over the hex digits spares them the search
    least, most = (f"{t:02X}" for t in types)
    some = text.rlike(f"^(?:[0-9A-F]{{2}})*?55(?:{least[0]}[0-9A-F]|{most[0]}[0-9A-F])") if least[0] == most[0] else text.contains("55")
    byte = lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    n = F.length(data)
    starts = F.filter(F.when((n >= 11) & some, F.sequence(F.lit(0), n - 11)).otherwise(F.array().cast("array<int>")), lambda i: (byte(i) == 0x55) & byte(i + 1).between(*types))
    total = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0), lambda s, j: s + byte(i + j))
    valid = F.filter(starts, lambda i: total(i).bitwiseAND(F.lit(0xFF)) == byte(i + 10))
    return F.struct(F.size(valid).alias("valid"), F.size(starts).alias("loose"))


def iso_time(text: Column) -> Column:
    """Null where the text isn't a time."""
    return F.try_to_timestamp(text)


def has_flag(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << bit)) != 0


def padded(values: Column, size: int) -> list[Column]:
    """The first ``size`` elements as columns, null where there are fewer."""
    return [F.get(values, F.lit(i)) for i in range(size)]


def yaml_values(text: Column) -> Column:
    """An array of (key, value) of a small YAML text: dotted paths of the keys that have a value on their line.

    A fold over the lines keeps the keys that the next line may stand under, by indentation. Comments, list items and
    lines without a colon are passed over; one pair of quotes around a value goes. A path that is set twice is there twice.
    """
    quoted = r"""^(["'])(.*)\1$"""

    def next_line(state: Column, line: Column) -> Column:
        bare = F.trim(F.regexp_replace(line, r"(^|\s)#.*$", ""))
        deep = F.length(F.regexp_extract(line, "^ *", 0))
        key = F.trim(F.regexp_replace(F.regexp_extract(bare, r"^([^:]+):(?:\s|$)", 1), r"""^["']|["']$""", ""))
        value = F.trim(F.regexp_extract(bare, r"^[^:]+:\s+(.*)$", 1))
        value = F.regexp_replace(value, quoted, "$2")
        above = F.filter(state.above, lambda k: k.deep < deep)
        path = F.array_join(F.concat(F.transform(above, lambda k: k.key), F.array(key)), ".")
        here = F.struct(
            F.concat(above, F.array(F.struct(deep.alias("deep"), key.alias("key")))).alias("above"),
            F.when(F.regexp_extract(bare, r"^[^:]+:\s+(.*)$", 1) != "", F.concat(state.found, F.array(F.struct(path.alias("key"), value.alias("value"))))).otherwise(state.found).alias("found"),
        )
        return F.when((key == "") | bare.startswith("- "), state).otherwise(here)

    start = F.struct(F.array().cast("array<struct<deep:int,key:string>>").alias("above"), F.array().cast("array<struct<key:string,value:string>>").alias("found"))
    return F.aggregate(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", ""), "\n"), start, next_line, lambda s: s.found)


def yaml_value(text: Column, path: str) -> Column:
    """The last value of a dotted path; null where there is none."""
    mine = F.filter(yaml_values(text), lambda p: p.key == path)
    return F.get(mine, F.size(mine) - 1).value
