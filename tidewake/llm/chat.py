"""Chat formatting: records of many layouts become canonical turns, and turns become marked text.

DataFrame functions only. A layout is recognised by its fingerprint, the hash of its nested field
paths; the fingerprint selects a declarative mapping to an array of (role, text) turns.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.llm.common import unused

END = "</turn>"
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
#: Names of roles in other data, for callers that want them rewritten.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Top-level fields that are no part of a layout.
METADATA = ("id", "source", "lang", "meta")
#: Text escapes, in the order in which they are applied; read back in the opposite order.
ESCAPES = (("\\", "\\b"), (END, "\\t"), ("###", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))
TURNS = "array<struct<role:string,text:string>>"

#: Layouts: a DDL schema of the fields that count, and what makes turns of them: ("turns", array, role field, text field) or a list of (role, field).
LAYOUTS: dict[str, tuple[str, tuple | list]] = {
    "messages": ("messages array<struct<role:string,content:string>>", ("turns", "messages", "role", "content")),
    "turns": ("turns array<struct<role:string,text:string>>", ("turns", "turns", "role", "text")),
    "conversations": ("conversations array<struct<`from`:string,value:string>>", ("turns", "conversations", "from", "value")),
    "dialog": ("dialog array<struct<speaker:string,utterance:string>>", ("turns", "dialog", "speaker", "utterance")),
    "instruction_input": ("instruction string, input string, output string", [("system", "instruction"), ("user", "input"), ("assistant", "output")]),
    "instruction": ("instruction string, output string", [("user", "instruction"), ("assistant", "output")]),
    "prompt": ("prompt string, response string", [("user", "prompt"), ("assistant", "response")]),
    "completion": ("prompt string, completion string", [("user", "prompt"), ("assistant", "completion")]),
    "question": ("question string, answer string", [("user", "question"), ("assistant", "answer")]),
    "question_system": ("system string, question string, answer string", [("system", "system"), ("user", "question"), ("assistant", "answer")]),
}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; ``[]`` stands for an array's element."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(kind: T.StructType) -> str:
    return hashlib.sha256("\n".join(field_paths(kind)).encode()).hexdigest()


def _ddl(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def _known() -> dict[str, str]:
    """Layouts by fingerprint; a layout with a list of turns has one for the empty list too."""
    known = {fingerprint(_ddl(ddl)): name for name, (ddl, _) in LAYOUTS.items()}
    return known | {hashlib.sha256(f"{how[1]}[]?".encode()).hexdigest(): name for name, (_, how) in LAYOUTS.items() if isinstance(how, tuple)}


def json_fingerprint(record: Column) -> Column:
    """Fingerprint of each JSON record, over the paths of up to three levels of objects and arrays.

    Keys are read by ``json_object_keys``; for an array the keys of all of its elements count. Equal to
    ``fingerprint`` for the layouts here. METADATA fields at the top are left out. Null where the
    text isn't a JSON object.
    """
    keys = F.filter(F.json_object_keys(record), lambda k: ~k.isin(*METADATA))

    def under(key: Column) -> Column:
        inner = F.try_element_at(F.from_json(record, "map<string,string>"), key)
        items = F.from_json(inner, "array<string>")
        paths = F.flatten(F.transform(items, lambda x: F.when(x.startswith("{"), F.transform(F.json_object_keys(x), lambda k: F.concat(key, F.lit("[]."), k))).otherwise(F.array(F.concat(key, F.lit("[]"))))))
        listed = inner.startswith("[") & items.isNotNull()
        return F.when(listed, F.when(F.size(items) == 0, F.array(F.concat(key, F.lit("[]?")))).otherwise(F.array_distinct(paths))).otherwise(F.array(key))

    return F.sha2(F.array_join(F.array_sort(F.flatten(F.transform(keys, under))), "\n"), 256)


def _role(role: Column, aliases: dict[str, str]) -> Column:
    out = role = F.coalesce(role, F.lit(""))
    for alias, name in aliases.items():
        out = F.when(F.lower(F.trim(role)) == alias, F.lit(name)).otherwise(out)
    return out


def _turns(record: Column, how: tuple | list, aliases: dict[str, str]) -> Column:
    """Canonical turns by one mapping: null texts are empty, unset optional fields of a flat layout are left out."""
    if isinstance(how, tuple):
        _, field, role, text = how
        made = F.transform(record.getField(field), lambda t: F.struct(_role(t.getField(role), aliases).alias("role"), F.coalesce(t.getField(text), F.lit("")).alias("text")))
        return F.coalesce(made, F.array().cast(TURNS))
    made = F.array(*(F.struct(F.lit(role).alias("role"), F.coalesce(record.getField(f), F.lit("")).alias("text"), record.getField(f).isNotNull().alias("there")) for role, f in how))
    return F.transform(F.filter(made, lambda t: t.there | (t.role != "system")), lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))


def canonical_turns(df: DataFrame, record: str, to: str = "turns", aliases: dict[str, str] | None = None) -> DataFrame:
    """Adds the turns of ``record``, a struct (one layout for the table) or JSON text (a layout a row).

    A struct of an unknown layout raises ValueError; JSON text of an unknown layout, null and
    damaged text give null turns, which callers can route away; so does a list whose elements differ
    in their fields, as some of its texts would be lost. An empty list gives no turns. Roles stay as they stand unless
    ``aliases`` names others for them. A column that is called ``to`` already raises ValueError;
    others come back as they are. Rows that repeat are mapped each; an empty table stays empty.
    """
    if to.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {to} already")
    kind, known, aliases = df.schema[record].dataType, _known(), aliases or {}
    if isinstance(kind, T.StructType):
        name = known.get(fingerprint(kind))
        if name is None:
            raise ValueError(f"no mapping for a record with the paths {field_paths(kind)}")
        return df.withColumn(to, _turns(F.col(record), LAYOUTS[name][1], aliases))
    (mark,) = unused(df, "_fingerprint")
    made = F.lit(None).cast(TURNS)
    for value, name in known.items():
        made = F.when(F.col(mark) == value, _turns(F.from_json(F.col(record), _ddl(LAYOUTS[name][0])), LAYOUTS[name][1], aliases)).otherwise(made)
    return df.withColumn(mark, json_fingerprint(F.col(record))).withColumn(to, made).drop(mark)


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, escapes=ESCAPES) -> Column:
    return _replaced(text, escapes)


def unescape(text: Column, escapes=ESCAPES) -> Column:
    """A backslash in escaped text is always followed by its letter, so reading back in the opposite order is exact."""
    return _replaced(text, [(new, old) for old, new in reversed(escapes)])


def _marker(role: Column) -> Column:
    out = F.concat(F.lit("="), escape(role, ROLE_ESCAPES))
    for name, shown in ROLES.items():
        out = F.when(role == name, F.lit(shown)).otherwise(out)
    return F.concat(F.lit("### "), out, F.lit(": "))


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds ``formatted`` and ``loss``.

    formatted: ``### Role: text</turn>\\n`` per turn, texts escaped. loss: for each assistant text the
    ordinal of its turn, its place in the turn, its start in the whole text and its length, in code points.
    Null turns give nulls, no turns the empty text; texts of any length are taken whole. Columns that
    are called formatted or loss already raise ValueError, others come back as they are.
    """
    if {"formatted", "loss"} & {c.lower() for c in df.columns}:
        raise ValueError("the table has a column formatted or loss already")
    parts, sizes, starts = unused(df, "_parts", "_sizes", "_starts")
    made = F.transform(F.col(turns), lambda t: F.struct(t.role.alias("role"), _marker(t.role).alias("marker"), escape(t.text).alias("body")))
    df = df.withColumn(parts, made)
    shown = F.transform(parts, lambda p: F.concat(p.marker, p.body, F.lit(END + "\n")))
    lengths = F.transform(parts, lambda p: F.struct(p.role.alias("role"), F.length(p.marker).cast("long").alias("marker"), F.length(p.body).cast("long").alias("body")))
    # start of each turn: the running sum of sizes, carried with the list that it makes
    spans = "array<struct<turn:int,offset:long,start:long,length:long>>"
    walked = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("turn"), F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts")),
        lambda s, p: F.struct((s.turn + 1).alias("turn"), (s["at"] + p.marker + p.body + F.lit(len(END) + 1)).alias("at"), F.concat(s.starts, F.array(s["at"])).alias("starts")),
        lambda s: s.starts,
    )
    df = df.withColumns({"formatted": F.array_join(shown, ""), sizes: lengths}).withColumn(starts, walked)
    picked = F.transform(sizes, lambda p, i: F.struct(p.role.alias("role"), i.alias("turn"), p.marker.alias("offset"), (F.get(starts, i) + p.marker).alias("start"), p.body.alias("length")))
    loss = F.transform(F.filter(picked, lambda p: p.role == "assistant"), lambda p: F.struct(p.turn, p.offset, p.start, p.length)).cast(spans)
    return df.withColumn("loss", loss).drop(parts, sizes, starts)


def parse_formatted(df: DataFrame, formatted: str = "formatted", to: str = "turns") -> DataFrame:
    """The inverse of ``format_turns``: reads the turns back from the marked text."""
    pieces = F.filter(F.split(F.col(formatted), END + "\n"), lambda x: x != "")

    def turn(piece: Column) -> Column:
        at = F.locate(": ", piece)
        shown = F.substring(piece, F.lit(5), at - 5)
        role = F.when(shown.startswith("="), unescape(F.substring(shown, F.lit(2), F.length(shown)), ROLE_ESCAPES)).otherwise(F.lower(shown))
        return F.struct(role.alias("role"), unescape(F.substring(piece, at + 2, F.length(piece))).alias("text"))

    return df.withColumn(to, F.transform(pieces, turn))


def conversation_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one record a conversation, turns in order.

    Equal turn numbers are ordered by role and text, null turns come first. A conversation is one
    text in the end, so its rows meet in one place; conversations are dealt out by conv_id.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kept = rows.select(F.col("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return kept.select("conv_id", F.struct(F.transform("t", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns")).alias("record"))


def conversation_json(records: DataFrame) -> DataFrame:
    """(conv_id, record) of ``conversation_records`` as JSON text, dealt out to the four list layouts by conv_id."""
    lists = [how[1:] for _, how in LAYOUTS.values() if isinstance(how, tuple)]
    made = None
    for i, (field, role, text) in enumerate(lists):
        one = F.to_json(F.struct(F.col("record.turns").cast(f"array<struct<`{role}`:string,`{text}`:string>>").alias(field)))
        here = F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)), F.lit(len(lists))) == i
        made = F.when(here, one) if made is None else made.when(here, one)
    return records.select("conv_id", made.alias("record"))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: digests of the turns and of the text under the loss mask."""
    pieces = F.split(F.col("formatted"), END + "\n")
    masked = F.transform("loss", lambda s: unescape(F.substring(F.get("_pieces", s.turn), (s.offset + 1).cast("int"), s.length.cast("int"))))
    df = parse_formatted(formatted.withColumn("_pieces", pieces)).withColumn("_masked", F.array_join(masked, ""))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return df.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"),
        F.length("_masked").cast("long").alias("loss_chars"), F.sha2(F.encode("_masked", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
