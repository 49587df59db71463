"""Chat formatting by schema fingerprints. DataFrame functions only.

Records come as variants of any shape. A record's *paths* are its field names
and, for lists of objects, ``list[].field``; those that some layout knows are
hashed to the record's fingerprint, which selects a declarative mapping to
canonical turns (role, text). Fields that no layout knows do not matter. A record
that has no layout's exact paths takes the most specific layout whose paths it has
with values, else the most specific whose paths it has; of equally specific ones
the first in ``LAYOUTS``.

A conversation is written as

    <|im_start|>role NEWLINE text<|im_end|> NEWLINE

for every turn. Inside texts and roles a backslash is written ``\\s`` and the
opening of a control string, ``<|``, is written ``<\\p``; a line break in a role
is written ``\\n``. So no text can hold a control string, and nothing is lost.
The loss mask is a list of (turn, start, length) in characters of the written
turn after its opening control string: the texts of assistants.

Defined cases: null texts and roles are empty; records of an unknown layout
have no turns and are returned with a null layout; written conversations count
them (and records with an empty list of turns) as ``unmatched``; a layout's absent texts
(no ``input``) are left out; rows that repeat a turn are turns of their own,
ordered by role and text; rows without a conversation id are one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<role:string,text:string>"

# fixed values: what other layouts call the roles
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant",
         "model": "assistant", "chatgpt": "assistant"}


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))


def _get(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, path, kind)


def _pair(record: Column, asked: str, answered: str) -> Column:
    return F.array(_turn(F.lit("user"), _get(record, f"$.{asked}")),
                   _turn(F.lit("assistant"), _get(record, f"$.{answered}")))


def _row(record: Column, text: str) -> Column:
    return F.array(_turn(_get(record, "$.role"), _get(record, f"$.{text}")))


def _listed(record: Column, name: str, role: str, text: str) -> Column:
    kind = f"array<struct<{role}:string,{text}:string>>"
    return F.transform(_get(record, f"$.{name}", kind), lambda t: _turn(t[role], t[text]))


def _instruction(record: Column, more: bool) -> Column:
    asked = _get(record, "$.instruction")
    if more:
        extra = _get(record, "$.input")
        asked = F.when(F.length(extra) > 0, F.concat_ws("\n\n", asked, extra)).otherwise(asked)
    return F.array(_turn(F.lit("user"), asked), _turn(F.lit("assistant"), _get(record, "$.output")))


#: layout -> (paths, mapping to an array of turns)
LAYOUTS = {
    "turn_text": (["role", "text"], lambda r: _row(r, "text")),
    "turn_content": (["role", "content"], lambda r: _row(r, "content")),
    "messages": (["messages[].role", "messages[].content"],
                 lambda r: _listed(r, "messages", "role", "content")),
    "conversations": (["conversations[].from", "conversations[].value"],
                      lambda r: _listed(r, "conversations", "from", "value")),
    "prompt_completion": (["prompt", "completion"], lambda r: _pair(r, "prompt", "completion")),
    "prompt_response": (["prompt", "response"], lambda r: _pair(r, "prompt", "response")),
    "question_answer": (["question", "answer"], lambda r: _pair(r, "question", "answer")),
    "instruction": (["instruction", "output"], lambda r: _instruction(r, False)),
    "instruction_input": (["instruction", "input", "output"], lambda r: _instruction(r, True)),
}
KNOWN = sorted({p for paths, _ in LAYOUTS.values() for p in paths})


def _print_of(paths: list[str]) -> Column:
    return F.xxhash64(F.lit(",".join(sorted(paths))))


def known_paths(record: Column, filled: bool = False) -> Column:
    """A record's known paths, in order; only those of fields with a value if ``filled``."""
    fields = F.map_entries(F.try_variant_get(record, "$", "map<string,variant>"))

    def paths(field: Column) -> Column:
        kind = F.schema_of_variant(field["value"])
        inner = F.regexp_extract_all(kind, F.lit(r"[<,] ?`?([A-Za-z_][A-Za-z0-9_]*)`?: "), F.lit(1))
        listed = F.transform(inner, lambda n: F.concat(field["key"], F.lit("[]."), n))
        return F.when(F.startswith(kind, F.lit("ARRAY<OBJECT<")), listed).otherwise(F.array(field["key"]))

    if filled:
        fields = F.filter(fields, lambda f: F.schema_of_variant(f["value"]) != "VOID")
    found = F.flatten(F.transform(fields, paths))
    return F.array_intersect(F.array_sort(found), F.array(*map(F.lit, KNOWN)))


def fingerprint(record: Column) -> Column:
    """The hash of a record's known paths; null for what is no object."""
    return F.xxhash64(F.array_join(known_paths(record), ","))


def _layout(record: Column, print_of: Column) -> Column:
    """The name of a record's layout, or null."""
    exact, held = F.lit(None).cast("string"), F.lit(None).cast("string")
    filled = F.lit(None).cast("string")
    # what is looked at later counts: the most specific, of these the first
    for name, (paths, _) in sorted(reversed(LAYOUTS.items()), key=lambda item: len(item[1][0])):
        wanted = F.array(*map(F.lit, paths))

        def has(found: Column, size: int = len(paths), wanted: Column = wanted) -> Column:
            return F.size(F.array_intersect(found, wanted)) == size

        exact = F.when(print_of == _print_of(paths), F.lit(name)).otherwise(exact)
        held = F.when(has(known_paths(record)), F.lit(name)).otherwise(held)
        filled = F.when(has(known_paths(record, filled=True)), F.lit(name)).otherwise(filled)
    return F.coalesce(exact, filled, held)


def to_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with layout and turns, an array of (role, text)."""
    marked = records.withColumn("_print", fingerprint(F.col(record)))
    marked = marked.withColumn("layout", _layout(F.col(record), F.col("_print")))
    turns = F.lit(None).cast(f"array<{TURN}>")
    for name, (_, mapping) in LAYOUTS.items():
        turns = F.when(F.col("layout") == name, mapping(F.col(record))).otherwise(turns)
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    turns = F.transform(turns, lambda t: _turn(
        F.coalesce(F.try_element_at(names, t["role"]), t["role"], F.lit("")),
        F.coalesce(t["text"], F.lit(""))))
    columns = [c for c in marked.columns if c not in ("_print", "layout")]
    return marked.withColumn("turns", turns).select(*columns, "layout", "turns")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # every backslash starts an escape here, so the order is no matter until the last
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def write_chats(turns: DataFrame, conversation: str, order: list[str]) -> DataFrame:
    """(conversation, formatted, loss, unmatched) from rows with role, text and the order's columns.

    A row without a role stands for a record without turns; it is only counted.
    """
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    place = Window.partitionBy(conversation).orderBy(F.col("role").isNull(), *order, "role", "text")
    written = turns.select(
        conversation, (F.row_number().over(place) - 1).alias("turn"),
        F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n")).alias("part"),
        (F.col("role") == "assistant").alias("counts"),
        (F.length(role) + 1).alias("start"), F.length(text).alias("length"))
    chats = written.groupBy(conversation).agg(F.sort_array(F.collect_list(
        F.struct("turn", "part", "counts", "start", "length"))).alias("t"),
        F.count_if(F.col("part").isNull()).alias("unmatched"))
    masked = F.transform(F.filter("t", lambda t: t["counts"]), lambda t: F.struct(
        t["turn"].alias("turn"), t["start"].alias("start"), t["length"].alias("length")))
    return chats.select(conversation, F.array_join(F.transform("t", lambda t: t["part"]), "").alias("formatted"),
                        masked.alias("loss"), "unmatched")


def read_chats(chats: DataFrame) -> DataFrame:
    """``chats`` with turns (role, text) and loss_texts, both read from formatted and loss."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - 2 - len(END))
        return _turn(unescape_role(role), unescape(body))

    read = chats.withColumn("_parts", parts)
    lost = F.transform("loss", lambda s: unescape(F.substr(
        F.get(F.col("_parts"), s["turn"]), s["start"] + 1, s["length"])))
    return read.withColumn("turns", F.transform("_parts", turn)).withColumn("loss_texts", lost).drop("_parts")


def chat_digests(chats: DataFrame, conversation: str) -> DataFrame:
    """What reading the written conversations gives, as counts and digests."""
    read = read_chats(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join("loss_texts", "")
    return read.select(
        conversation, F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def format_turn_rows(rows: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conversation, formatted, loss, unmatched) from a table of records, by way of their layouts."""
    records = rows.select(conversation, order, F.to_variant_object(
        F.struct(*[c for c in rows.columns if c not in (conversation, order)])).alias("record"))
    turns = to_turns(records).select(conversation, order, F.posexplode_outer("turns").alias("at", "said"))
    return write_chats(turns.select(conversation, order, "at", "said.*"), conversation, [order, "at"])
