"""Chat formatting by schema fingerprint (operator 7). DataFrame functions only.

A record is a JSON text of any layout. Its nested field paths are hashed, each for itself; the set of
hashes selects a declarative mapping, the one with most required paths of those whose paths are all
there, and further fields change nothing. The mapping names where the turns stand and turns the
record into canonical turns (role, text). Turns are then rendered with a template:

    <s>[INST]role[/INST]text</s>

Every control string starts with ``<`` or ``[``. Inside roles and texts ``^`` becomes ``^0``,
``<`` becomes ``^1`` and ``[`` becomes ``^2``, so no control string can occur there, and the
steps taken backwards give the text again.

Defined results: a null text or role is empty; a number is written out, and a text in parts is put
together; a record that is no JSON, or whose paths no mapping asks for, keeps its row with a null
layout and no turns; a conversation is handled whole up to the size that Spark's JSON values have,
and beyond it is an error; turns with the same number are
ordered by role, then text; repeated rows stay turns of their own; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping: ``paths`` must all be there; turns are a list at ``path`` or fixed fields."""

    name: str
    paths: tuple[str, ...]
    path: str | None = None
    role: str = "role"
    text: str = "content"
    fixed: tuple[tuple[str, str], ...] = ()


# The layouts known by default, and the role names that mean the same.
LAYOUTS = (
    Layout("messages", ("$.messages[0].role", "$.messages[0].content"), "$.messages"),
    Layout("conversations", ("$.conversations[0].from", "$.conversations[0].value"), "$.conversations", "from", "value"),
    Layout("instruction", ("$.instruction", "$.output"), fixed=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("instruction_input", ("$.instruction", "$.input", "$.output"), fixed=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Layout("prompt", ("$.prompt", "$.completion"), fixed=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("system_prompt", ("$.system", "$.prompt", "$.response"), fixed=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
)
ROLE_NAMES = {"human": "user", "gpt": "assistant"}


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The sorted hashes of those nested paths, of all that some layout asks for, that the record has; null if it is no JSON.

    Lists are known by their first element; value types and further fields do not count.
    """
    paths = sorted({p for x in layouts for p in x.paths})
    there = F.filter(F.array(*(F.when(F.try_variant_get(record, p, "variant").isNotNull(), F.xxhash64(F.lit(p))) for p in paths)), lambda h: h.isNotNull())
    return F.when(record.isNotNull(), F.sort_array(there))


def _text(value: Column) -> Column:
    """A value as a text: parts with texts are put together, others are written out."""
    parts = F.transform(F.try_variant_get(value, "$", "array<struct<text:string>>"), lambda p: F.coalesce(p["text"], F.lit("")))
    return F.coalesce(F.array_join(parts, ""), F.try_variant_get(value, "$", "string"), F.lit(""))


def _mapped(v: Column, layout: Layout) -> Column:
    if layout.path:
        rows = F.try_variant_get(v, layout.path, f"array<struct<`{layout.role}`:string,`{layout.text}`:variant>>")
        same = F.create_map(*(F.lit(x) for kv in ROLE_NAMES.items() for x in kv))
        role = lambda r: r["role"] if layout.role == "role" else F.coalesce(F.element_at(same, r[layout.role]), r[layout.role])
        return F.transform(rows, lambda r: F.struct(F.coalesce(role(r), F.lit("")).alias("role"), _text(r[layout.text]).alias("text")))
    return F.array(*(F.struct(F.lit(r).alias("role"), _text(F.try_variant_get(v, p, "variant")).alias("text")) for r, p in layout.fixed))


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, strict: bool = False) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns``. The layout that asks for most paths goes first. strict: what is no JSON, or too large for it, is an error."""
    v = (F.parse_json if strict else F.try_parse_json)(F.col(record))
    out = records.withColumn("fingerprint", fingerprint(v, layouts))
    name, turns = F.lit(None).cast("string"), F.from_json(F.lit("[]"), TURNS)
    for x in sorted(layouts, key=lambda x: len(x.paths)):
        asked = F.array(*(F.xxhash64(F.lit(p)) for p in x.paths))
        hit = F.size(F.array_except(asked, F.col("fingerprint"))) == 0
        name, turns = F.when(hit, x.name).otherwise(name), F.when(hit, F.coalesce(_mapped(v, x), F.from_json(F.lit("[]"), TURNS))).otherwise(turns)
    return out.withColumn("layout", name).withColumn("turns", turns)


# The template.
OPEN, AFTER_ROLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("^"), F.lit("^0")), F.lit("<"), F.lit("^1")), F.lit("["), F.lit("^2"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("^2"), F.lit("[")), F.lit("^1"), F.lit("<")), F.lit("^0"), F.lit("^"))


def format_chat(turns: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``: spans (start, length) in code points of what is learned, texts of one role."""
    pieces = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(AFTER_ROLE)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learned_role).alias("learned")))
    out = turns.withColumn("pieces", pieces)
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")

    def step(acc: Column, p: Column) -> Column:
        start, n = acc["at"] + F.length(p["head"]), F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), n.alias("length")))
        return F.struct((start + n + len(CLOSE)).alias("at"), F.when(p["learned"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    none = F.from_json(F.lit("[]"), "array<struct<start:int,length:int>>")
    mask = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return out.withColumn("formatted", formatted).withColumn("loss_mask", mask).drop("pieces")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, by its control strings alone."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    cut_at = lambda p: F.split(F.substring(p, F.lit(len(OPEN) + 1), F.length(p)), r"\[/INST\]", 2)
    return F.transform(pieces, lambda p: F.struct(unescape(cut_at(p)[0]).alias("role"), unescape(cut_at(p)[1]).alias("text")))


def read_learned(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"]))), "")


def conversation_records(rows: DataFrame) -> DataFrame:
    """One JSON record per conversation from rows by turn, in the layout that its roles allow.

    A user and an answer make an instruction record, a system text before them a prompt record,
    all else a list of messages.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: F.replace(x["role"], F.lit(","), F.lit(",,"))), ",")
    at = lambda i: F.col("t")[i]["content"]
    record = (
        F.when(roles == "user,assistant", F.to_json(F.struct(at(0).alias("instruction"), at(1).alias("output"))))
        .when(roles == "system,user,assistant", F.to_json(F.struct(at(0).alias("system"), at(1).alias("prompt"), at(2).alias("response"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))))
    )
    return convs.select("conv_id", record.alias("record"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, layout, formatted, loss_mask for every conversation of a table with rows by turn."""
    return format_chat(canonical_turns(conversation_records(rows), strict=True)).select("conv_id", "layout", "formatted", "loss_mask")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted texts, as counts and digests."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("t"), read_learned(F.col("formatted"), F.col("loss_mask")).alias("learned"))
    told = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
