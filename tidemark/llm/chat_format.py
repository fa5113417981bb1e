"""Chat formatting by a finite-state machine over roles and a declarative template.

A conversation's turns become one string. The machine walks the roles in order, says whether they are a valid
conversation, and emits segments (marks and texts) with a loss flag each. Control strings inside texts are escaped:
after the first sign of each, and before each escape sign itself, stands one more escape sign. `read_back` undoes it.

Defined results: turns go by turn, role, text; a null text or role is empty; an unknown role is written like the others,
without loss, and makes the conversation invalid; repeated rows are turns of their own; an empty table gives no rows.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """Each turn is open + role + between + text + close. moves: which roles may follow a state; a state is the last role, "" at first."""

    open: str = "<|start|>"
    between: str = "<|message|>"
    close: str = "<|end|>"
    escape: str = "\\"
    loss: tuple[str, ...] = ("assistant",)
    ends: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: Marks of other templates, which must not show up unescaped either.
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    @property
    def control(self) -> tuple[str, ...]:
        return (self.open, self.between, self.close, *self.foreign)


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def escaped(text: Column, template: Template) -> Column:
    e = template.escape
    twice = F.regexp_replace(text, F.lit(_quoted(e)), F.lit(("\\" + e) * 2))
    return F.regexp_replace(twice, F.lit(f"(?s)(?=(?:{'|'.join(map(_quoted, template.control))}))(.)"), F.lit("$1\\" + e))


def unescaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, F.lit(f"(?s){_quoted(template.escape)}(.)"), F.lit("$1"))


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """turns: conv_id, turn, role, text. Per conversation: conv_id, valid, formatted, segments (array of text, loss)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", blank("role").alias("role"), blank("text").alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    one = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = lambda t: F.array(
        one(F.concat(F.lit(template.open), escaped(t["role"], template), F.lit(template.between)), F.lit(False)),
        one(escaped(t["text"], template), t["role"].isin(*template.loss)),
        one(F.lit(template.close), F.lit(False)),
    )
    moves = F.create_map(*[F.lit(x) for state, to in template.moves.items() for x in (state, "|".join(to))])
    step = lambda s, t: F.struct(
        t["role"].alias("state"), (s["ok"] & F.coalesce(F.array_contains(F.split(moves[s["state"]], r"\|"), t["role"]), F.lit(False))).alias("ok")
    )
    walk = F.aggregate("turns", F.struct(F.lit("").alias("state"), F.lit(True).alias("ok")), step, lambda s: s["ok"] & s["state"].isin(*template.ends))
    chats = chats.select("conv_id", walk.alias("valid"), F.flatten(F.transform("turns", parts)).alias("segments"))
    return chats.select("conv_id", "valid", F.array_join("segments.text", "").alias("formatted"), "segments")


def learned(segments: Column, template: Template = Template()) -> Column:  # noqa: B008
    """The text under the loss mask, unescaped: the segments with the flag, in order, in one pass."""
    return unescaped(F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: x["text"]), ""), template)


def loss_spans(segments: Column) -> Column:
    """(start, size) in the formatted string, in code points, of each segment under the loss mask. For long conversations `learned` costs less."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,size:int>>)").alias("spans"))
    add = lambda s, x: F.struct(
        (s["at"] + F.length(x["text"])).alias("at"),
        F.when(x["loss"], F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), F.length(x["text"]).alias("size"))))).otherwise(s["spans"]).alias("spans"),
    )
    return F.aggregate(segments, zero, add, lambda s: s["spans"])


def read_back(formatted: Column, template: Template = Template()) -> Column:  # noqa: B008
    """The turns (array of role, text) that a formatted string holds."""
    turn = f"(?s){_quoted(template.open)}(.*?){_quoted(template.between)}(.*?){_quoted(template.close)}"
    roles, texts = (F.regexp_extract_all(formatted, F.lit(turn), F.lit(k)) for k in (1, 2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescaped(r, template).alias("role"), unescaped(t, template).alias("text")))
