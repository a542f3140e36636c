"""Operator 6 [native]: chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted by (turn, role, text), adjacent turns of
one role are merged into one message, and the messages are concatenated:

    <|turn|>role<|text|>text<|part|>text<|end|>

A message has one <|part|> between its merged texts. Texts and roles are escaped: where a control
string (the template's own, or one of the other listed templates') stands, a backslash goes after
its first character, behind any backslashes that are there already; removing one backslash undoes
it. So no control string of a text survives, and reading back gives the exact turns.

Null text or role: empty. Null turn: first. A null conversation id is a conversation of its own.
Ties and repeated rows are all kept, in the order of role and text. Empty tables give no rows.
Extra columns are left out of the result, so their names cannot clash. A conversation is one
output row, so its turns meet in one task; different conversations never do. Work and memory are linear
in the turns of a conversation: places are running sums, not arrays that grow turn by turn.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    turn: str = "<|turn|>"
    text: str = "<|text|>"
    part: str = "<|part|>"
    end: str = "<|end|>"
    #: Openings of control strings of common chat templates, each split after its first character.
    first: tuple[str, ...] = ("<", "[")
    rest: tuple[str, ...] = ("|", "s>", "/s>", "<SYS>>", "</SYS>>", "INST]", "/INST]")

    @property
    def _heads(self) -> str:
        return "([" + "".join(re.escape(x) for x in self.first) + "])"

    @property
    def _tails(self) -> str:
        return "(?=" + "|".join(re.escape(x) for x in self.rest) + ")"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._heads + r"(\\*)" + self._tails, r"$1\\$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._heads + r"\\(\\*)" + self._tails, "$1$2")


DEFAULT = Template()


def format_chats(turns: DataFrame, template: Template = DEFAULT, loss_role: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: the id, `formatted`, and `loss_spans` array<struct<start long, length long>>,
    the code-point spans (from 0) of the escaped texts of loss_role inside it."""
    narrow = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # where each escaped text stands: what the template puts before it, summed up along the conversation
    along = Window.partitionBy("conv").orderBy("turn", "role", "text")
    last = F.lag("role").over(along)
    head = F.length(template.escape(F.col("role"))) + len(template.turn) + len(template.text)
    before = F.when(last.isNull(), head).when(last != F.col("role"), head + len(template.end)).otherwise(len(template.part))
    sized = narrow.select("*", before.cast("long").alias("before"), F.length(template.escape(F.col("text"))).cast("long").alias("length"))
    upto = F.sum(F.col("before") + F.col("length")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = sized.select("conv", F.struct("turn", "role", "text", (upto - F.col("length")).alias("start"), "length").alias("row"))
    got = placed.groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    numbered = F.transform("rows", lambda r, i: F.struct(i.alias("at"), r.role.alias("role")))
    begins = F.filter(numbered, lambda r: (r.at == 0) | (r.role != F.element_at("rows", F.greatest(r.at, F.lit(1))).role))
    got = got.withColumn("begins", F.transform(begins, lambda r: r.at))
    messages = F.transform(
        "begins",
        lambda at, i: F.struct(
            F.element_at("rows", at + 1).role.alias("role"),
            F.transform(F.slice("rows", at + 1, F.coalesce(F.get("begins", i + 1), F.size("rows")) - at), lambda r: template.escape(r.text)).alias("texts"),
        ),
    )
    got = got.withColumn("messages", messages)
    piece = lambda m: F.concat(F.lit(template.turn), template.escape(m.role), F.lit(template.text), F.array_join(m.texts, template.part), F.lit(template.end))
    got = got.withColumn("pieces", F.transform("messages", piece))
    spans = F.transform(F.filter("rows", lambda r: r.role == loss_role), lambda r: F.struct(r.start.alias("start"), r.length.alias("length")))
    return got.select(F.col("conv").alias(conv), F.array_join("pieces", "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame, template: Template = DEFAULT, conv: str = "conv_id") -> DataFrame:
    """The turns (role, text, unescaped, in order) and the concatenated unescaped text under the loss mask."""
    quote = lambda s: re.escape(s)
    blocks = F.split("formatted", quote(template.end))
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)
    sides = F.transform(blocks, lambda b: F.split(F.substring(b, len(template.turn) + 1, 2147483647), quote(template.text)))
    turns = F.flatten(F.transform(sides, lambda s: F.transform(F.split(s[1], quote(template.part)), lambda t: F.struct(template.unescape(s[0]).alias("role"), template.unescape(t).alias("text")))))
    loss = F.array_join(F.transform("loss_spans", lambda s: template.unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int")))), "")
    return formatted.select(F.col(f"`{conv}`"), "formatted", turns.alias("turns"), F.size(sides).cast("long").alias("n_messages"), loss.alias("loss_text"))


def digests(read: DataFrame, conv: str = "conv_id") -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        F.col(f"`{conv}`"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
