"""Chat formatting with DataFrame expressions only.

A conversation is a group of (turn, role, text) rows.  Its turn structs are
collected and sorted, adjacent turns of one role are merged into a block, and
the blocks are concatenated::

    ### user: first text<+>second text of the same role</turn>\\n
    ### assistant: answer</turn>\\n

``### ``, ``<+>`` and ``</turn>`` are control strings.  Inside a text (or role)
each is broken by a backslash (``##\\# ``, ``<\\+>``, ``<\\/turn>``) and each
backslash is doubled, so a control string in the output is always the
template's own, and the escape is undone by dropping the first backslash of
every escaped pair.  In a role ``: `` becomes ``:\\ `` as well.

Defined results: a null text or role counts as empty; turns of equal number are
ordered by role, then text; repeated rows stay; a null ``turn`` sorts first; a
null conversation id is one conversation of its own; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

HEAD, SEP, END = "### ", "<+>", "</turn>\n"
_UNESCAPE = r"\\([\\#/+ ])"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, broken in ((HEAD, "##\\# "), ("</turn>", "<\\/turn>"), (SEP, "<\\+>")):
        out = F.replace(out, F.lit(plain), F.lit(broken))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(": "), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1")


def _blocks(turns: Column) -> Column:
    """Array of (head, parts, loss): adjacent turns of one role merged."""
    firsts = F.filter(
        F.transform(turns, lambda t, i: i),
        lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
    )

    def block(first, upto):
        turn = F.get(turns, first)
        return F.struct(
            F.concat(F.lit(HEAD), escape_role(turn["role"]), F.lit(": ")).alias("head"),
            F.transform(F.slice(turns, first + 1, upto - first), lambda t: escape(t["text"])).alias("parts"),
            turn["loss"].alias("loss"),
        )

    return let(firsts, lambda at: F.transform(at, lambda first, k: block(first, F.coalesce(F.get(at, k + 1), F.size(turns)))))


def _pieces(values: Column) -> Column:
    """An array cut into about as many arrays as each of them has elements."""
    n = F.size(values)
    step = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
    return F.when(n == 0, F.slice(F.array(values), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda c: F.slice(values, c * step + 1, step)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _sums_before(values: Column) -> Column:
    """For each element of an array of longs the sum of those before it: piece by piece, so n elements take n * sqrt(n) steps."""

    def of(pieces):
        totals = F.transform(pieces, _sum)
        return let(totals, lambda t: F.flatten(F.transform(pieces, lambda p, k: let(_sum(F.slice(t, 1, k)), lambda s: F.transform(p, lambda x, i: s + _sum(F.slice(p, 1, i)))))))

    return let(_pieces(values), of)


def _spans(blocks: Column) -> Column:
    """(start, length) of every text under the loss mask, by code points of the output."""
    long = lambda c: F.length(c).cast("long")
    size = lambda b: long(b["head"]) + _sum(F.transform(b["parts"], lambda p: long(p) + len(SEP))) + (len(END) - len(SEP))

    def of_block(b, start):
        begins = _sums_before(F.transform(b["parts"], lambda p: long(p) + len(SEP)))
        here = let(begins, lambda at: F.transform(b["parts"], lambda p, i: F.struct((start + long(b["head"]) + F.get(at, i)).alias("start"), long(p).alias("length"))))
        return F.when(b["loss"], here).otherwise(F.slice(here, 1, 0))

    return let(_sums_before(F.transform(blocks, size)), lambda at: F.flatten(F.transform(blocks, lambda b, k: of_block(b, F.get(at, k)))))


def format_chats(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    ``loss_spans`` lists the (start, length) stretches of ``formatted`` that a
    training loss covers: the texts of ``loss_roles``, without any control
    string.  One shuffle, by conversation.
    """
    rows = df.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    ).withColumn("t", F.col("t").withField("loss", F.col("t.role").isin(*loss_roles)))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def out(blocks):
        whole = F.transform(blocks, lambda b: F.concat(b["head"], F.array_join(b["parts"], SEP), F.lit(END)))
        return F.struct(F.array_join(whole, "").alias("formatted"), _spans(blocks).alias("loss_spans"))

    return turns.select("conv_id", let(_blocks(F.col("turns")), out).alias("o")).select("conv_id", "o.formatted", "o.loss_spans")


def parsed_turns(formatted: Column) -> Column:
    """The (role, text) turns, read back from the formatted string."""

    def of_block(b):
        head = F.substring_index(b, ": ", 1)
        body = F.substr(b, F.length(head) + 3)
        role = unescape(F.substr(head, F.lit(len(HEAD) + 1)))
        return F.transform(F.split(body, r"<\+>"), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    blocks = F.filter(F.split(formatted, "</turn>\n"), lambda b: b != "")
    return F.flatten(F.transform(blocks, of_block))


def masked_texts(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order.

    Positions count code points, so a stretch of spans is cut out first and its
    spans from that.
    """

    def of(spans):
        first, last = F.get(spans, F.lit(0)), F.element_at(spans, -1)
        stretch = F.substr(formatted, (first["start"] + 1).cast("int"), (last["start"] + last["length"] - first["start"]).cast("int"))
        return let(stretch, lambda x: F.transform(spans, lambda s: unescape(F.substr(x, (s["start"] - first["start"] + 1).cast("int"), s["length"].cast("int")))))

    return F.flatten(F.transform(_pieces(loss_spans), of))


def chat_digest(chats: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests read back from what ``format_chats`` made."""
    turns = parsed_turns(F.col("formatted"))
    lines = lambda ts: F.array_join(F.transform(ts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(masked_texts(F.col("formatted"), F.col("loss_spans")), "")
    return chats.select(
        "conv_id",
        let(turns, lambda ts: F.struct(F.size(ts).cast("long").alias("n"), F.sha2(lines(ts), 256).alias("sha"))).alias("t"),
        let(loss, lambda x: F.struct(F.length(x).cast("long").alias("n"), F.sha2(x, 256).alias("sha"))).alias("l"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id",
        F.col("t.n").alias("n_turns"),
        F.col("t.sha").alias("turns_sha256"),
        F.col("l.n").alias("loss_chars"),
        F.col("l.sha").alias("loss_sha256"),
        "formatted_chars",
    )
