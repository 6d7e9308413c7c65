"""Chat formatting with typed content parts (operator 1). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of this template, and marks of others that a text must not be able to fake either.
START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>")
#: The type of a column of content parts.
PARTS = "array<struct<type:string,text:string,ref:string,tokens:int>>"


def escape(text: Column) -> Column:
    """``text`` with every backslash doubled and one put behind the first character of each control string."""
    marks = [START, END, *PLACEHOLDERS.values(), *FOREIGN]
    rest = "|".join(rf"(?<={_quoted(m[0])}){_quoted(m[1:])}" for m in marks)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(?={rest})", r"\\")


def unescape(text: Column) -> Column:
    r"""The inverse of ``escape``; ``\e``, which stands between text parts, becomes nothing."""
    return F.regexp_replace(text, r"(?s)\\(?:e|(.))", "$1")


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in text)


def visit(parts: Column) -> tuple[Column, Column]:
    """The body that content parts flatten to, and their attachments, array<struct<kind, ref, n_tokens>>.

    A text part becomes its escaped text; an image, audio or document part becomes a placeholder, and its
    reference and the tokens that the placeholder stands for are recorded in order. Parts of other types count
    as documents. Null parts, texts and token counts are empty, empty and zero.
    """
    parts = F.coalesce(parts, F.array().cast(PARTS))
    kind = lambda p: F.when(p["type"] == "text", "text").when(p["type"].isin(*PLACEHOLDERS), p["type"]).otherwise("document")

    def body(p: Column, i: Column) -> Column:
        seam = F.when((i > 0) & (F.get(parts, i - 1)["type"] == "text"), F.lit("\\e")).otherwise("")
        mark = F.element_at(F.create_map(*[F.lit(x) for pair in PLACEHOLDERS.items() for x in pair]), kind(p))
        return F.when(kind(p) == "text", F.concat(seam, escape(F.coalesce(p["text"], F.lit(""))))).otherwise(mark)

    others = F.filter(parts, lambda p: kind(p) != "text")
    attachments = F.transform(others, lambda p: F.struct(kind(p).alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).cast("bigint").alias("n_tokens")))
    return F.array_join(F.transform(parts, body), ""), attachments


def text_part(text: Column) -> Column:
    """A message of one text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("tokens")))


def format_chat(turns: DataFrame, parts: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: its id, formatted string, loss_spans array<struct<start, length>> (code points, from 0),
    attachments, expanded_tokens (those that the placeholders stand for), n_turns.

    A turn is the start mark, its role (URL-encoded), a newline, the body of its parts and the end mark with a
    newline. The spans of the bodies of roles in ``learn`` are the loss mask. The rows of a conversation are one
    output value, so they meet in one task; there is one shuffle, by conversation.

    Turns stand in order of ``turn`` (null first), ties by role and body; repeated rows are turns of their own. A
    null role is the empty role, a null conversation id is one conversation. Extra columns are ignored. An
    empty table gives no rows.
    """
    body, attachments = visit(parts)
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), body.alias("body"), attachments.alias("attached"))
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    rows = rows.withColumn("piece", F.concat(head, F.col("body"), F.lit(END + "\n")))
    order = Window.partitionBy("conv").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.length("piece")).over(order) - F.length("piece")
    rows = rows.select("conv", start.alias("start"), "piece", F.when(F.col("role").isin(*learn), F.struct((start + F.length(head)).alias("start"), F.length("body").cast("bigint").alias("length"))).alias("span"), "attached")
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("start", "piece", "span", "attached"))).alias("turns"))
    attached = F.flatten(F.col("turns.attached"))
    return whole.select(
        F.col("conv").alias(conv_col), F.array_join("turns.piece", "").alias("formatted"), F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"), attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("bigint"), lambda n, a: n + a["n_tokens"]).alias("expanded_tokens"), F.size("turns").cast("bigint").alias("n_turns"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>; placeholders stay in the text."""
    pieces = F.split(formatted, _quoted(END) + "\n", -1)
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def read(piece: Column) -> Column:
        name = F.substring_index(F.substr(piece, F.lit(len(START) + 1)), "\n", 1)
        return F.struct(F.url_decode(name).alias("role"), unescape(F.substr(piece, F.length(name) + F.lit(len(START) + 2))).alias("text"))

    return F.transform(turns, read)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
