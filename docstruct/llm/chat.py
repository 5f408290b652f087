"""Chat formatting by prefix-target expansion.

A conversation becomes one formatted stream, a marked segment for each turn, and every assistant
turn becomes an example of its own: its context is the stream up to its segment, its target is the
segment's body, and only the target is trainable. Chunks hold examples as positions in the shared stream, so
what is stored and shuffled has the length of a conversation; ``example_texts`` writes every example out, context
and target, in the task that reads it, one after the other. Its time grows with the square of a conversation.

Streams are kept in chunks of ``TURNS_PER_CHUNK`` turn numbers, each a row: a conversation
with a third of all rows is spread over many tasks. Its places are summed up over four numbers a
chunk; texts are not moved for that. Turns that share a number, or have none, share a chunk, which has to fit
a row. ``example_texts`` and ``conversation_digests`` bring a conversation's text together, since a context is one
text and a digest of it one digest: there a conversation has to fit a row, which Spark limits to 2 GB. Examples of a
long conversation are dealt to many tasks, each of which gets its stream.

The template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside roles and texts
are escaped, reversibly, with the character U+0010.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import hot_keys, key_hash, slot_many, slot_one
from ..sources.staging import stage

# The markers, and the control strings of this and other templates.
START = "<|im_start|>"
END = "<|im_end|>\n"
CONTROL = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ESC = "\x10"

ASSISTANT = "assistant"
TURNS_PER_CHUNK = 64
#: A conversation of so many examples is dealt to tasks of ``EXAMPLES_PER_SALT``: each writes a prefix out.
MIN_HOT_EXAMPLES = 1000
EXAMPLES_PER_SALT = 250
#: A stream is repeated for so many tasks at most.
MAX_STREAMS = 64


def escape(text: Column) -> Column:
    """No control string is left in the result, and ``unescape`` gives the text back.

    The escape character becomes itself and ``0``; the first character of a control string becomes
    the escape character and a digit that names it.
    """
    out = F.replace(text, F.lit(ESC), F.lit(ESC + "0"))
    for s in CONTROL:
        out = F.replace(out, F.lit(s), F.lit(ESC + ("1" if s[0] == "<" else "2") + s[1:]))
    return out


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESC + "1"), F.lit("<"))
    out = F.replace(out, F.lit(ESC + "2"), F.lit("["))
    out = F.replace(out, F.lit(ESC + "3"), F.lit("\n"))
    return F.replace(out, F.lit(ESC + "0"), F.lit(ESC))


def segment(role: Column, text: Column) -> Column:
    """A turn in the template. A role is one line, so its line feeds are escaped too."""
    name = F.replace(escape(role), F.lit("\n"), F.lit(ESC + "3"))
    return F.concat(F.lit(START), name, F.lit("\n"), escape(text), F.lit(END))


def format_chunks(turns: DataFrame, keep: Sequence[str] = ("assistant",)) -> DataFrame:
    """``conv_id, chunk, start, formatted, examples`` of ``conv_id, turn, role, text`` rows.

    ``formatted`` holds the segments of the turns with numbers in ``chunk`` in the order of turn,
    role and text (nulls first), ``start`` its place in the conversation's stream in code
    points. ``examples`` has, for every turn whose role is in ``keep``, ``turn_no`` (place in the
    conversation, from 0), ``context_end`` (the context is the stream before it),
    ``target_start`` and ``target_chars`` (the trainable part of the stream).

    A null text or role counts as empty, null turns come first, rows that repeat a turn stay and
    follow one another. A null ``conv_id`` is a conversation. No rows give no chunks.
    """
    rows = turns.select(
        turns["conv_id"].alias("conv_id"),
        turns["turn"].cast("bigint").alias("turn"),
        F.coalesce(turns["role"], F.lit("")).alias("role"),
        F.coalesce(turns["text"], F.lit("")).alias("text"),
    ).withColumn("chunk", F.floor(F.col("turn") / TURNS_PER_CHUNK))
    grouped = rows.groupBy("conv_id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    with_segments = grouped.withColumn(
        "segments",
        F.transform(
            "turns", lambda t: F.struct(t["role"].alias("role"), segment(t["role"], t["text"]).alias("s"))
        ),
    )
    # Ends of the segments within the chunk, and the chunk's place in the conversation.
    nothing = F.array().cast("array<bigint>")
    ends = F.aggregate(
        "segments",
        nothing,
        lambda a, s: F.concat(
            a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + F.length(s["s"]))
        ),
    )
    placed = with_segments.select(
        "conv_id",
        "chunk",
        "segments",
        ends.alias("ends"),
        F.array_join(F.transform("segments", lambda s: s["s"]), "").alias("formatted"),
    )
    placed = stage(
        placed.withColumn("chars", F.length("formatted").cast("bigint")).withColumn(
            "turns", F.size("segments").cast("bigint")
        ),
        "chat-chunks",
    )
    # A chunk's place in its conversation comes from four numbers a chunk; texts stay where they are.
    upto = (
        "sum({}) OVER (PARTITION BY conv_id ORDER BY chunk NULLS FIRST"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    before = placed.select(
        F.col("conv_id").alias("_conv"),
        F.col("chunk").alias("_chunk"),
        F.coalesce(F.expr(upto.format("chars")), F.lit(0).cast("bigint")).alias("start"),
        F.coalesce(F.expr(upto.format("turns")), F.lit(0).cast("bigint")).alias("first_turn"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("chunk").eqNullSafe(F.col("_chunk"))
    placed = placed.join(before, same).drop("_conv", "_chunk")

    def example(s: Column, i: Column) -> Column:
        end = F.col("start") + F.element_at("ends", i + 1)
        chars = F.length(s["s"])
        # Marker, role, line feed: what stands before the body.
        head = F.instr(s["s"], "\n")
        return F.struct(
            (F.col("first_turn") + i).alias("turn_no"),
            (end - chars).alias("context_end"),
            (end - chars + head).alias("target_start"),
            (chars - head - len(END)).cast("bigint").alias("target_chars"),
            F.array_contains(F.array(*[F.lit(k) for k in keep]), s["role"]).alias("kept"),
        )

    examples = F.filter(F.transform("segments", example), lambda e: e["kept"])
    return placed.select(
        "conv_id",
        "chunk",
        "start",
        "formatted",
        F.transform(examples, lambda e: e.dropFields("kept")).alias("examples"),
    )


def expand_examples(chunks: DataFrame) -> DataFrame:
    """One row for every kept turn: ``conv_id, turn_no, context_end, target_start, target_chars``
    and ``target``, the trainable text as it stands in the stream.

    Chunks without kept turns give no rows. An empty text is an example with an empty target; repeated turns
    are examples each; the null conversation has its own.
    """
    return chunks.select(
        "conv_id", F.explode("examples").alias("e"), "start", "formatted"
    ).select(
        "conv_id",
        "e.*",
        F.substring(
            F.col("formatted"),
            (F.col("e.target_start") - F.col("start") + 1).cast("int"),
            F.col("e.target_chars").cast("int"),
        ).alias("target"),
    )


def example_texts(
    chunks: DataFrame, min_hot: int = MIN_HOT_EXAMPLES, per_salt: int = EXAMPLES_PER_SALT
) -> DataFrame:
    """``conv_id, turn_no, context, target`` with contexts written out.

    Its size grows with the square of a conversation's turns, as written-out prefixes do. What is shuffled does not:
    targets meet the stream of their conversation, contexts are cut from it, and a task holds one stream and one
    example at a time. Conversations of over ``min_hot`` examples are spread over tasks of about ``per_salt``, or
    more where that would be over ``MAX_STREAMS``. ``chunks`` is read three times. Nulls, empty texts and repeats as
    in ``expand_examples``.
    """
    # Within a struct a null conversation equals itself.
    conv = F.struct("conv_id").alias("_conv")
    streams = chunks.groupBy("conv_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("start", "formatted"))), lambda c: c["formatted"]
            ),
            "",
        ).alias("stream")
    )
    examples = expand_examples(chunks).select("conv_id", conv, "turn_no", "target_start", "target")
    hot = hot_keys(examples.select(key_hash("_conv").alias("hash")), min_hot, per_salt)
    hot = hot.withColumn("salts", F.least("salts", F.lit(MAX_STREAMS)))
    # Dealt to a fixed number: by their bytes, which are few, all slots would be put together in one task.
    spark = chunks.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    on = ["slot", "_conv"]
    many = slot_many(examples, ["_conv"], ["turn_no"], hot).repartition(tasks, *on)
    one = slot_one(streams.select(conv, "stream"), ["_conv"], hot).repartition(tasks, *on)
    context = F.substring(F.col("stream"), F.lit(1), F.col("target_start").cast("int"))
    return many.join(one, on).select("conv_id", "turn_no", context.alias("context"), "target")


def read_turns(formatted: Column) -> Column:
    """Array of ``role, text`` read back from a chunk's formatted text."""
    parts = F.split(formatted, F.lit(r"\Q" + END.rstrip("\n") + r"\E\n"))
    bodies = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)),
    )
    return F.transform(
        bodies,
        lambda b: F.struct(
            unescape(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substring(b, F.instr(b, "\n") + 1, F.length(b))).alias("text"),
        ),
    )


def conversation_digests(chunks: DataFrame) -> DataFrame:
    """What a reader of the output finds: a row for each conversation.

    ``n_turns, n_examples, loss_chars, formatted_chars, example_chars`` (context, target and end marker of all
    examples as they are written out), and the SHA-256 of all turns and of all trainable texts. Turns are read
    back from the chunks, contexts and trainable texts from the written examples, a row each. ``chunks`` is read
    four times. Null conversations, empty texts and repeated turns count like any other; no chunks give no rows.
    """
    none = F.lit(None)
    read = chunks.select("conv_id", "chunk", "formatted", read_turns(F.col("formatted")).alias("turns")).select(
        "conv_id",
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.size("turns").cast("bigint").alias("n_turns"),
        none.cast("bigint").alias("example_chars"),
        F.struct(
            "chunk",
            F.array_join(
                F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
            ).alias("text"),
        ).alias("turns"),
        none.cast("struct<turn_no:bigint,text:string>").alias("loss"),
    )
    learned = example_texts(chunks).select(
        "conv_id",
        none.cast("bigint").alias("formatted_chars"),
        none.cast("bigint").alias("n_turns"),
        (F.length("context").cast("bigint") + F.length("target") + len(END)).alias("example_chars"),
        none.cast("struct<chunk:bigint,text:string>").alias("turns"),
        F.struct("turn_no", unescape(F.col("target")).alias("text")).alias("loss"),
    )
    pieces = F.sort_array(F.collect_list("turns")).alias("turns"), F.sort_array(F.collect_list("loss")).alias("loss")
    whole = read.unionByName(learned).groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.count("example_chars").alias("n_examples"),
        F.coalesce(F.sum("formatted_chars"), F.lit(0).cast("bigint")).alias("formatted_chars"),
        F.coalesce(F.sum("example_chars"), F.lit(0).cast("bigint")).alias("example_chars"),
        *pieces,
    )

    def joined(field: str) -> Column:
        return F.array_join(F.transform(field, lambda p: p["text"]), "")

    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(joined("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("bigint").alias("loss_chars"),
        F.sha2(joined("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
        "example_chars",
    )
