r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and only that
reply trainable. What follows the last reply (or a conversation without one) becomes a last example
without trainable text, so that nothing of a conversation is lost.

The template writes a turn as ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts backslashes
are doubled and a backslash is put behind the first character of every control string, which
``unescape`` undoes.

Turns are dealt by conversation, sorted, and streamed: a task holds one conversation's text at a
time and writes each example as soon as it is complete.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this and other public chat templates (fixed values). None holds another.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_OUT = "conv_id long, example long, text string, loss_start long, loss_end long, last boolean"


def escape(s: str) -> str:
    """``s`` without control strings, reversibly."""
    s = s.replace("\\", "\\\\")
    for c in CONTROLS:
        s = s.replace(c, f"{c[0]}\\{c[1:]}")
    return s


def unescape_text(s: str) -> str:
    """Undoes ``escape``."""
    for c in CONTROLS:
        s = s.replace(f"{c[0]}\\{c[1:]}", c)
    return s.replace("\\\\", "\\")


def unescape(s: Column) -> Column:
    """``unescape_text`` as a column expression."""
    for c in CONTROLS:
        s = F.replace(s, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(s, F.lit("\\\\"), F.lit("\\"))


def expand(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", flush_bytes: int = 8 << 20) -> DataFrame:
    """Examples of ``turns``: (conv_id, example from 0, text, loss_start, loss_end, last).

    The loss mask is ``text[loss_start:loss_end]`` in code points, the escaped reply; it is empty
    for a last example without reply. Turns are ordered by ``turn`` (null first), ties by role and
    text; repeated rows are turns of their own. Null texts and roles are empty; rows with a null id
    form one conversation. Other columns are ignored; an empty table gives no examples.
    """
    rows = turns.select(F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    dealt = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x")

    def run(batches):
        ready, size = [], 0
        now, past, shown, example, held, fresh = None, [], 0, 0, None, False

        def out(done):
            return pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["conv_id", "example", "text", "loss_start", "loss_end", "last"])

        def finish():
            # the conversation ends: its last example is the held one, or the turns after it
            if held is not None and not fresh:
                return [(*held, True)]
            rest = [(*held, False)] if held is not None else []
            return [*rest, (now[0], example, "".join(past), shown, shown, True)]

        for batch in batches:
            for c, r, x in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if now is None or now[0] != c:
                    if now is not None:
                        ready += finish()
                    now, past, shown, example, held, fresh = (c,), [], 0, 0, None, False
                head, body = f"{TURN}{escape(r)}{TEXT}", escape(x)
                past.append(f"{head}{body}{END}")
                if r == "assistant":
                    if held is not None:
                        ready.append((*held, False))
                    start = shown + len(head)
                    whole = "".join(past)
                    past = [whole]
                    held, fresh = (c, example, whole, start, start + len(body)), False
                    example += 1
                    size += len(whole)
                else:
                    fresh = True
                shown += len(head) + len(body) + len(END)
                if size > flush_bytes and ready:
                    yield out(ready)
                    ready, size = [], 0
        if now is not None:
            ready += finish()
        if ready:
            yield out(ready)

    return dealt.mapInArrow(run, _OUT)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples' texts alone: (conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars)."""
    turns = F.slice(F.split("text", r"<\|end\|>", -1), F.lit(1), F.size(F.split("text", r"<\|end\|>", -1)) - 1)
    sides = lambda t: F.split(F.substring(t, len(TURN) + 1, 1 << 30), r"<\|text\|>", 2)
    told = F.array_join(F.transform(turns, lambda t: F.concat(unescape(sides(t)[0]), F.lit("\n"), unescape(sides(t)[1]), F.lit("\n"))), "")
    loss = unescape(F.expr("substring(text, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))"))
    lean = examples.select("conv_id", "example", loss.alias("loss"), F.length("text").cast("long").alias("chars"), F.when(F.col("last"), F.size(turns).cast("long")).alias("n"), F.when(F.col("last"), F.sha2(told, 256)).alias("sha"))
    replies = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    whole = lean.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), replies.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def chat_query(spark, sf_dir: str) -> DataFrame:
    """op5: all conversations and one that consists of control strings, expanded and read back."""
    hard = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return read_back(expand(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)))


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(replace(text, '\', '\\')) + length('<|turn|><|text|><|end|>') + length(role)
    + (length(text) - length(replace(text, '<|', '<'))) + (length(text) - length(replace(text, '<s>', 's>'))) + (length(text) - length(replace(text, '</s>', '/s>')))
    + (length(text) - length(replace(text, '[INST]', 'INST]'))) + (length(text) - length(replace(text, '[/INST]', '/INST]')))
    + (length(text) - length(replace(text, '<<SYS>>', '<SYS>>'))) + (length(text) - length(replace(text, '<</SYS>>', '</SYS>>')))
    + (length(text) - length(replace(text, '<start_of_turn>', 'start_of_turn>'))) + (length(text) - length(replace(text, '<end_of_turn>', 'end_of_turn>'))) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM c),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto, max(i) OVER (PARTITION BY conv_id) AS n FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
