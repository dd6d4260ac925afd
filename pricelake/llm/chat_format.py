"""Chat formatting in Spark expressions: one training text and its loss mask per conversation.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are
merged into a block with array functions; blocks are concatenated. The template of a block is

    <s>ROLE\\nTEXT<n>TEXT</s>

with ``<n>`` between merged turns. Inside roles and texts ``&`` becomes ``&amp;`` and ``<`` becomes
``&lt;`` (in roles also the line feed ``&nl;``), so no text can look like a control string and the
original is read back exactly. The loss mask lists the code-point spans of the assistant's texts.

The aggregate by conversation is the one shuffle; a conversation is the unit of the result and must
fit one row. The work per conversation is linear in its text but for the mask, whose spans are found
by code point: that grows with spans times length.

Defined results: null text or role counts as empty; a null turn sorts first; turns that share a
number are ordered by role, then text; repeated rows are turns of their own; a null conversation id
is a conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import col

ASSISTANT = "assistant"
_OPEN, _NEXT, _CLOSE = "<s>", "<n>", "</s>"


def _replace(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(text: Column) -> Column:
    return _replace(text, ("&", "&amp;"), ("<", "&lt;"))


def unescape(text: Column) -> Column:
    return _replace(text, ("&lt;", "<"), ("&amp;", "&"))


def _blocks(turns: Column) -> Column:
    """Adjacent turns of one role as a struct of the escaped role and texts."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    # a one-element array binds the starts, so that they are computed once
    return F.flatten(F.transform(F.array(starts), lambda at: F.transform(at, lambda s, k: F.struct(
        _replace(escape(F.get(turns, s)["role"]), ("\n", "&nl;")).alias("role"),
        F.transform(F.slice(turns, s + 1, F.coalesce(F.get(at, k + 1), n) - s), lambda t: escape(t["text"])).alias("texts")))))


def _block_text(b: Column) -> Column:
    return F.concat(F.lit(_OPEN), b["role"], F.lit("\n"), F.array_join(b["texts"], _NEXT), F.lit(_CLOSE))


def _spans(blocks: Column) -> Column:
    """(start, length) of every assistant text, in code points from 0."""
    empty = F.array().cast("array<struct<at:bigint,b:struct<role:string,texts:array<string>>>>")
    placed = F.aggregate(blocks, F.struct(F.lit(0).cast("bigint").alias("pos"), empty.alias("out")), lambda a, b: F.struct(
        (a["pos"] + F.char_length(_block_text(b))).alias("pos"),
        F.when(b["role"] == ASSISTANT, F.concat(a["out"], F.array(F.struct(
            (a["pos"] + F.char_length(b["role"]) + len(_OPEN) + 1).alias("at"), b.alias("b"))))).otherwise(a["out"]).alias("out")))
    before = lambda texts, j: F.aggregate(F.slice(texts, 1, j), F.lit(0).cast("bigint"), lambda s, t: s + F.char_length(t) + len(_NEXT))
    return F.flatten(F.transform(placed["out"], lambda x: F.transform(x["b"]["texts"], lambda t, j: F.struct(
        (x["at"] + before(x["b"]["texts"], j)).alias("start"), F.char_length(t).cast("bigint").alias("length")))))


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, loss_mask per conversation."""
    empty = F.lit("")
    rows = turns.select(col(conv).alias("conv_id"), F.struct(
        col(turn).alias("turn"), F.coalesce(col(role).cast("string"), empty).alias("role"),
        F.coalesce(col(text).cast("string"), empty).alias("text")).alias("t"))
    blocks = (rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
              .select("conv_id", _blocks(F.col("turns")).alias("blocks")))
    return blocks.select("conv_id", F.array_join(F.transform("blocks", _block_text), "").alias("formatted"),
                         _spans(F.col("blocks")).alias("loss_mask"))


def parsed(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    def turns(block: Column) -> Column:
        role = F.substring_index(F.substr(block, F.lit(len(_OPEN) + 1)), "\n", 1)
        rest = F.substr(block, F.char_length(role) + len(_OPEN) + 2)
        return F.transform(F.split(rest, _NEXT), lambda t: F.struct(
            unescape(_replace(role, ("&nl;", "\n"))).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(F.filter(F.split(text, _CLOSE), lambda b: b != ""), turns))


def masked(text: Column, mask: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(text, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def digests(out: DataFrame) -> DataFrame:
    """What is read back from the formatted texts and masks."""
    read = out.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"),
                      masked(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


#: DuckDB: the digests from the rows themselves, by windows instead of arrays.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS n,
         length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&nl;')) AS r,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS same
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN same THEN 3 ELSE r + 8 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
