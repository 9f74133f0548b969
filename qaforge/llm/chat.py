"""Chat formatting with Spark expressions only.

Turn structs are collected and sorted, adjacent turns of one role become one block by array aggregation, and the blocks
are concatenated. Control strings inside texts are escaped, so the output can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

#: Opening and closing mark of each role's blocks. Any other role's name stands between OTHER[0] and OTHER[1].
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[:]", "[/ROLE]")
#: Between the turns of one block.
JOIN = "[+]"

# A mark is a bracket, a body and a closing bracket. In a text a backslash goes behind the bracket; a string that has
# backslashes there already gets one more, which makes the escape reversible.
_BODY = r"((?:/?(?:SYS|INST|ROLE)|\+|:)\]|/?s>)"
_BLOCK = r"(?s)(\[SYS\]|\[INST\]|<s>|\[ROLE\].*?\[:\])(.*?)(?:\[/SYS\]|\[/INST\]|</s>|\[/ROLE\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\[<])(\\*)" + _BODY, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\[<])\\(\\*)" + _BODY, "$1$2$3")


def _opening(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]))
    for name, (mark, _) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(OTHER[2])
    for name, (_, mark) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans of each conversation of turns (conv_id, turn, role, text).

    Turns are ordered by turn number, then role, then text; a null turn number comes first and repeated rows stay. A null
    text or role is empty. Rows with a null conv_id form a conversation of their own. Other columns are not looked at. An
    empty table gives an empty one. A conversation is one output row and so must fit in memory (half a thousand million code
    points at most); the work is linear in its turns.

    loss_spans has, for each block of the assistant in order, the begin and end (code points, end excluded) of each of its
    texts in `formatted`, as escaped there; marks are not under the loss.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Where a block begins: the first turn, and each turn whose role is not the one before.
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"]))
    marked = sorted_turns.withColumn("begins", begins)
    size = lambda k: F.coalesce(F.try_element_at("begins", k + 2), F.size("turns")) - F.col("begins")[k]
    merged = F.transform(F.sequence(F.lit(0), F.size("begins") - 1), lambda k: F.struct(F.col("turns")[F.col("begins")[k]]["role"].alias("role"), F.transform(F.slice("turns", F.col("begins")[k] + 1, size(k)), lambda t: escape(t["text"])).alias("texts")))
    blocks = marked.select("conv_id", merged.alias("blocks"))
    as_text = F.array_join(F.transform("blocks", lambda b: F.concat(_opening(b["role"]), F.array_join(b["texts"], JOIN), _closing(b["role"]))), "")
    spans = _loss_spans(sorted_turns).withColumnRenamed("conv_id", "_of")
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    formatted = blocks.select("conv_id", as_text.alias("formatted"))
    return formatted.join(spans, F.col("conv_id").eqNullSafe(F.col("_of")), "left").select("conv_id", "formatted", F.coalesce("loss_spans", none).alias("loss_spans"))


def _loss_spans(sorted_turns: DataFrame) -> DataFrame:
    """conv_id and loss_spans of conversations (conv_id, turns) that have the assistant's texts: running sums of lengths over the
    turns, so the work is linear in them. Conversations are dealt by conv_id already and are not moved again."""
    turns = sorted_turns.select("conv_id", F.posexplode("turns").alias("place", "t"))
    order = Window.partitionBy("conv_id").orderBy("place")
    role, long = F.col("t.role"), lambda c: F.length(c).cast("long")
    changes = lambda other: F.coalesce(role != other.over(order), F.lit(True))
    sized = turns.select(
        "conv_id",
        "place",
        role.alias("role"),
        F.when(changes(F.lag(role)), long(_opening(role))).otherwise(len(JOIN)).alias("lead"),
        long(escape(F.col("t.text"))).alias("own"),
        F.when(changes(F.lead(role)), long(_closing(role))).otherwise(0).alias("tail"),
    )
    before = F.sum(F.col("lead") + F.col("own") + F.col("tail")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begin = F.coalesce(before, F.lit(0)) + F.col("lead")
    spans = sized.withColumn("begin", begin).where("role = 'assistant'").select("conv_id", F.struct("begin", (F.col("begin") + F.col("own")).alias("end")).alias("span"))
    return spans.groupBy("conv_id").agg(F.sort_array(F.collect_list("span")).alias("loss_spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """formatted (any columns, and formatted) with `turns`, an array of (role, text) read back from the output text.

    A column of that name is replaced, all others and all rows stay, repeated ones too. A null text has null turns, and an
    empty one none. Texts that `format_conversations` has not made give what blocks they hold.
    """
    opens = F.regexp_extract_all("formatted", F.lit(_BLOCK), 1)
    bodies = F.regexp_extract_all("formatted", F.lit(_BLOCK), 2)

    def role(mark: Column) -> Column:
        out = unescape(mark.substr(F.lit(len(OTHER[0]) + 1), F.length(mark) - len(OTHER[0]) - len(OTHER[1])))
        for name, (opening, _) in MARKS.items():
            out = F.when(mark == opening, F.lit(name)).otherwise(out)
        return out

    blocks = F.transform(F.arrays_zip(opens.alias("mark"), bodies.alias("body")), lambda b: F.transform(F.split(b["body"], r"\[\+\]"), lambda t: F.struct(role(b["mark"]).alias("role"), unescape(t).alias("text"))))
    return formatted.withColumn("turns", F.flatten(blocks))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped; null for a null text.

    A string's characters are found by counting from its start. In four bytes each they are found at once, so the work is
    linear however many spans there are. A letter put before each slice keeps a U+FEFF at its start from being taken for a
    byte order mark.
    """
    letter = F.encode(F.lit("x"), "UTF-32")
    cut = lambda wide, s: F.substring(wide, (4 * s["begin"] + 1).cast("int"), (4 * (s["end"] - s["begin"])).cast("int"))
    text = lambda wide, s: unescape(F.substring(F.decode(F.concat(letter, cut(wide, s)), "UTF-32"), 2, (1 << 31) - 1))
    # As an item of a list, the text is encoded once for all spans.
    return F.transform(F.array(F.encode(formatted, "UTF-32")), lambda wide: F.array_join(F.transform(spans, lambda s: text(wide, s)), ""))[0]


def digest(formatted: DataFrame) -> DataFrame:
    """What the output (conv_id, formatted, loss_spans) says when read back: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.

    One row for each row, repeated ones and a null conv_id too; an empty text has no turns. A null text gives nulls. Other
    columns are not looked at.
    """
    read = parse(formatted.select("conv_id", "formatted", "loss_spans")).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    per_turn = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(per_turn, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation whose texts are made of control strings.
_PLANTED = "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(format_conversations(turns.unionByName(spark.sql(_PLANTED))))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens,
    regexp_replace(text, '([\[<])(\\*)((?:/?(?:SYS|INST|ROLE)|\+|:)\]|/?s>)', '\1\\\2\3', 'g') AS escaped,
    regexp_replace(role, '([\[<])(\\*)((?:/?(?:SYS|INST|ROLE)|\+|:)\]|/?s>)', '\1\\\2\3', 'g') AS name
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(escaped) + CASE WHEN NOT opens THEN 3 WHEN role = 'system' THEN 11 WHEN role = 'user' THEN 13
    WHEN role = 'assistant' THEN 7 ELSE 16 + length(name) END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
