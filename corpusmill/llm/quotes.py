"""Chat formatting by quotation linking.

Messages quote each other as in mail: lines that begin with ``>``, as many times as
the quote is nested.  Quoted lines are normalised and hashed, and joined to the
message of the same conversation that said them first-hand; the message whose lines
are quoted most at the first level is the one that is answered.  A message that
quotes nothing known answers the one before it.  What comes out is every message
without its quotes, with what it answers and its place in the tree of replies.

Joins are on conversation and line hash.  A line's latest earlier speaker is found by
one ordered pass over distinct ``(conversation, hash, turn)`` rows, so a line that many
messages quote and many say forms no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.landing import land

_QUOTE = r"^(?:[ \t]*>)+"


def _level(line: Column) -> Column:
    """How often a line is quoted: the signs ``>`` before its text."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 0), r"[ \t]", ""))


def _normal(line: Column) -> Column:
    """A line without quote signs, in lower case, white space as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _QUOTE, "")), r"[ \t\r\x0b\f]+", " "))


def quoted_lines(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, hash)``: each distinct line with its quote level; lines without a sign are no evidence."""
    lines = messages.select("conv_id", "turn", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    told = lines.select("conv_id", "turn", _level(F.col("line")).alias("level"), _normal(F.col("line")).alias("said"))
    return told.where(F.col("said") != "").select("conv_id", "turn", "level", F.sha2("said", 256).alias("hash")).distinct()


def answered(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, parent_turn, n_quotes, n_linked, max_level)`` of every message."""
    lines = quoted_lines(messages)
    # What a message says itself is an origin; ties of hash are settled by the latest earlier turn.
    origin = F.when(F.col("level") == 0, F.col("turn"))
    earlier = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = lines.withColumn("source", F.last(origin, ignorenulls=True).over(earlier)).where("level > 0")
    votes = found.where("level = 1 AND source IS NOT NULL").groupBy("conv_id", "turn", "source").agg(F.count("*").alias("votes"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max_by("source", F.struct("votes", "source")).alias("quoted_turn"))
    counts = found.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"), F.count("source").alias("n_linked"), F.max("level").cast("bigint").alias("max_level")
    )
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    slim = messages.select("conv_id", "turn").withColumn("before", before)
    zero = F.lit(0).cast("bigint")
    return slim.join(parents, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "before", F.coalesce("quoted_turn", "before").alias("parent_turn"),
        F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"), F.coalesce("max_level", zero).alias("max_level"),
    )


def _depths(replies: DataFrame) -> DataFrame:
    """Adds ``depth``: how many messages stand between a message and the first one it goes back to.

    Runs of messages that each answer the one before are counted by one pass; only
    the starts of other runs are followed upwards, by pointer jumping, in rounds as
    the logarithm of the branches on a path.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    opens = (F.col("parent_turn").isNull() | (F.col("parent_turn") != F.col("before"))).cast("int")
    runs = land(
        replies.withColumn("opens", opens)
        .withColumn("run", F.sum("opens").over(order))
        .withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "run").orderBy("turn")) - 1),
        "runs",
    )
    heads = runs.where("opens = 1 AND parent_turn IS NOT NULL").select("conv_id", F.col("run").alias("child"), F.col("parent_turn").alias("turn"))
    above = runs.select("conv_id", "turn", F.col("run").alias("up"), (F.col("place") + 1).alias("steps"))
    links = land(heads.join(above, ["conv_id", "turn"]).select("conv_id", "child", "up", "steps"), "branches")
    while True:
        upper = links.select("conv_id", F.col("child").alias("up"), F.col("up").alias("top"), F.col("steps").alias("more"))
        jumped = land(
            links.join(upper, ["conv_id", "up"], "left").select(
                "conv_id", "child", F.coalesce("top", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
                F.col("top").isNotNull().alias("moved"),
            ),
            "branches",
        )
        moved = jumped.where("moved").limit(1).count()
        links = jumped.drop("moved")
        if not moved:
            break
    known = links.select("conv_id", F.col("child").alias("run"), "steps")
    return runs.join(known, ["conv_id", "run"], "left").withColumn("depth", (F.col("place") + F.coalesce("steps", F.lit(0))).cast("bigint"))


def link_conversations(messages: DataFrame, template: str = "<|{role}|>\n") -> DataFrame:
    """``(conv_id, turn, role, parent_turn, depth, reply_order, n_quotes, n_linked, max_level, text, formatted)``.

    ``text`` has no quoted lines; ``formatted`` has the role's mark before it.
    ``reply_order`` numbers a conversation by depth, then turn, so that every message
    comes after the one it answers.  Rows without conversation or turn are left out;
    of rows that repeat both, the one with the least text counts; null texts and roles
    are empty.  Other columns are ignored.
    """
    clean = (
        messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
        .where("conv_id IS NOT NULL AND turn IS NOT NULL")
        .groupBy("conv_id", "turn")
        .agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))).alias("m"))
        .select("conv_id", "turn", "m.role", "m.text")
    )
    clean = land(clean, "messages")
    placed = _depths(answered(clean)).withColumn(
        "reply_order", F.row_number().over(Window.partitionBy("conv_id").orderBy("depth", "turn")).cast("bigint")
    )
    own = F.array_join(F.filter(F.split("text", "\n"), lambda line: ~line.rlike(r"^[ \t]*>")), "\n")
    mark = F.lit(template)
    return placed.join(clean, ["conv_id", "turn"]).select(
        "conv_id", "turn", "role", "parent_turn", "depth", "reply_order", "n_quotes", "n_linked", "max_level",
        F.trim(own).alias("text"), F.concat(F.replace(mark, F.lit("{role}"), F.col("role")), F.trim(own)).alias("formatted"),
    )


# The same rows in DuckDB SQL over ``conversations``.
SQL = r"""
WITH RECURSIVE messages AS (
  SELECT conv_id, turn, min(struct_pack(text := coalesce(text, ''), role := coalesce(role, ''))) AS m
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
), lines AS (
  SELECT conv_id, turn, unnest(string_split(m.text, chr(10))) AS line FROM messages
), told AS (
  SELECT DISTINCT conv_id, turn,
         length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[ \t]', '', 'g')) AS level,
         trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '[ \t\r\x0b\f]+', ' ', 'g')) AS said
  FROM lines
), evidence AS (
  SELECT * FROM told WHERE said <> ''
), sources AS (
  SELECT q.conv_id, q.turn, q.level, q.said, max(o.turn) AS source
  FROM evidence q LEFT JOIN evidence o
    ON o.conv_id = q.conv_id AND o.said = q.said AND o.level = 0 AND o.turn < q.turn
  WHERE q.level > 0 GROUP BY ALL
), votes AS (
  SELECT conv_id, turn, source, count(*) AS votes FROM sources WHERE level = 1 AND source IS NOT NULL GROUP BY ALL
), quoted AS (
  SELECT conv_id, turn, source FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY votes DESC, source DESC) = 1
), counts AS (
  SELECT conv_id, turn, count(*) AS n_quotes, count(source) AS n_linked, max(level) AS max_level FROM sources GROUP BY ALL
), replies AS (
  SELECT m.conv_id, m.turn, m.m, coalesce(q.source, lag(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn)) AS parent_turn,
         coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, coalesce(max_level, 0) AS max_level
  FROM messages m LEFT JOIN quoted q USING (conv_id, turn) LEFT JOIN counts c USING (conv_id, turn)
), tree AS (
  SELECT conv_id, turn, 0 AS depth FROM replies WHERE parent_turn IS NULL
  UNION ALL
  SELECT r.conv_id, r.turn, t.depth + 1 FROM replies r JOIN tree t ON r.conv_id = t.conv_id AND r.parent_turn = t.turn
), shown AS (
  SELECT *, trim(array_to_string(list_filter(string_split(m.text, chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10))) AS own
  FROM replies JOIN tree USING (conv_id, turn)
)
SELECT conv_id, turn, m.role AS role, parent_turn, depth::BIGINT AS depth,
       row_number() OVER (PARTITION BY conv_id ORDER BY depth, turn) AS reply_order,
       n_quotes::BIGINT AS n_quotes, n_linked::BIGINT AS n_linked, max_level::BIGINT AS max_level,
       own AS text, '<|' || m.role || '|>' || chr(10) || own AS formatted
FROM shown
"""
