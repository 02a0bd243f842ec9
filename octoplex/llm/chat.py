r"""Chat formatting in budgeted windows. DataFrame operations only.

A turn of many tokens is cut into parts, and prefix sums of the parts' tokens choose spans: a part belongs to the span in
which its first token falls, and turns that need no cutting are never divided. Each span becomes one window: the head of
the leading system turn, then the end of the span before as history, then the span's own parts. Only the assistant parts
of a window's own span are under its loss mask, so a turn that is repeated as history is a target once.

No window has more tokens than its budget: an eighth of it is for the system turn, whose first part is repeated, an
eighth for history, five eighths for the span, and an eighth for the part that crosses the span's end.

Template: `<turn ROLE>`, a newline, the text, `</turn>`, a newline; a part after the first begins with `<more ROLE>`, and
one before the last ends with `</part>`. Repeated parts have the very same form. In roles and texts `\` is written `\b`
and `<` is written `\l` (and `>` in roles `\g`), so no control string can stand in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Tokens of a window at most.
BUDGET = 1024
#: Tokens of the frame of a part, and code points to a token.
FRAME, CHARS = 4, 4
#: Turns that are put in order in one task, by the bits of their number.
BLOCK_BITS = 8


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(">"), F.lit("\\g")) if role else out


def unescape(text: Column) -> Column:
    """Undoes escape; no escaped backslash can form another escape, as `b` is the last to go."""
    out = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def sizes(budget: int) -> tuple[int, int, int]:
    """Tokens of a part at most, of the history and of a span."""
    part = budget // 8
    if part <= FRAME:
        raise ValueError("a budget of 40 tokens at least is needed")
    return part, part, budget - 3 * part


def windows(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(conv_id, span, formatted, tokens, segments): one row for each window of each conversation.

    turns has conv_id, turn, role and text; other columns are ignored. Turns are ordered by turn, then role and text, so
    repeated rows are turns of their own. Null roles and texts count as empty, rows of a null conv_id are one
    conversation, null turns come first. Tokens are a quarter of the code points of a part, rounded up, and 4 for its
    frame; roles and escapes are not counted. segments lists the window's parts: position of the turn in the
    conversation, number of the part, whether it is the last, role, start and end of the escaped text in `formatted`
    (code points), own (else repeated) and loss.

    A conversation's turns are numbered in blocks of 256 turn numbers and then by the blocks' sums, so a long one is not
    sorted by one task.
    """
    part_tokens, history, span_tokens = sizes(budget)
    chars = (part_tokens - FRAME) * CHARS
    rows = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("conv_id"), F.lit(0)).cast("string").alias("c"), F.isnull("conv_id").alias("nameless"), F.coalesce(F.shiftright(F.col("turn").cast("bigint"), BLOCK_BITS), F.lit(-(2**62))).alias("block"),
    )
    n = F.char_length("text")
    rows = rows.withColumn("n_parts", F.greatest(F.ceil(n / chars), F.lit(1)).cast("bigint"))
    rows = rows.withColumn("tokens", F.ceil(n / CHARS).cast("bigint") + FRAME * F.col("n_parts"))
    key = ["c", "nameless", "block"]
    within = Window.partitionBy(*key).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("at", F.row_number().over(within).cast("bigint") - 1).withColumn("begin", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    sums = turns_sums(rows, key)
    rows = rows.join(sums, key)
    rows = rows.withColumn("position", F.col("at") + F.col("turns_before")).withColumn("begin", F.col("begin") + F.col("tokens_before"))
    # All parts but the last have part_tokens tokens, as chars is a multiple of CHARS.
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_parts") - 1))
    parts = rows.select("conv_id", "position", "role", "text", "n_parts", "begin", "total", k.alias("part"))
    body = F.substring("text", (F.col("part") * chars + 1).cast("int"), F.lit(chars))
    parts = parts.withColumn("start", F.col("begin") + F.col("part") * part_tokens).withColumn("body", body)
    parts = parts.withColumn("tokens", F.ceil(F.char_length("body") / CHARS).cast("bigint") + FRAME)
    own = F.floor(F.col("start") / span_tokens)
    last = F.floor((F.col("total") - 1) / span_tokens)
    # History of the next span: what starts within `history` tokens before it.
    near = F.when(F.col("start") >= (own + 1) * span_tokens - history, F.array(own, own + 1)).otherwise(F.array(own))
    system = (F.col("position") == 0) & (F.col("role") == "system") & (F.col("part") == 0)
    spans = F.when(system, F.sequence(own, F.greatest(last, own))).otherwise(near)
    copies = parts.withColumn("own_span", own).withColumn("span", F.explode(spans)).where(F.col("span") <= last)
    is_own, is_last = F.col("span") == F.col("own_span"), F.col("part") == F.col("n_parts") - 1
    head = F.concat(F.when(F.col("part") == 0, F.lit("<turn ")).otherwise(F.lit("<more ")), escape(F.col("role"), role=True), F.lit(">\n"))
    tail = F.when(is_last, F.lit("</turn>\n")).otherwise(F.lit("</part>\n"))
    piece = F.struct("position", "part", is_last.alias("last"), "role", head.alias("head"), escape(F.col("body")).alias("body"), tail.alias("tail"), is_own.alias("own"), "tokens")
    grouped = copies.groupBy("conv_id", "span").agg(F.array_sort(F.collect_list(piece)).alias("t"), F.max(is_own).alias("any_own"), F.sum("tokens").alias("tokens")).where("any_own")
    framed = grouped.withColumn("sizes", F.transform("t", lambda x: F.char_length(x["head"]) + F.char_length(x["body"]) + 8))
    framed = framed.withColumn("formatted", F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], x["tail"])), ""))
    # A window's parts are bounded by its budget, of at least 4 tokens a part, so these prefix sums stay short.
    before = lambda i: F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, s: a + s)
    segments = F.transform(
        "t",
        lambda x, i: F.struct(
            x["position"].alias("position"), x["part"].alias("part"), x["last"].alias("last"), x["role"].alias("role"),
            (before(i) + F.char_length(x["head"])).alias("start"), (before(i) + F.char_length(x["head"]) + F.char_length(x["body"])).alias("end"),
            x["own"].alias("own"), (x["own"] & (x["role"] == "assistant")).alias("loss"),
        ),
    )
    return framed.select("conv_id", "span", "formatted", "tokens", segments.alias("segments"))


def turns_sums(rows: DataFrame, key: list[str]) -> DataFrame:
    """For each block the turns and tokens of its conversation before it, and the tokens of all."""
    sums = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    order = Window.partitionBy(*key[:-1]).orderBy(key[-1])
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sums.select(*key, (F.sum("n").over(past) - F.col("n")).alias("turns_before"), (F.sum("t").over(past) - F.col("t")).alias("tokens_before"), F.sum("t").over(whole).alias("total"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, loss): each turn once, from the windows' formatted text and own segments."""
    each = formatted.select("conv_id", "formatted", F.explode("segments").alias("s")).where("s.own")
    framed = F.col("formatted").substr(F.lit(1), F.col("s.start"))
    role = unescape(F.regexp_extract(framed, _ROLE, 1))
    text = unescape(F.col("formatted").substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start")))
    parts = each.select("conv_id", F.col("s.position").alias("position"), F.struct(F.col("s.part").alias("part"), role.alias("role"), text.alias("text"), F.col("s.loss").alias("loss")).alias("p"))
    turns = parts.groupBy("conv_id", "position").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return turns.select("conv_id", "position", F.element_at("p.role", 1).alias("role"), F.array_join("p.text", "").alias("text"), F.element_at("p.loss", 1).alias("loss"))


_ROLE = r"<(?:turn|more) ([^<>]*)>\n$"


def op10_query(spark, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").union(extra)
    made = windows(turns)
    # Digests of a window's own parts, in order, then of the conversation: one row for each window is grouped.
    own = F.filter("segments", lambda s: s["own"])
    piece = lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["end"] - s["start"]))
    head = lambda s: F.when(s["part"] == 0, F.concat(unescape(F.regexp_extract(F.col("formatted").substr(F.lit(1), s["start"]), _ROLE, 1)), F.lit("\n"))).otherwise(F.lit(""))
    read = made.select(
        "conv_id", "span", F.char_length("formatted").cast("bigint").alias("chars"), F.size(F.filter(own, lambda s: s["last"])).alias("n"),
        F.array_join(F.transform(own, lambda s: F.concat(head(s), piece(s), F.when(s["last"], F.lit("\n")).otherwise(F.lit("")))), "").alias("turns"),
        F.array_join(F.transform(F.filter(own, lambda s: s["loss"]), piece), "").alias("loss"),
    )
    got = read.groupBy("conv_id").agg(F.sum("n").cast("bigint").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("span", "turns", "loss"))).alias("w"))
    loss = F.array_join("w.loss", "")
    return got.select(
        "conv_id", "n_turns", F.sha2(F.array_join("w.turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


_PART, _HISTORY, _SPAN = sizes(BUDGET)
_PART_CHARS = (_PART - FRAME) * CHARS
OP10_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
m AS (SELECT *, greatest(CAST(ceil(length(text) / {_PART_CHARS}.0) AS BIGINT), 1) AS parts FROM t),
k AS (SELECT *, row_number() OVER w - 1 AS pos, CAST(ceil(length(text) / {CHARS}.0) AS BIGINT) + {FRAME} * parts AS tok,
  CAST(sum(CAST(ceil(length(text) / {CHARS}.0) AS BIGINT) + {FRAME} * parts) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
a AS (SELECT *, max(e) OVER (PARTITION BY conv_id) AS total, unnest(range(parts)) AS part FROM k),
p AS (SELECT *, e - tok + part * {_PART} AS s, (e - tok + part * {_PART}) // {_SPAN} AS own, (total - 1) // {_SPAN} AS z, text[part * {_PART_CHARS} + 1 : (part + 1) * {_PART_CHARS}] AS body FROM a),
c AS (SELECT *, unnest(CASE WHEN pos = 0 AND role = 'system' AND part = 0 THEN range(own, greatest(z, own) + 1) WHEN s >= (own + 1) * {_SPAN} - {_HISTORY} THEN [own, own + 1] ELSE [own] END) AS span FROM p),
x AS (SELECT conv_id, span, sum(16 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + length(replace(replace(body, '\', '\b'), '<', '\l'))) AS chars
  FROM c WHERE span <= z GROUP BY 1, 2 HAVING bool_or(span = own))
SELECT k.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  any_value(f.chars) AS formatted_chars
FROM k JOIN (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS chars FROM x GROUP BY 1) f ON f.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY 1
"""
