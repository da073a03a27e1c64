"""Preference formatting: one prompt and two masked completions for a chosen and a rejected conversation.

The longest common prefix of turns (equal role and text) is rendered once as the prompt; what follows on either side is
its completion. A mask lists the spans of a completion, in code points, that bear loss: the text of assistant turns with
their end marks. Roles and other turns bear none.

Turns of both sides meet in one shuffle by pair; a pair is one row of the result, so its turns are held together, and
nothing else is. Pairs have keys of their own: a first turn that many conversations share groups nothing.

Nulls: a null role is ``unknown``, a null text empty, a null turn comes first; turns without a pair id belong to no pair and
are left out. Turns with equal numbers are ordered by role and text. Equal conversations give a prompt and two empty
completions. A side without turns gives an empty prompt. Empty tables give an empty result.
"""

from pyspark.sql import functions as F

from barwright.llm.common import let

#: The marks of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _side(turns, name):
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.where(F.col("pair_id").isNotNull()).select("pair_id", F.lit(name).alias("side"), turn.alias("t"))


def rendered(turns):
    """Text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def masked(turns):
    """Spans of the array's rendering that bear loss, as ``start:end`` joined by commas."""
    head = lambda t: F.lit(len(OPEN) + 1) + F.char_length(t["role"])
    body = lambda t: F.char_length(t["text"]) + F.lit(len(CLOSE))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(a, t):
        s = a["at"] + head(t)
        span = F.concat_ws(":", s.cast("string"), (s + body(t)).cast("string"))
        return F.struct((s + body(t) + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))
    return F.array_join(F.aggregate(turns, start, step, lambda a: a["spans"]), ",")


def preferences(chosen, rejected):
    """One row per pair from turns(pair_id, turn, role, text) of either side."""
    both = _side(chosen, "chosen").unionByName(_side(rejected, "rejected"))
    of = lambda name: F.sort_array(F.collect_list(F.when(F.col("side") == name, F.col("t"))))
    p = both.groupBy("pair_id").agg(of("chosen").alias("c"), of("rejected").alias("r"))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    p = p.withColumn("common", F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int"))
    rest = lambda c: F.slice(c, F.col("common") + 1, F.greatest(F.size(c) - F.col("common"), F.lit(0)))
    out = p.select("pair_id", "common", F.slice("c", F.lit(1), F.col("common")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return out.select("pair_id", F.col("common").cast("long").alias("prompt_turns"), rendered(F.col("p")).alias("prompt"),
                      rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"),
                      let(F.col("c"), masked).alias("chosen_mask"), let(F.col("r"), masked).alias("rejected_mask"))


def with_rival_reply(conversations):
    """Turns of a rejected side: each conversation with its last assistant turn answered by its neighbour.

    Neighbours are conversations 2k and 2k+1; without a reply of the neighbour the turn is left out.
    """
    c = conversations.select("conv_id", "turn", "role", "text")
    last = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("m"))
    own = last.select(F.col("conv_id").alias("_c"), F.col("m.turn").alias("_turn"))
    rival = last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("_r"), F.col("m.text").alias("_text"), F.lit(True).alias("_there"))
    t = c.join(own, F.col("conv_id") == F.col("_c"), "left").join(rival, F.col("conv_id") == F.col("_r"), "left")
    mine = (F.col("role") == "assistant") & F.col("turn").eqNullSafe(F.col("_turn"))
    mine = F.coalesce(mine & F.col("_c").isNotNull(), F.lit(False))
    t = t.where(~mine | F.col("_there"))
    return t.select("conv_id", "turn", "role", F.when(mine, F.col("_text")).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir):
    """Every conversation as chosen, against itself with the neighbour's last reply as rejected."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = lambda t: t.withColumnRenamed("conv_id", "pair_id")
    return preferences(name(c.select("conv_id", "turn", "role", "text")), name(with_rival_reply(c)))


SQL = """
WITH last AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
reply AS (SELECT c.conv_id, c.text FROM conversations c JOIN last l ON c.conv_id = l.conv_id AND c.turn = l.turn WHERE c.role = 'assistant'),
rej AS (
  SELECT c.conv_id, c.turn, c.role, CASE WHEN l.turn IS NOT NULL THEN r.text ELSE c.text END AS text
  FROM conversations c LEFT JOIN last l ON c.conv_id = l.conv_id AND c.turn = l.turn AND c.role = 'assistant'
  LEFT JOIN reply r ON r.conv_id = xor(c.conv_id, 1) WHERE l.turn IS NULL OR r.text IS NOT NULL),
a AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations),
b AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM rej),
ab AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.pos, b.pos) AS pos, (a.role = b.role AND a.text = b.text) IS TRUE AS same
       FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.pos = b.pos),
common AS (SELECT conv_id, coalesce(min(pos) FILTER (NOT same) - 1, max(pos)) AS k FROM ab GROUP BY conv_id),
said AS (SELECT 'c' AS side, * FROM a UNION ALL SELECT 'r', * FROM b),
shown AS (
  SELECT s.*, k, pos <= k AS shared, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS body FROM said s JOIN common USING (conv_id)),
placed AS (
  SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY conv_id, side, shared ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 13 + length(role) AS s FROM shown),
spans AS (SELECT *, s::BIGINT::VARCHAR || ':' || (s + length(text) + 10)::BIGINT::VARCHAR AS span FROM placed)
SELECT conv_id AS pair_id, max(k)::BIGINT AS prompt_turns,
  coalesce(string_agg(body, '' ORDER BY pos) FILTER (side = 'c' AND shared), '') AS prompt,
  coalesce(string_agg(body, '' ORDER BY pos) FILTER (side = 'c' AND NOT shared), '') AS chosen,
  coalesce(string_agg(body, '' ORDER BY pos) FILTER (side = 'r' AND NOT shared), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 'c' AND NOT shared AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 'r' AND NOT shared AND role = 'assistant'), '') AS rejected_mask
FROM spans GROUP BY conv_id
"""
