"""Multi-party chat formatting: every dialogue from the view of every participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslab.session import settle

#: Positions of a dialogue that are rendered together; longer dialogues come in several parts.
PART_TURNS = 256
#: A part with more rows than this is cut into sections of about as many.
PART_ROWS = 4096


def _clean(text: Column) -> Column:
    """Text that can't be mistaken for a marker: ``<|`` becomes ``< |``."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                        speaker: str = "role", text: str = "text",
                        context: tuple[str, ...] = ("system",),
                        part_turns: int = PART_TURNS, part_rows: int = PART_ROWS) -> DataFrame:
    """Render each dialogue once per participant, that one as assistant, the others as named users.

    A participant is a speaker of the dialogue that is not in ``context``; context turns stay
    system turns in every view. A turn is written as ``<|system|>\\ntext<|end|>\\n``,
    ``<|user|>\\nname: text<|end|>\\n`` or ``<|assistant|>\\ntext<|end|>\\n``. The mask lists the
    spans that are learnt, ``[start, stop)`` in characters of ``rendered``: the assistant's text
    with its end marker.

    Returns ``conv_id, perspective, part, section, slice, rendered, n_turns, mask
    array<struct<start,stop>>, n_learnt``. A dialogue of more than ``part_turns`` turn numbers comes in parts by
    ``turn div part_turns``. A part of more than ``part_rows`` rows, repeats included, is cut into sections: a turn number
    belongs to section ``rows before it div part_rows``, and a turn number with more than ``part_rows`` rows of its own to
    ``ceil(rows / part_rows)`` slices of its section by the md5 of speaker and text. Ordered by part, section and
    slice, the rows of a perspective are the dialogue, and none of them grows with its length or with the rows of a turn. Other
    parts have section 0 and slice 0.

    Defined cases: a row without conversation id belongs to no dialogue; a null turn is placed
    before the first; a null or empty speaker is the participant ``unknown``; a null text is
    empty; rows equal in all four columns are one turn; equal turn numbers are ordered by slice, speaker,
    then text. A dialogue with context turns only has no perspective, hence no row. Other columns
    are ignored, whatever their names. An empty table gives no rows.

    A first pass counts rows by turn number, without texts, and stores the turn numbers of crowded parts; they meet the
    rows in a join that moves no text while they are few. One exchange moves the texts (repeats fall out before it);
    the list of participants is aggregated before its own and joined back by conversation, where a very long dialogue is
    many rows of one part each, which the adaptive skew join splits.
    """
    name = F.when(F.col(speaker).isNull() | (F.col(speaker) == ""), "unknown").otherwise(F.col(speaker))
    placed = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"), F.coalesce(F.floor(F.col(turn) / part_turns), F.lit(0)).alias("part"),
        F.col(turn).alias("turn"), name.alias("name"), _clean(F.col(text)).alias("text"))
    of_part = Window.partitionBy("conv_id", "part")
    earlier = of_part.orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    crowded = settle(
        placed.groupBy("conv_id", "part", "turn").agg(F.count("*").alias("n"))
        .withColumn("total", F.sum("n").over(of_part)).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .where(F.col("total") > part_rows)
        .select(F.col("conv_id").alias("crowded_id"), F.col("part").alias("crowded_part"), F.col("turn").alias("crowded_turn"),
                F.floor(F.col("before") / part_rows).alias("section"), F.ceil(F.col("n") / part_rows).alias("slices")),
        "crowded-turns")
    same = ((F.col("conv_id") == F.col("crowded_id")) & (F.col("part") == F.col("crowded_part"))
            & F.col("turn").eqNullSafe(F.col("crowded_turn")))
    code = F.conv(F.substring(F.md5(F.concat("name", F.lit(":"), "text")), 1, 8), 16, 10).cast("long")
    rows = placed.join(crowded, same, "left").select(
        "conv_id", "part", F.coalesce("section", F.lit(0)).alias("section"),
        F.coalesce(F.when(F.col("slices") > 1, code % F.col("slices")), F.lit(0)).alias("slice"),
        F.struct("turn", "name", "text").alias("said"))
    at = ["conv_id", "part", "section", "slice"]
    parts = rows.groupBy(*at).agg(F.sort_array(F.collect_set("said")).alias("said"))
    people = (placed.select("conv_id", F.col("name").alias("perspective"))
              .where(~F.col("perspective").isin(*context)).distinct())
    views = parts.join(people, "conv_id")

    def piece(said: Column) -> Column:
        mine = said["name"] == F.col("perspective")
        head = (F.when(said["name"].isin(*context), F.lit("<|system|>\n"))
                .when(mine, F.lit("<|assistant|>\n"))
                .otherwise(F.concat(F.lit("<|user|>\n"), _clean(said["name"]), F.lit(": "))))
        body = F.concat(said["text"], F.lit("<|end|>"))
        return F.struct(F.concat(head, body, F.lit("\n")).alias("line"), mine.alias("mine"),
                        F.length(head).alias("skip"), F.length(body).alias("long"))

    step = lambda done, p: F.struct(
        (done["at"] + F.length(p["line"])).alias("at"),
        F.when(p["mine"], F.concat(done["mask"], F.array(F.struct(
            (done["at"] + p["skip"]).alias("start"),
            (done["at"] + p["skip"] + p["long"]).alias("stop")))))
        .otherwise(done["mask"]).alias("mask"))
    start = F.struct(F.lit(0).alias("at"),
                     F.array().cast("array<struct<start:int,stop:int>>").alias("mask"))
    return (views.withColumn("pieces", F.transform("said", piece))
            .select("conv_id", "perspective", "part", "section", "slice",
                    F.array_join(F.transform("pieces", lambda p: p["line"]), "").alias("rendered"),
                    F.size("said").alias("n_turns"),
                    F.aggregate("pieces", start, step, lambda done: done["mask"]).alias("mask"))
            .withColumn("n_learnt", F.aggregate(
                "mask", F.lit(0), lambda n, m: n + m["stop"] - m["start"])))
