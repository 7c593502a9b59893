"""Statistics kept up to date while responses are excluded and included again.

An edit changes flags, never cells, so what is read once stays: an index that lists, for every
distinct cell of a question, the responses that hold it. The index is cut into pages of
neighbouring response ids. An edit reads the pages of the changed responses, counts with a sign,
and adds the result to the units. The label of an option is the spelling of its earliest included
response, so every unit holds its smallest included ids (`heads`) in order; a removal falls back
to the next one. Only a unit that has lost all of them looks up further ones, page by page from
where its last one stood.

Response ids are unique within a survey. Decisions about unknown responses change nothing; of
several decisions about one response the exclusion wins; a decision without a flag is none.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.model import Survey
from tallyweave.operators.frequency import frequency
from tallyweave.operators.joins import is_small
from tallyweave.operators.units import analysed, answer_cells, with_meaning
from tallyweave.session import ensure_checkpoint_dir, pin

# A piece of the index holds the ids of one block: at most 4,096.
BLOCK_BITS = 12
PAGES = 1024
HEADS = 16
# Changes of one block are at most 4,096 ids, so this many take some 6 MB.
BROADCAST_BLOCKS = 200
# `two` tells a missing second cell from an empty one, so that units can be joined by equality.
UNIT = ["survey_id", "q_key", "raw", "two"]
INDEX = "survey_id string, q_key string, raw string, two string, block bigint, ids array<bigint>, page int"


@dataclass(frozen=True)
class Kept:
    """A survey's units with all that an edit needs; `edit` gives a new one and leaves this as it is."""

    survey: Survey
    folder: str
    first_block: int
    blocks_per_page: int
    out: DataFrame
    units: DataFrame
    heads: int

    def pages(self, condition: Column) -> DataFrame:
        return self.survey.spark.read.schema(INDEX).parquet(self.folder).where(condition)

    def page_of(self, block: Column) -> Column:
        return F.floor((block - self.first_block) / self.blocks_per_page).cast("int")


def _block(response_id: str) -> Column:
    return F.shiftright(response_id, BLOCK_BITS)


def _ids(column: str) -> Column:
    return F.coalesce(column, F.array().cast("array<bigint>"))


def _lowest(pieces: DataFrame, ids: str, most: int, name: str) -> DataFrame:
    """Each unit's smallest ids, `most` at most.

    Blocks are in order, so the first `most` blocks that hold any id suffice; each task keeps no
    more of them before the shuffle.
    """
    order = Window.partitionBy(*UNIT).orderBy("block")
    first = pieces.where(F.size(ids) > 0).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    gathered = F.flatten(F.collect_list(F.slice(F.array_sort(ids), 1, most)))
    return first.groupBy(*UNIT).agg(F.slice(F.array_sort(gathered), 1, most).alias(name))


def _live(pieces: DataFrame, out: DataFrame) -> DataFrame:
    """Pieces with their included ids."""
    joined = pieces.join(out, ["survey_id", "block"], "left")
    return joined.withColumn("live", F.array_except("ids", _ids("out"))).drop("out")


def keep(survey: Survey, pages: int = PAGES, heads: int = HEADS) -> Kept:
    """Read a survey once: index, flags and units of its analysed questions."""
    ensure_checkpoint_dir(survey.spark)
    responses = survey.responses
    ends = responses.agg(F.min(_block("response_id")), F.max(_block("response_id"))).first()
    low, high = (ends[0] or 0, ends[1] or 0)
    folder = f"{survey.spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    hidden = responses.where(~F.coalesce("included", F.lit(False)))
    out = hidden.groupBy("survey_id", _block("response_id").alias("block")).agg(F.collect_list("response_id").alias("out"))
    state = Kept(survey, folder, low, -(-(high - low + 1) // pages), pin(out), responses, heads)

    questions = analysed(survey)
    rows = [r for r in survey.rows or () if r[6] != "ignore" and r[13]]
    everyone = survey.with_(responses=responses.withColumn("included", F.lit(True)))
    cells = answer_cells(everyone, questions, rows if len({r[0] for r in survey.rows or ()}) == 1 else None)
    two = F.coalesce(F.concat(F.lit("="), F.col("raw2")), F.lit(""))
    pieces = (
        cells.withColumns({"two": two, "block": _block("response_id")})
        .groupBy(*UNIT, "block")
        .agg(F.array_sort(F.collect_list("response_id")).alias("ids"))
        .withColumn("page", state.page_of(F.col("block")))
    )
    # Ranges of ids: a page is written by few tasks, and a large page by several.
    pieces.repartitionByRange("page", "survey_id", "block").write.partitionBy("page").parquet(folder)

    live = pin(_live(state.pages(F.lit(True)), state.out).select(*UNIT, "block", "live"))
    totals = live.groupBy(*UNIT).agg(F.sum(F.size("live").cast("bigint")).alias("n"))
    units = totals.join(_lowest(live, "live", heads, "heads"), UNIT, "left").withColumn("heads", _ids("heads"))
    second = F.when(F.col("two") != "", F.expr("substring(two, 2)"))
    meant = with_meaning(units.withColumn("raw2", second), questions, survey.traits)
    return replace(state, units=pin(meant.select(*UNIT, "kind", "options", "num", "answered", "n", "heads")))


def _changes(state: Kept, decisions: DataFrame) -> DataFrame:
    """(survey_id, block, enter, leave): ids whose flag really changes."""
    one = decisions.where("included IS NOT NULL").groupBy("survey_id", F.col("response_id").cast("bigint").alias("id"))
    one = one.agg(F.min("included").alias("included"))
    blocks = one.groupBy("survey_id", _block("id").alias("block")).agg(
        F.collect_list(F.when(F.col("included"), F.col("id"))).alias("enter"),
        F.collect_list(F.when(~F.col("included"), F.col("id"))).alias("leave"),
    )
    known = blocks.join(state.out, ["survey_id", "block"], "left")
    changed = known.select(
        "survey_id", "block",
        F.array_intersect("enter", _ids("out")).alias("enter"), F.array_except("leave", _ids("out")).alias("leave"),
    )
    return pin(changed.where((F.size("enter") > 0) | (F.size("leave") > 0)))


def _refilled(state: Kept, units: DataFrame) -> DataFrame:
    """Heads for units that have included responses but know none of them any more."""
    lost = units.where((F.col("n") > 0) & (F.size("heads") == 0))
    page = state.page_of(_block("last"))
    lost = pin(lost.select(*UNIT, page.alias("from_page")))
    at, last = lost.agg(F.min("from_page")).first()[0], state.pages(F.lit(True)).agg(F.max("page")).first()[0]
    found, width = None, 1
    while at is not None and at <= last:
        pieces = state.pages(F.col("page").between(at, at + width - 1)).join(lost, UNIT, "left_semi")
        more = pin(_lowest(_live(pieces, state.out), "live", state.heads, "more"))
        found = more if found is None else found.unionByName(more)
        lost = pin(lost.join(more, UNIT, "left_anti"))
        # A page in which nobody is left says nothing about the next: twice as many are read then.
        nearest = lost.agg(F.min("from_page")).first()[0]
        at, width = (None if nearest is None else max(nearest, at + width)), 2 * width
    if found is None:
        return units.drop("last")
    return units.drop("last").join(found, UNIT, "left").withColumn("heads", F.coalesce("more", "heads")).drop("more")


def edit(state: Kept, decisions: DataFrame) -> Kept:
    """Apply decisions (survey_id, response_id, included) to the kept units."""
    changes = _changes(state, decisions)
    # At most as many pages as the index has, whatever the edit's size.
    touched = [r[0] for r in changes.select(state.page_of(F.col("block"))).distinct().collect()]
    held = F.broadcast(changes) if is_small(changes, BROADCAST_BLOCKS) else changes
    pieces = state.pages(F.col("page").isin(touched)).join(held, ["survey_id", "block"]).select(
        *UNIT, "block", F.array_intersect("ids", "enter").alias("plus"), F.array_intersect("ids", "leave").alias("minus")
    )
    pieces = pin(pieces.where((F.size("plus") > 0) | (F.size("minus") > 0)))
    by = F.size("plus").cast("bigint") - F.size("minus")
    deltas = (
        pieces.groupBy(*UNIT).agg(F.sum(by).alias("by"))
        .join(_lowest(pieces, "plus", state.heads, "plus"), UNIT, "left")
        .join(_lowest(pieces, "minus", state.heads, "minus"), UNIT, "left")
    )

    # Heads are a unit's smallest included ids. Removed ones are thus among the smallest removed
    # ids; entering ones belong there if all ids are known, or if they come before the last head.
    joined = state.units.join(deltas, UNIT, "left").withColumn("last", F.get("heads", F.size("heads") - 1))
    near = F.filter(_ids("plus"), lambda x: (F.size("heads") == F.col("n")) | (x < F.col("last")))
    now = F.slice(F.array_sort(F.array_union(F.array_except("heads", _ids("minus")), near)), 1, state.heads)
    # One after the other: beside a new `n`, the lambda above would mean that one.
    units = joined.withColumn("heads", now).withColumn("n", F.col("n") + F.coalesce("by", F.lit(0))).drop("plus", "minus", "by")
    out = state.out.join(changes, ["survey_id", "block"], "full").select(
        "survey_id", "block", F.array_union(F.array_except(_ids("out"), _ids("enter")), _ids("leave")).alias("out")
    )
    state = replace(state, out=pin(out.where(F.size("out") > 0)))
    return replace(state, units=pin(_refilled(state, pin(units))))


def kept_units(state: Kept) -> DataFrame:
    """Units as `interpreted_units` gives them for the current flags."""
    return state.units.where("n > 0").select(
        "survey_id", "q_key", "kind", "raw", "n", F.get("heads", F.lit(0)).alias("first_id"), "options", "num", "answered"
    )


def kept_frequency(state: Kept) -> DataFrame:
    """The frequency tables for the current flags, without reading a response."""
    return frequency(state.survey, kept_units(state))
