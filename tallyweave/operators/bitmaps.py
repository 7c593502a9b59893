"""Cross-tabs of many pairs from a bitmap index of the responses.

The index has one bitmap per question, option and block of 32,768 response ids, and one per question
for all who answered it. It is built in a single pass over the responses, whatever the pairs are.
A cell of a pair is then the number of common bits of two bitmaps, summed over blocks; margins
come from the bitmaps of all answers. No row is made per response and pair.

Response ids are distinct within a survey. Questions with more than `most` options (a bitmap each
would hold few bits) are left to `crosstab_cube`, pair by pair; results are equal either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyweave.model import Survey
from tallyweave.operators.crosstab import (
    _NO_SECOND, _SPEC, PAIR, _options, crosstab, crosstab_cube, eligible, pair_table,
)
from tallyweave.operators.joins import BROADCAST_ROWS, dim_join, is_small
from tallyweave.operators.numeric import bin_lookup, value_counts
from tallyweave.operators.units import answer_cells, interpreted_units, with_dictionaries
from tallyweave.session import pin

MOST_OPTIONS = 1_000
BLOCK_BITS = 15
# Pairs of bitmaps handled at a time: 4 KB each.
_AT_ONCE = 1_024


def _question_options(survey: Survey, cells: DataFrame) -> DataFrame:
    """(survey_id, q_key, raw, raw2, options) of all eligible questions, each distinct cell interpreted once."""
    questions = eligible(survey.questions)
    spec = with_dictionaries(questions, survey.traits).select("survey_id", "q_key", *_SPEC)
    layout = None
    if "numeric" in survey.traits.kinds:
        values = value_counts(pin(interpreted_units(survey, kinds=("numeric",))).where("kind = 'numeric'"))
        layout = pin(bin_lookup(values, questions.select("survey_id", "q_key", "unit")))
    distinct = cells.groupBy("survey_id", "q_key", "raw", "raw2").agg(F.count(F.lit(1)).alias("n"))
    sides = [F.col(c).alias(f"{side}_{c}") for side in "rc" for c in ("raw", "raw2")]
    units = pin(distinct.select("survey_id", F.col("q_key").alias("row_key"), F.col("q_key").alias("col_key"), *sides))
    return pin(_options(units, survey, spec, layout))


def option_index(survey: Survey, cells: DataFrame, options: DataFrame) -> DataFrame:
    """(survey_id, q_key, opt, label, block, bits); a NULL option has the bits of all answers."""
    filled = cells.withColumn("raw2", F.coalesce("raw2", F.lit(_NO_SECOND)))
    count = 0 if is_small(options) else BROADCAST_ROWS + 1
    chosen = dim_join(filled, options, ["survey_id", "q_key", "raw", "raw2"], "response_id", rows=count)
    chosen = chosen.select("survey_id", "response_id", "q_key", F.inline("options").alias("opt", "label"))
    block, bit = F.shiftright("response_id", BLOCK_BITS), F.col("response_id").bitwiseAND((1 << BLOCK_BITS) - 1)
    by_option = chosen.groupBy("survey_id", "q_key", F.col("opt"), "label", block.alias("block")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    by_option = pin(by_option)
    null = F.lit(None).cast("string")
    of_all = by_option.groupBy("survey_id", "q_key", null.alias("opt"), null.alias("label"), "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return by_option.unionByName(of_all)


_KEYS = [*PAIR, "row_opt", "row_label", "col_opt", "col_label"]


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of common bits of each pair of bitmaps, and the first response that has one."""
    for batch in batches:
        for at in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(at, _AT_ONCE)
            one, two = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(part.num_rows, -1) for c in ("row_bits", "col_bits"))
            both = one & two
            n = np.bitwise_count(both).sum(1, dtype=np.int64)
            # Bit k of byte j stands for id 8 j + k of the block.
            byte = (both != 0).argmax(1)
            held = both[np.arange(len(both)), byte].astype(np.int64)
            bit = np.bitwise_count(((held & -held) - 1).astype(np.uint64))
            first = (part.column("block").to_numpy() << BLOCK_BITS) + byte * 8 + bit
            made = pa.RecordBatch.from_arrays([*[part.column(k) for k in _KEYS], pa.array(n), pa.array(first.astype(np.int64))], [*_KEYS, "n", "first_id"])
            yield made.filter(pa.array(n > 0))


def bitmap_cube(survey: Survey, pairs: DataFrame, most: int = MOST_OPTIONS) -> DataFrame:
    """As `crosstab_cube`: (pair, row_opt, row_label, col_opt, col_label, n); a NULL option is the total."""
    cells = answer_cells(survey, eligible(survey.questions))
    options = _question_options(survey, cells)
    sizes = options.select("survey_id", "q_key", F.explode("options.key").alias("opt")).distinct().groupBy("survey_id", "q_key").agg(F.count("*").alias("n"))
    many = pin(sizes.where(F.col("n") > most).select("survey_id", "q_key"))
    wide = lambda key: dim_join(pairs, many.withColumnRenamed("q_key", key), ["survey_id", key], "row_key")
    left = pin(wide("row_key").unionByName(wide("col_key")).distinct())
    few = pairs.join(left, PAIR, "left_anti")
    index = pin(option_index(survey, cells.join(F.broadcast(many), ["survey_id", "q_key"], "left_anti") if is_small(many) else cells.join(many, ["survey_id", "q_key"], "left_anti"), options))
    on = ["survey_id", "block"]
    rows = index.select(*on, F.col("q_key").alias("row_key"), F.col("opt").alias("row_opt"), F.col("label").alias("row_label"), F.col("bits").alias("row_bits"))
    cols = index.select(*on, F.col("q_key").alias("col_key"), F.col("opt").alias("col_opt"), F.col("label").alias("col_label"), F.col("bits").alias("col_bits"))
    met = dim_join(rows, few, ["survey_id", "row_key"], "block").join(cols, [*on, "col_key"])
    schema = "survey_id string, row_key string, col_key string, row_opt string, row_label string, col_opt string, col_label string, n bigint, first_id bigint"
    spelled = met.select(*_KEYS, "block", "row_bits", "col_bits").mapInArrow(_common, schema)
    cube = spelled.groupBy(*PAIR, "row_opt", "col_opt").agg(
        F.sum("n").alias("n"), F.min_by("row_label", "first_id").alias("row_label"), F.min_by("col_label", "first_id").alias("col_label")
    )
    if left.isEmpty():
        return cube
    return cube.unionByName(crosstab_cube(survey, left))


def crosstab_of_many(survey: Survey, pairs, most: int = MOST_OPTIONS) -> DataFrame:
    """The tidy cross-tab of `crosstab`, for a list or table of many pairs, by bitmaps."""
    asked = pin(pair_table(survey, pairs).select(*PAIR).distinct())
    return crosstab(survey, asked, cube=bitmap_cube(survey, asked, most))
