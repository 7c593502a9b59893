"""Line dedup: winnowing over line hashes, and deletion of runs of lines seen before.

A document's lines are its non-blank lines, trimmed, in order. A run of `run` consecutive lines
that also starts at an earlier place (smaller document, or earlier in the same one) is deleted;
overlapping runs count, and all runs are judged on the input. Of every `run` consecutive line
hashes the smallest is kept as a fingerprint, so equal runs have an equal fingerprint at the same
place. Fingerprints are joined by value; where one occurs twice, its place is extended both ways
to all runs around it, and equal runs are compared by two 64-bit hashes of their lines. Only the
earliest place of a run stays. With `alone`, a line of at least so many words is a run by itself:
it is deleted wherever it is not at its earliest place, whatever its neighbours are.

Counts and smallest places are sums that Spark combines before its shuffles, so a line that a
third of all documents share is one row per task. A text is only moved to the task that deletes
its lines.

Null or empty texts have no lines. Rows with one id and equal texts are one document: all of them
are changed alike. Rows with one id and different texts are ordered by a hash of the text. A null
id sorts first. Further columns are kept, whatever their names are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyweave.llm.common import BYTE_VALUES, SPACE, free_name, runs, slices, span_hashes
from tallyweave.session import pin

RUN = 2
# Words that make a single line a run, where that is asked for.
LONG_LINE = 50
_TRIMMED = b" \t\x0b\x0c\r"


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _line_batches(run: int, alone: int | None):
    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column("text")):
                starts, ends, _ = runs(data != 10, offsets)
                words, word_ends, _ = runs(~SPACE[data], offsets)
                low, high = np.searchsorted(words, starts), np.searchsorted(words, ends)
                filled = high > low
                long = (high - low)[filled] >= alone if alone else np.zeros(int(filled.sum()), bool)
                # From the first word of the line to the end of its last.
                starts, ends = words[low[filled]], word_ends[high[filled] - 1]
                bounds = np.searchsorted(starts, offsets)
                rows = np.repeat(np.arange(end - first), np.diff(bounds))
                a, b = (span_hashes(v[data], starts, ends) for v in BYTE_VALUES)
                at = np.arange(len(a))
                whole = np.flatnonzero(at + run <= bounds[1:][rows]) if len(a) else at
                chosen = np.zeros(len(a), bool)
                if len(whole):
                    inside = np.lib.stride_tricks.sliding_window_view(a, run)[whole]
                    chosen[whole + inside.argmin(1)] = True
                runs_a, runs_b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
                runs_a[whole], runs_b[whole] = span_hashes(a, whole, whole + run), span_hashes(b, whole, whole + run)
                starting = np.zeros(len(a), bool)
                starting[whole] = True
                taken = pa.array(rows)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(taken),
                        part.column("text_key").take(taken),
                        pa.array(at - bounds[:-1][rows] if len(a) else at),
                        pa.array(a.view(np.int64)),
                        pa.array(chosen),
                        pa.array(starting),
                        pa.array(runs_a.view(np.int64)),
                        pa.array(runs_b.view(np.int64)),
                        pa.array(b.view(np.int64), mask=~long),
                    ],
                    ["doc_id", "text_key", "line", "hash", "chosen", "starts", "run_a", "run_b", "long_b"],
                )

    return batches_of


def later_lines(docs: DataFrame, run: int = RUN, alone: int | None = None) -> DataFrame:
    """doc_id, text_key, line (number among the non-blank ones) of every line to delete."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_key().alias("text_key"), "text")
    schema = (
        "doc_id bigint, text_key bigint, line bigint, hash bigint, chosen boolean, starts boolean, run_a bigint, run_b bigint, "
        "long_b bigint"
    )
    lines = pin(rows.mapInArrow(_line_batches(run, alone), schema))
    prints = lines.where("chosen").select("doc_id", "text_key", "line", "hash")
    place = F.struct("doc_id", "text_key", "line")
    shared = prints.groupBy("hash").agg(F.min(place).alias("one"), F.max(place).alias("other")).where("one <> other").select("hash")
    met = prints.join(shared, "hash")
    around = F.explode(F.sequence(F.col("line") - (run - 1), F.col("line")))
    around = met.select("doc_id", "text_key", around.alias("line")).where("line >= 0").distinct()
    own = [F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in ("doc_id", "text_key", "line")]
    found = around.alias("r").join(lines.where("starts").alias("l"), own)
    found = found.select("l.doc_id", "l.text_key", "l.line", "l.run_a", "l.run_b").distinct()
    earliest = found.groupBy("run_a", "run_b").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    later = found.join(earliest, ["run_a", "run_b"]).where(place != F.col("first"))
    deleted = later.select("doc_id", "text_key", F.explode(F.sequence(F.col("line"), F.col("line") + (run - 1))).alias("line"))
    if alone:
        single = lines.where("long_b IS NOT NULL").select("doc_id", "text_key", "line", "hash", "long_b")
        earliest = single.groupBy("hash", "long_b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        again = single.join(earliest.where("first <> last").drop("last"), ["hash", "long_b"]).where(place != F.col("first"))
        deleted = deleted.unionByName(again.select("doc_id", "text_key", "line"))
    return deleted.distinct()


def _delete_batches(names: list[str], schema: pa.Schema):
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = batch.column(at), batch.column(len(names))
            made, totals, gone = [], [], []
            for i in range(len(texts)):
                text, drop = texts[i].as_py(), drops[i].as_py()
                lines = (text or "").encode().split(b"\n")
                filled = [k for k, line in enumerate(lines) if line.strip(_TRIMMED)]
                totals.append(len(filled))
                gone.append(len(drop or ()))
                if drop:
                    out = {filled[k] for k in drop}
                    text = b"\n".join(line for k, line in enumerate(lines) if k not in out).decode()
                made.append(text)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(made, schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(gone, pa.int64())], schema=schema)

    return run


def deduplicate(docs: DataFrame, run: int = RUN, alone: int | None = None) -> tuple[DataFrame, str, str]:
    """docs with repeated runs deleted from text; names of the counts of lines and of deleted ones."""
    doc, key, gone = (free_name(docs, name) for name in ("line_doc", "line_key", "line_gone"))
    total, removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    deleted = later_lines(docs, run, alone).groupBy("doc_id", "text_key").agg(F.collect_set("line").alias(gone))
    deleted = deleted.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), gone)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)) & (_text_key() == F.col(key))
    joined = docs.join(deleted, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], gone)
    fields = joined.drop(gone).schema.add(total, "long").add(removed, "long")
    return joined.mapInArrow(_delete_batches(docs.columns, to_arrow_schema(fields)), fields), total, removed


def clean(docs: DataFrame, run: int = RUN, alone: int | None = None) -> DataFrame:
    """docs without repeated runs of lines; rows that lose all of their lines go."""
    left, total, removed = deduplicate(docs, run, alone)
    left = left.where((F.col(total) == 0) | (F.col(removed) < F.col(total)))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars, kept_sha256 of every row."""
    text = F.coalesce("text", F.lit(""))
    left, total, removed = deduplicate(docs.select("doc_id", "text"), run)
    return left.select(
        "doc_id", F.col(total).alias("n_lines"), F.col(removed).alias("n_removed"),
        F.length(text).cast("bigint").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
trimmed AS (
  SELECT doc_id, pos, raw, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM raw),
numbered AS (
  SELECT doc_id, pos, line, row_number() OVER w AS i, lead(line) OVER w AS next FROM trimmed WHERE line <> ''
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) AS k
    FROM numbered WHERE next IS NOT NULL) WHERE k > 1),
gone AS (
  SELECT DISTINCT n.doc_id, n.pos FROM numbered n JOIN later l ON n.doc_id = l.doc_id AND n.i IN (l.i, l.i + 1)),
kept AS (
  SELECT t.doc_id, string_agg(CASE WHEN g.pos IS NULL THEN t.raw END, chr(10) ORDER BY t.pos) AS text,
    count(*) FILTER (t.line <> '') AS n_lines, count(g.pos) AS n_removed
  FROM trimmed t LEFT JOIN gone g USING (doc_id, pos) GROUP BY t.doc_id)
SELECT doc_id, n_lines, n_removed, length(coalesce(text, '')) AS kept_chars, sha256(coalesce(text, '')) AS kept_sha256 FROM kept
"""
