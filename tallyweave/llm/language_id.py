"""Language identification with a string kernel, Nyström landmarks and ridge regression.

Texts are compared by the n-grams they share: the blended-spectrum presence kernel of two texts is
the number of distinct grams of one to four characters that both have, divided by the geometric
mean of their own numbers. Characters are lower-cased; whatever is no letter counts as one blank.
A gram is named by a hash of it to a fixed number of slots.

A fixed number of learned texts are landmarks. The kernel against them, times the inverse root of
the kernel among them, gives a text's Nyström features, and a ridge regression against the rest is
fitted for every language. Both steps are linear in the row of kernel values, and these in the
text's slots, so the products K = X B and K M are taken as X (B M): a batch of presence rows times
one matrix with a column for each language. The highest value names the language.

Learning uses a bounded sample: `sample` rows over all languages, as many of each, by a hash of the
id. Its texts become bit rows of a fixed size where they lie, and are fitted in one task. Texts
that are null or hold no letter get `und` and score 0, as do all if nothing could be learned; the
others get the softmax of the values. Rows with a null id or language are not learned from; of an id's
repeated rows the smallest (language, text) is. Repeated rows are predicted each, ties go to the
smaller language. Empty tables give no rows. Further columns stay, but for those named as a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyweave.llm.common import free_name, mix, seeded
from tallyweave.operators.joins import dim_join

UNKNOWN = "und"
SLOTS = 1 << 16
# Texts whose presence rows are made at a time, and code points handled at a time.
ROWS, POINTS = 32, 1 << 20


@dataclass(frozen=True)
class Kernel:
    longest: int = 4
    # Bound of the learning sample over all languages; a text is 8 KB in it.
    sample: int = 4_000
    landmarks: int = 256
    ridge: float = 1e-4
    # How sharply values become scores.
    sharpness: float = 6.0


_FACTORS = seeded(16, 81) | np.uint64(1)
_STEP = seeded(1, 82)[0] | np.uint64(1)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _points(text: str | None) -> np.ndarray:
    """Lower-case code points, with one blank for every run of others, and one at either end."""
    found = np.frombuffer(("\n" + (text or "").lower() + "\n").encode("utf-32-le", "replace"), np.uint32)
    letter = letters()[found]
    kept = letter.copy()
    # Of a run of others the first place stays.
    kept[0] = True
    kept[1:] |= letter[:-1]
    return np.where(letter, found, 32)[kept]


def presence(texts: list[str | None], longest: int = Kernel.longest) -> tuple[np.ndarray, np.ndarray]:
    """A row of slots for each text, 1 where it has a gram; and whether it has a letter."""
    # The last row takes grams that would cross from one text to the next.
    rows = np.zeros((len(texts) + 1, SLOTS), np.float32)
    cells = rows.reshape(-1)
    points = [_points(t) for t in texts]
    lengths = np.array([len(p) for p in points], np.int64)
    values = mix(np.concatenate(points)) if points else np.zeros(0, np.uint64)
    ends, owner = np.cumsum(lengths), np.repeat(np.arange(len(texts)), lengths)
    # A very long text goes piece by piece; pieces overlap by the grams that cross their ends.
    for at in range(0, len(values), POINTS):
        piece = values[at : at + POINTS + longest - 1]
        place = owner[at : at + len(piece)] * SLOTS
        hashed = piece
        for n in range(1, longest + 1):
            if n > 1:
                hashed, place = hashed[:-1] * _STEP + piece[n - 1 :], place[:-1]
                crossing = ends - at - n + 1
                place[crossing[(crossing >= 0) & (crossing < len(place))]] = len(texts) * SLOTS
            cells[place + ((hashed * _FACTORS[n]) >> np.uint64(48)).astype(np.int64)] = 1
    wordy = lengths > 1
    # A blank alone is no text.
    rows[:-1][~wordy] = 0
    return rows[:-1], wordy


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normalised shared grams of all pairs of presence rows."""
    own = np.sqrt(np.maximum(x.sum(1), 1))[:, None] * np.sqrt(np.maximum(y.sum(1), 1))
    return (x @ y.T) / own


def fit(packed: np.ndarray, languages: np.ndarray, setting: Kernel = Kernel()) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages; landmarks (presence rows); weights of kernel values; biases.

    Presence rows come as bits, in a fixed order; landmarks are taken from the languages in turn.
    """
    rows = lambda at: np.unpackbits(packed[at], axis=1).astype(np.float32)
    names = sorted(set(languages.tolist()))
    turn = np.zeros(len(packed), np.int64)
    for name in names:
        of = np.flatnonzero(languages == name)
        turn[of] = np.arange(len(of))
    first = np.argsort(turn, kind="stable")[: setting.landmarks]
    marks = rows(first[np.unique(packed[first], axis=0, return_index=True)[1]])
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
    # Copies among the landmarks leave directions of no extent.
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    blocks = [slice(at, at + setting.landmarks) for at in range(0, len(packed), setting.landmarks)]
    features = np.concatenate([kernel(rows(at), marks).astype(float) @ root for at in blocks])
    wanted = np.where(languages[:, None] == np.array(names)[None], 1.0, -1.0)
    # Every language counts alike, whatever its number of rows; the bias is not shrunk.
    weight = np.zeros(len(packed))
    for name in names:
        weight[languages == name] = 1 / (languages == name).sum() / len(names)
    centre, level = weight @ features, weight @ wanted
    away = features - centre
    slopes = np.linalg.solve(away.T @ (away * weight[:, None]) + setting.ridge * np.eye(away.shape[1]), away.T @ ((wanted - level) * weight[:, None]))
    return names, marks, root @ slopes, level - centre @ slopes


@dataclass(frozen=True)
class Model:
    languages: list[str]
    slots: np.ndarray  # landmarks' slots times their weights, by language
    bias: np.ndarray

    def values(self, rows: np.ndarray) -> np.ndarray:
        return (rows @ self.slots) / np.sqrt(np.maximum(rows.sum(1), 1))[:, None] + self.bias


def _sample_rows(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows, wordy = presence(part.column("text").to_pylist(), longest)
                bits = pa.array([r.tobytes() for r in np.packbits(rows > 0, axis=1)], pa.binary())
                found = pa.RecordBatch.from_arrays([part.column("rank"), part.column("lang"), bits], ["rank", "lang", "bits"])
                yield found.filter(pa.array(wordy))

    return run


def _fit_sample(setting: Kernel):
    def run(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by([("rank", "ascending"), ("lang", "ascending"), ("bits", "ascending")])
        packed = np.frombuffer(b"".join(sample["bits"].to_pylist()), np.uint8).reshape(sample.num_rows, -1)
        languages = np.array(sample["lang"].to_pylist(), object)
        names, marks, weights, bias = fit(packed, languages, setting)
        slots = (marks / np.sqrt(marks.sum(1))[:, None]).T @ weights.astype(np.float32)
        return pa.table({"languages": [names], "slots": [slots.astype(np.float32).tobytes()], "bias": [bias.tolist()]})

    return run


def train(docs: DataFrame, setting: Kernel = Kernel()) -> Model | None:
    """Learn from doc_id, text and lang of docs; leave out held-out rows before."""
    known = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.count("*").alias("n_rows"))
    counts = counts.withColumn("share", F.lit(float(setting.sample)) / max(1, counts.count()) / F.col("n_rows")).select("lang", "share")
    rank = F.xxhash64(F.lit(12), "doc_id")
    chance = F.shiftrightunsigned(rank, 11) / F.lit(2.0**53)
    some = dim_join(known, counts, ["lang"], spread_by="doc_id").where(chance < F.col("share"))
    # An id that is repeated very often is one text, combined before it moves.
    some = some.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row")).select(rank.alias("rank"), "row.lang", "row.text")
    bits = some.mapInArrow(_sample_rows(setting.longest), "rank bigint, lang string, bits binary")
    fitted = bits.groupBy(F.lit(0).alias("model")).applyInArrow(_fit_sample(setting), "languages array<string>, slots binary, bias array<double>").collect()
    if not fitted:
        return None
    names = fitted[0].languages
    return Model(names, np.frombuffer(fitted[0].slots, np.float32).reshape(SLOTS, len(names)), np.array(fitted[0].bias))


def predict(docs: DataFrame, model: Model | None, setting: Kernel = Kernel(), into: tuple[str, str] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """Add language and score to the kept columns (all, unless named) of every row."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {x.lower() for x in into}]
    carried = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias(free_name(docs, "read_text")))
    schema = T.StructType([*carried.schema[: len(kept)], T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())])
    out_schema = to_arrow_schema(schema)
    # SLOTS values for each learned language, whatever the tables' sizes are.
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = sent.value
        names = np.array([*(learned.languages if learned else ()), UNKNOWN], object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows, wordy = presence(part.column(len(kept)).to_pylist(), setting.longest)
                best, chance = np.full(len(rows), len(names) - 1), np.zeros(len(rows))
                if learned:
                    values = learned.values(rows)
                    odds = np.exp(setting.sharpness * (values - values.max(1)[:, None]))
                    best = np.where(wordy, values.argmax(1), best)
                    chance = np.where(wordy, 1 / odds.sum(1), 0.0)
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names[best].tolist(), pa.string()), pa.array(chance)], schema=out_schema)

    return carried.mapInArrow(run, schema)


def remainder():
    """crc32 of the id as text, modulo 4: 2 marks held-out rows."""
    return F.crc32(F.col("doc_id").cast("string")) % 4


def identify(docs: DataFrame, setting: Kernel = Kernel()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    model = train(docs.where(remainder() != 2), setting)
    held_out = F.coalesce(remainder() == 2, F.lit(False)).alias("held_out")
    return predict(docs, model, setting, keep=["doc_id"]).select("doc_id", held_out, "lang_pred", "score")
