"""Column counters over whole document and conversation texts against a plain-Python count.

The registered query over these texts has no SQL counterpart, because SQL cannot express the
bracket-aware split; the character-by-character scanner below is written independently.
"""

import os
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyweave.constants import BLANK_TOKENS, SAFE_DELIMITERS
from tallyweave.model import table_responses
from tallyweave.operators.inference import column_profile

DATA = "/root/testdata/sf0.001"
WS = "\t\n\v\f\r       　﻿" + "".join(map(chr, range(0x2000, 0x200B)))


def norm(text):
    t = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub("[" + WS.replace("\n", "") + "]+", " ", t)
    return re.sub(" *\n *", "\n", t).strip(" \n")


def key(text):
    return norm(text).lower().rstrip("。、．，.,").strip(" \n")


def blank(text):
    return norm(text) == "" or norm(text).lower() in BLANK_TOKENS


def scan(text, honour):
    out, depth, quoted = [""], 0, False
    for ch in text:
        if honour and ch == '"':
            quoted = not quoted
        elif not quoted and ch in "(（【「『":
            depth += 1
        elif not quoted and ch in ")）】」』":
            depth = max(0, depth - 1)
        elif not quoted and depth == 0 and ch in SAFE_DELIMITERS:
            out.append("")
            continue
        out[-1] += ch
    return out, quoted


def split(text):
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    pieces, open_quote = scan(text, True)
    if open_quote:
        pieces, _ = scan(text, False)
    seen = {}
    for p in map(norm, pieces):
        if len(p) >= 2 and (p[0], p[-1]) in (('"', '"'), ("“", "”")) and '"' not in p[1:-1]:
            p = p[1:-1].strip()
        if not blank(p):
            seen.setdefault(key(p), p)
    return list(seen)


def brute(values):
    filled = [v for v in values if not blank(v)]
    parts = [split(v) for v in filled]
    return (
        len(filled),
        sum("\n" in v for v in filled),
        sum(bool(re.search("[0-9]", norm(v))) for v in filled),
        sum(len(p) >= 2 for p in parts),
        len({key(v) for v in filled}),
        len({k for p in parts for k in p}),
    )


COUNTERS = ("filled", "multiline", "parsed", "split_rows", "distinct_values", "distinct_tokens")


def profiled(responses):
    rows = column_profile(responses).collect()
    return {(r["survey_id"], r["col_idx"]): tuple(r[c] for c in COUNTERS) for r in rows}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
def test_whole_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    talk = spark.read.parquet(f"{DATA}/conversations.parquet")
    r = table_responses(docs, F.col("doc_id"), [F.col("text"), F.col("lang")], "d").unionByName(
        table_responses(talk, F.col("conv_id") * 4096 + F.col("turn"), [F.col("text"), F.col("role")], "c"))
    expected = {}
    for sid, df, cols in (("d", docs, ("text", "lang")), ("c", talk, ("text", "role"))):
        for i, name in enumerate(cols):
            expected[sid, i] = brute([row[0] for row in df.select(name).collect()])
    assert profiled(r) == expected


def test_structured_cells(spark):
    import random
    rnd = random.Random(5)
    alphabet = list('ab、,;\n()（）「」"“”１|｜ 　-。．ｶﾞ①') + ["\r\n", "n/a"]
    values = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 14))) for _ in range(1500)]
    values += ["".join(rnd.choices(alphabet, k=rnd.randint(70, 120))) for _ in range(200)]
    rows = [("s", i, True, [v]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "survey_id string, response_id bigint, included boolean, cells array<string>")
    assert profiled(df) == {("s", 0): brute(values)}
