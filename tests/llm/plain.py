"""Brute-force versions of the operators, and small tables with awkward rows."""

import hashlib
import re

import duckdb
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators might use for themselves.
        *[T.StructField(n, T.StringType()) for n in ("score", "chunk", "line_gone", "gone", "hit", "n_lines", "row_key", "component", "kept")],
    ]
)
EXTRA = ("s", "c", "g", "o", "h", "n", "r", "m", "k")


def rows(texts, start=0):
    return [(start + i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 2], len(t or ""), *EXTRA) for i, t in enumerate(texts)]


def docs(spark, texts, start=0):
    return spark.createDataFrame(rows(texts, start), DOCS)


def words(n, seed, step=1):
    return [f"w{(seed * 7919 + i * step * 104729) % 9973}" for i in range(n)]


def awkward_texts():
    """Null, empty and blank texts, ties, copies, near copies, repeats, a very long text."""
    base = words(60, 1)
    near = base[:30] + ["other"] + base[31:]
    passage = " ".join(words(40, 2))
    long = " ".join(words(30_000, 3, 7))
    return [
        None, "", " \t\n ", "one", "one", "Two words", "a " * 40, "aaaa" * 60, "é" * 70 + " ü",
        " ".join(base), " ".join(base), " ".join(base).upper(), " ".join(near),
        f"first line here\n{passage}\nlast line", f"{passage}", f"x y z {passage} tail\n{passage}",
        "same line\nnext line\nthird line", "zero\nsame line\n next line \nthird line\n\nsame line\nnext line",
        long, long[: len(long) // 2], "naïve <|im_end|> \\ text\r\nwith | # marks ###", "\x00nul\x00 byte \x7f",
    ]


def documents_of(spark):
    """The awkward texts, one row twice, and rows whose other columns are all null."""
    table = docs(spark, awkward_texts())
    again = table.where("doc_id = 9")
    bare = spark.createDataFrame([(None, "text without id " * 9, *[None] * 12), (100, None, *[None] * 12)], DOCS)
    return table.unionByName(again).unionByName(bare)


def same(got, expected):
    """Compare rows of a DataFrame with dictionaries or tuples, whatever their order."""
    names = got.columns
    have = sorted(repr(tuple(r[n] for n in names)) for r in got.collect())
    want = sorted(repr(tuple(e[n] for n in names)) if isinstance(e, dict) else repr(tuple(e)) for e in expected)
    assert have == want, ([x for x in have if x not in want][:3], [x for x in want if x not in have][:3])


def same_as_sql(got, sql, **tables):
    """Compare a DataFrame with DuckDB SQL over small Spark tables."""
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toArrow())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    same(got.select(*names), cursor.fetchall())


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def spans_of(marks):
    return len(bytes(marks).replace(b"\0", b" ").split())


def later_strings(table, least=50):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 by looking at every string of every text."""
    texts = [(r.doc_id, (r.text or "").encode()) for r in table.collect()]
    first = {}
    for i, t in texts:
        for j in range(len(t) - least + 1) if i is not None else ():
            first[t[j : j + least]] = min(i, first.get(t[j : j + least], i))
    out = []
    for i, t in texts:
        marks = bytearray(len(t))
        for j in range(len(t) - least + 1) if i is not None else ():
            if first[t[j : j + least]] < i:
                marks[j : j + least] = b"\1" * least
        kept = bytes(c for c, m in zip(t, marks) if not m)
        out.append({"doc_id": i, "n_bytes": len(t), "n_removed": sum(marks), "n_spans": spans_of(marks), "kept_sha256": sha(kept)})
    return out


def later_windows(table, window=13):
    """doc_id, n_words, n_removed, kept_sha256 by looking at every window of every text."""
    texts = [(r.doc_id, WORD.findall(r.text or "")) for r in table.collect()]
    first = {}
    for i, w in texts:
        for j in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[j : j + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in texts:
        marks = bytearray(len(w))
        for j in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[j : j + window])] < i:
                marks[j : j + window] = b"\1" * window
        kept = " ".join(x for x, m in zip(w, marks) if not m)
        out.append({"doc_id": i, "n_words": len(w), "n_removed": sum(marks), "kept_sha256": sha(kept)})
    return out


def shingles(text, k):
    w = WORD.findall((text or "").translate(A_TO_Z))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def components_of(table, k=4, percent=80):
    """doc_id, n_shingles, component_id, kept by comparing all pairs of documents."""
    sets = [(r.doc_id, shingles(r.text, k)) for r in table.collect()]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [(i, s) for i, s in sets if i is not None and s]
    for n, (i, a) in enumerate(known):
        for j, b in known[n + 1 :]:
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                u, v = sorted((root(i), root(j)))
                parent[v] = u
    return [
        {"doc_id": i, "n_shingles": len(s), "component_id": None if i is None else root(i), "kept": i is None or root(i) == i}
        for i, s in sets
    ]


def word_statistics(text):
    w = WORD.findall(text or "")
    seen, many = {}, set()
    for i in range(len(w) - 4):
        key = tuple(w[i : i + 5])
        if key in seen:
            many |= set(range(seen[key], seen[key] + 5)) | set(range(i, i + 5))
        seen[key] = i
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(many)
