"""Plain versions of what the operators must return, and awkward rows."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977} Abc{i % 31}," for i in range(30_000))
BASE = " ".join(f"word{i} stays" for i in range(60))

#: (doc_id, text): null, empty, blank, long, unspaced, ties, repeats, other scripts, control strings.
ROWS = [
    (0, None), (1, ""), (2, " \n\t "), (3, LONG), (4, "x" * 9000), (5, "one"), (6, "one"), (6, "one"),
    (7, BASE), (8, BASE.upper()), (9, BASE + " end"), (10, "日本語 текст é  ß İΣΑΣ 😀" * 40),
    (11, "<|endoftext|> it's <|startoftext|>'re 've\n\n  x 12 345 ...!?"), (12, "a b c\na b c\nA  b c\n" * 20),
    (None, "one two three four five"), (None, None), (13, BASE.replace("word7 ", "other ")),
]


def docs(spark, rows=None, extra=True):
    """``documents`` with columns whose names clash with operators' own."""
    out = spark.createDataFrame(ROWS if rows is None else rows, "doc_id bigint, text string")
    if extra:
        out = out.selectExpr("doc_id", "text", "'en' AS lang", "concat('src', coalesce(doc_id, 0) % 2) AS source",
                             "cast(length(text) AS bigint) AS n_chars", "1 AS ids", "2 AS found", "3 AS score",
                             "4 AS stats", "5 AS `row`", "6 AS n_tokens", "7 AS licenses", "8 AS c", "9 AS bands")
    return out


def words(text):
    return WORD.findall((text or "").translate(LOW))


def alnum_words(text):
    return ALNUM.findall((text or "").translate(LOW))


def shingle_set(text, n):
    w = words(text)
    return set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else ({tuple(w)} if w else set())


def window_hits(text, phrases):
    """Words inside an occurrence, and items, for ``phrases`` {word tuple: items}."""
    w, hit, items = alnum_words(text), Counter(), set()
    for n in {len(p) for p in phrases}:
        for i in range(len(w) - n + 1):
            found = phrases.get(tuple(w[i:i + n]))
            if found is not None:
                items |= found
                hit.update(range(i, i + n))
    return len(w), len(hit), items
