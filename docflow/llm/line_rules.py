"""Quality rules with cross-document line frequency.

Per document one pass gives the rule counts and its distinct lines, normalised (ASCII lower
case, blanks folded) and hashed to 64 bits. Per host and line the distinct
documents are counted; a line above the limit is boilerplate and is removed. A document that
is left with too few words is depleted and rejected, as is one that fails the base rules.

What counts as a document: a line is counted over the distinct texts of the host that hold it
(exact copies by a hash of all normalised lines). If that count is below the limit, the line
is none of boilerplate. Of the others, near copies of one text must not condemn each other's lines, so
a line must pass the limit in one of two further counts, neither of which compares texts:

* texts with enough words of their own, that is without all lines above the limit;
* texts that differ outside of the line. ``SKETCHES`` hash functions each pick one line of the rest
  of a text, without the line in question. A text counts one over the number of texts that share
  at least half of its picks: near copies count about once together, texts that share nothing
  else count each, however long the line is.

So a document with less of its own is never better off, unless it is alike to others in half of
its other lines too: then it is the near-duplicate operator's. A host's size is counted like the
second, over whole texts.

The limit is relative (``line_share`` of a host's documents), from hosts of 50 documents on;
below, ``line_floor`` guards against chance repeats: a line needs six documents. Lines are
pre-aggregated by (host, line, text) before and after the shuffle, so a hot host or line is
combined on the map side; the boilerplate table joins back by (host, line), an equi-join that
Spark can split. Texts are never shuffled.

Defined cases: a null text has no words and fails the base rules; a null host is one host;
repeated rows are judged row by row; lines without a word never count; an empty table gives no
rows; other columns travel in ``doc``, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.llm.common import LOWER, saved

SKETCHES = 8
#: Odd multipliers of the hash functions that pick lines.
PICKS = np.random.default_rng(20240511).integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLANKS = re.compile(rb"[\x20\x09-\x0D]")
SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")

STATS = (T.StructType().add("n_words", T.LongType()).add("word_chars", T.LongType())
         .add("n_symbols", T.LongType()).add("n_dup_lines", T.LongType()).add("n_repeat_words", T.LongType())
         .add("key", T.LongType())
         .add("lines", T.ArrayType(T.StructType().add("line", T.LongType()).add("words", T.IntegerType())))
         .add("picks", T.ArrayType(T.StructType().add("line", T.LongType()).add("next", T.LongType()))))


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur twice or more in ``words``."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == n:
        return 0
    number: dict = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in windows), np.int64, n)
    twice = np.flatnonzero((np.bincount(code) > 1)[code])
    cover = np.zeros(len(words) + 1, np.int64)
    cover[twice] += 1
    np.add.at(cover, twice + size, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def line_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words).translate(LOWER)) - 2**63


def picks(lines: list[int]) -> list[dict]:
    """Per hash function the line with the least hash, and the one that follows it."""
    if not lines:
        return [{"line": None, "next": None}] * SKETCHES
    mixed = np.array(lines, np.int64).view(np.uint64)
    mixed = (mixed ^ mixed >> np.uint64(29))[:, None] * PICKS
    mixed ^= mixed >> np.uint64(32)
    first = mixed.argmin(0)
    out = [lines[i] for i in first.tolist()]
    follow = [None] * SKETCHES
    if len(lines) > 1:
        mixed[first, np.arange(SKETCHES)] = np.iinfo(np.uint64).max
        follow = [lines[i] for i in mixed.argmin(0).tolist()]
    return [{"line": a, "next": b} for a, b in zip(out, follow, strict=True)]


def measure(text: str | None) -> dict:
    raw = (text or "").encode()
    words = raw.split()
    lines: dict[int, int] = {}
    seen, dup, order = set(), 0, []
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        dup += line in seen
        seen.add(line)
        h = line_hash(own)
        lines[h] = lines.get(h, 0) + len(own)
        order.append(h)
    return {"n_words": len(words), "word_chars": len(BLANKS.sub(b"", raw).decode()),
            "n_symbols": len(raw.translate(None, SYMBOLS)), "n_dup_lines": dup,
            "n_repeat_words": repeat_words(words), "key": xxhash.xxh3_64_intdigest(np.array(order, np.int64).tobytes()) - 2**63,
            "lines": [{"line": h, "words": n} for h, n in lines.items()], "picks": picks(list(lines))}


def with_stats(docs: DataFrame) -> DataFrame:
    """``doc`` (all columns of a row) and ``stats`` of its text, in one narrow stage."""

    def run(batches):
        for batch in batches:
            for piece in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                field = piece.schema.field("stats")
                made = pa.array([measure(t) for t in pc.struct_field(piece.column("doc"), "text").to_pylist()], field.type)
                yield piece.set_column(piece.schema.get_field_index("stats"), field, made)

    out = docs.select(F.struct(*docs.columns).alias("doc"), F.lit(None).cast(STATS).alias("stats"))
    return out.mapInArrow(run, out.schema)


def _different(texts: DataFrame, scope: list[str]) -> DataFrame:
    """Per ``scope`` the sum over its ``texts`` (scope, key, picked: array of ``SKETCHES`` lines) of one over
    the number of texts that share half of its picks: scope, n (in millionths)."""
    each = texts.select(*scope, "key", F.posexplode("picked").alias("j", "pick"))
    each = each.withColumn("pick", F.coalesce("pick", F.lit(0)))  # none: the text is the line alone
    shared = each.groupBy(*scope, "j", "pick").agg(F.count("*").alias("same"))
    met = each.join(shared, [*scope, "j", "pick"])
    half = F.sort_array(F.collect_list("same"), asc=False)[SKETCHES // 2 - 1]  # of SKETCHES numbers
    alike = met.groupBy(*scope, "key").agg(half.alias("same"))
    return alike.groupBy(*scope).agg(F.sum(F.expr("1000000 div same")).alias("n"))


def _candidates(rows: DataFrame, line_share: float, line_floor: int) -> tuple[DataFrame, DataFrame]:
    """(host, docs: its size) and (host, line, docs) of the lines whose distinct texts pass the limit."""
    lines = rows.select("host", "key", F.explode("lines.line").alias("line")).distinct()
    often = saved(lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > line_floor), "often")
    # Only a host with a frequent line counts; each of its texts once.
    texts = rows.join(often.select("host").distinct(), "host", "left_semi").select(
        "host", "key", F.col("picks.line").alias("picked")).dropDuplicates(["host", "key"])
    sizes = saved(_different(texts, ["host"]).select("host", (F.col("n") / 1_000_000).alias("docs")), "sizes")
    return sizes, often.join(sizes, "host").where(F.col("n") > F.col("docs") * line_share).select("host", "line", "docs")


def boilerplate(rows: DataFrame, line_share: float, line_floor: int, least_words: int, least_share: float) -> tuple[DataFrame, DataFrame]:
    """(host, line) of the lines above the limit, and (row, host, line, words) of the rows that hold a candidate."""
    _, cand = _candidates(rows, line_share, line_floor)
    lines = rows.select("row", "host", "key", "n_words", "picks", F.explode("lines").alias("l"))
    held = lines.select("row", "host", "key", "n_words", "picks", "l.line", "l.words").join(cand, ["host", "line"])
    rest = F.transform("picks", lambda p: F.when(p["line"] == F.col("line"), p["next"]).otherwise(p["line"]))
    held = saved(held.select("row", "host", "line", "key", "n_words", "words", "docs", rest.alias("picked")), "carriers")
    own = held.groupBy("row").agg((F.max("n_words") - F.sum("words")).alias("own"), F.max("n_words").alias("n_words"))
    full = own.where((F.col("own") >= least_words) & (F.col("own") >= F.col("n_words") * least_share)).select("row")
    above = lambda n: n > F.greatest(F.lit(line_floor), F.col("docs") * line_share)
    with_own = held.join(full, "row", "left_semi").select("host", "line", "docs", "key").distinct()
    with_own = with_own.groupBy("host", "line", "docs").agg(F.count("*").alias("n")).where(above(F.col("n")))
    differ = _different(held.dropDuplicates(["host", "line", "key"]).select("host", "line", "docs", "key", "picked"), ["host", "line", "docs"])
    differ = differ.where(above(F.col("n") / 1_000_000))
    bad = saved(with_own.select("host", "line").unionByName(differ.select("host", "line")).distinct(), "boilerplate")
    return bad, held.select("row", "host", "line", "words")


def _measured(docs: DataFrame, host: str) -> DataFrame:
    return saved(with_stats(docs).select(
        F.monotonically_increasing_id().alias("row"), F.col("doc").dropFields("text").alias("doc"),
        F.coalesce(F.col("doc")[host].cast("string"), F.lit("")).alias("host"),
        "stats.*"), "line-stats")


def judge(docs: DataFrame, host: str = "source", line_share: float = 0.1, line_floor: int = 5,
          least_words: int = 10, least_share: float = 0.2, repeat_percent: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc (its columns without the text), the rule counts,
    removed_words, base_failed, depleted and kept. The measured rows are written once, without
    texts, and read by every later step."""
    rows = _measured(docs, host)
    bad, held = boilerplate(rows, line_share, line_floor, least_words, least_share)
    removed = held.join(bad, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("removed_words"))
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return (rows.drop("lines", "picks", "key", "host").join(removed, "row", "left").fillna(0, ["removed_words"])
            .withColumn("base_failed", failed)
            .withColumn("depleted", (F.col("removed_words") > 0)
                        & ((left < least_words) | (left < F.col("n_words") * least_share)))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).drop("row"))


def keep(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps. Only the rejected rows' keys (id and a hash
    of the row) meet ``docs`` again, so texts are not shuffled while those are few; rows equal
    in id, host and text share their verdict."""
    key = F.xxhash64("doc_id", host, "text")
    judged = judge(docs.withColumn("_key", key), host, **limits)
    gone = saved(judged.where(~F.col("kept")).select(
        F.col("doc._key").alias("_gone"), F.col("doc.doc_id").alias("_id")).distinct(), "rejected")
    return docs.join(gone, (key == F.col("_gone")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")


def clean(docs: DataFrame, host: str = "source", line_share: float = 0.1, line_floor: int = 5,
          least_words: int = 10, least_share: float = 0.2) -> DataFrame:
    """All rows of ``docs``, their texts without the boilerplate lines; other texts stay as they are.
    Rows equal in host and text lose the same lines."""
    key, at = F.xxhash64("text"), F.coalesce(F.col(host).cast("string"), F.lit(""))
    rows = _measured(docs.select(host, "text", key.alias("_key")), host)
    bad, held = boilerplate(rows, line_share, line_floor, least_words, least_share)
    lines = held.join(rows.select("row", F.col("doc._key").alias("_key")), "row").select("host", "_key", "line").distinct()
    gone = lines.join(bad, ["host", "line"]).groupBy(F.col("host").alias("_host"), "_key").agg(F.collect_list("line").alias("_gone"))

    def run(batches):
        for batch in batches:
            texts = []
            for text, out in zip(pc.struct_field(batch.column("doc"), "text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                if out:
                    out = set(out)
                    text = b"\n".join(x for x in text.encode().split(b"\n") if not x.split() or line_hash(x.split()) not in out).decode()
                texts.append(text)
            field = batch.schema.field("cleaned")
            yield batch.set_column(batch.schema.get_field_index("cleaned"), field, pa.array(texts, field.type))

    met = docs.join(gone, (at == F.col("_host")) & (key == F.col("_key")), "left")
    met = met.select(F.struct(*docs.columns).alias("doc"), F.col("_gone").alias("gone"), F.lit(None).cast("string").alias("cleaned"))
    out = met.mapInArrow(run, met.schema)
    return out.select(*(F.col("cleaned").alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns))
