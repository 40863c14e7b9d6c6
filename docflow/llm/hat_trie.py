"""Phrase collocations, counted in HAT-tries.

Every language is counted by itself. A pass over the texts counts the words; then one pass per
phrase length counts the phrases whose shorter parts are frequent (a phrase is never more
frequent than its parts, so nothing that counts is left out).

A task counts in a HAT-trie over its word ids: the shallow trie routes a phrase by its first
words to a burstable hash container. A container that grows beyond ``burst`` entries is split
between two first words, or, if one word fills it, below that word between two second words.
When the trie holds ``max_entries``, its largest subtrees leave it whole, as runs sorted by the
words' hashes, until half is left; the rest leaves at the end. Spark merges the runs per prefix
partition: the first word and some bits of the others, so that the phrases of a very frequent
first word spread over ``SPREAD`` partitions. Words travel as 64-bit hashes of language and
word; all words of the corpus are checked for two that share a hash, and if there are any, all
is counted anew under another seed. So counts are exact.

That parts are frequent is asked of a broadcast bit table of ``FILTER_BITS`` bits, built by
Spark's bitmap aggregation. Its size is fixed: with very many frequent parts it lets more rare
phrases pass, which the exact counts then drop. Hits must hold in two places of the table.

Scores are exact: a count's square times a million is a decimal of 38 digits (counts up to
10^16), and its quotient is taken whole.

Defined cases: a null text has no words; a null language is ``und``; repeated rows count each;
a word of any length is one word; an empty table gives no rows; other columns are not read.
Phrases of two or three words are mined.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.common import LOWER, saved, text_of

FILTER_BITS = 1 << 27
SPREAD = 32
#: Parts of a language that rank by themselves first.
PARTS = 32
ID_BITS = 21
#: ASCII upper case to lower, separators of pieces to line ends, tabs to blanks.
FOLD = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else LOWER[b] for b in range(256))


def tokens(texts: list[str]) -> list[bytes]:
    """Words of the texts in order; line ends stand between pieces, empty strings mean nothing."""
    data = "\n".join(texts).encode().translate(FOLD)
    return data.replace(b"\n", b" \n ").split(b" ")


def word_hash(lang: str, word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\n" + word, seed) - 2**63


def _languages(batches, batch_chars: int) -> Iterator[tuple[str, list[str]]]:
    """(language, texts of it) in pieces of about ``batch_chars``."""
    held: dict[str, list[str]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            text = text.as_py()
            held.setdefault(lang.as_py(), []).append(text)
            size += len(text)
            if size >= batch_chars:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


# ---- places in the bit table: the same sums over words' hashes in numpy and in SQL -----------


def _places(words: list, shift: Callable, mask: int) -> list:
    """Two places of a part: words are uniform hashes, each contributes other bits."""
    first, second = words[0], shift(words[0], 31)
    for i, w in enumerate(words[1:], 1):
        first, second = first ^ shift(w, 7 + 5 * i), second ^ shift(w, 29 + 3 * i)
    return [first & mask, second & mask]


def _bit_places(words: list[np.ndarray], bits: int) -> list[np.ndarray]:
    return _places(words, lambda w, n: (w.view(np.uint64) >> np.uint64(n)).view(np.int64), bits - 1)


def _bit_columns(names: list[str], bits: int) -> Column:
    class Bits:
        def __init__(self, c):
            self.c = c

        def __xor__(self, other):
            return Bits(self.c.bitwiseXOR(other.c))

        def __and__(self, mask):
            return self.c.bitwiseAND(F.lit(mask))

    return F.array(*_places([Bits(F.col(n)) for n in names], lambda w, n: Bits(F.shiftrightunsigned(w.c, n)), bits - 1))


def bit_table(frequent: DataFrame, names: list[str], bits: int = FILTER_BITS) -> np.ndarray:
    """The bit table of the rows of ``frequent``, packed: rows of 4 KB, ``bits`` / 32768 at most."""
    places = frequent.select(F.explode(_bit_columns(names, bits)).alias("place")).select((F.col("place") + 1).alias("place"))  # bitmaps count from 1
    packed = (places.groupBy(F.bitmap_bucket_number("place").alias("bucket"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map")))
    table = np.zeros(bits // 8, np.uint8)
    for bucket, part in packed.collect():
        table[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(part, np.uint8)
    return table


def _held(table: np.ndarray, words: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.ones(len(words[0]), bool)
    for place in _bit_places(words, bits):
        out &= (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return out


# ---- the trie ---------------------------------------------------------------------------------


class Container:
    """A hash table from phrase keys to counts, open addressing over arrays."""

    def __init__(self, slots: int = 256):
        self.keys, self.counts, self.used = np.full(slots, -1, np.int64), np.zeros(slots, np.int64), 0

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts) sorted by key."""
        there = np.flatnonzero(self.keys >= 0)
        order = there[np.argsort(self.keys[there])]
        return self.keys[order], self.counts[order]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, or the empty slot where it would go."""
        mask = len(self.keys) - 1
        slot = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) & mask
        miss = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & mask
            at = self.keys[slot[miss]]
            miss = miss[(at != keys[miss]) & (at >= 0)]
        return slot

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of distinct keys."""
        if (self.used + len(keys)) * 2 > len(self.keys):
            old, n = self.entries()
            self.__init__(1 << int((len(old) + len(keys)) * 2).bit_length())
            self.add(old, n)
        while len(keys):  # of keys that meet in one empty slot, one gets it at a time
            slot = self._slots(keys)
            new = self.keys[slot] < 0
            self.keys[slot[new]] = keys[new]
            won = self.keys[slot] == keys
            self.counts[slot[won]] += counts[won]
            self.used += int((new & won).sum())
            keys, counts = keys[~won], counts[~won]


class HatTrie:
    """Phrases of ``size`` word ids, packed into one key: a container holds a range of keys that
    begins and ends between two words of one level."""

    def __init__(self, size: int, burst: int = 32_768):
        self.size, self.burst = size, burst
        self.bounds, self.leaves, self.entries = np.zeros(1, np.int64), [Container()], 0

    def add(self, keys: np.ndarray) -> None:
        """Count the phrases ``keys`` (any order, repeats too)."""
        keys = np.sort(keys)
        if not len(keys):
            return
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts, keys = np.diff(np.append(first, len(keys))), keys[first]
        edges = np.searchsorted(keys, np.append(self.bounds[1:], 1 << 62))
        start = 0
        full = []
        for i, stop in enumerate(edges.tolist()):
            if stop > start:
                leaf = self.leaves[i]
                before = leaf.used
                leaf.add(keys[start:stop], counts[start:stop])
                self.entries += leaf.used - before
                if leaf.used > self.burst:
                    full.append(i)
            start = stop
        for i in reversed(full):
            self._burst(i)

    def _burst(self, i: int) -> None:
        """Split container ``i`` until none is too full: at the shallowest level whose words
        differ in it, at the border nearest to its middle."""
        todo, done = [(int(self.bounds[i]), *self.leaves[i].entries())], []
        while todo:
            low, keys, counts = todo.pop()
            cut = 0
            if len(keys) > self.burst:
                for level in range(self.size - 1, -1, -1):
                    words = keys >> (ID_BITS * level)
                    if words[0] != words[-1]:
                        middle = words[len(keys) // 2]
                        cut = int(np.searchsorted(words, middle)) or int(np.searchsorted(words, middle, "right"))
                        break
            if not cut:
                done.append((low, keys, counts))
                continue
            border = int(keys[cut] >> (ID_BITS * level) << (ID_BITS * level))
            todo += [(border, keys[cut:], counts[cut:]), (low, keys[:cut], counts[:cut])]
        made = []
        for _, keys, counts in done:
            leaf = Container(1 << int(len(keys) * 2 + 1).bit_length())
            leaf.add(keys, counts)
            made.append(leaf)
        self.leaves[i:i + 1] = made
        self.bounds = np.concatenate([self.bounds[:i], [d[0] for d in done], self.bounds[i + 1:]]).astype(np.int64)

    def spill(self, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take whole subtrees out, the largest first, until ``upto`` entries are left."""
        for i in sorted(range(len(self.leaves)), key=lambda i: -self.leaves[i].used):
            if self.entries <= upto or not self.leaves[i].used:
                return
            yield self.leaves[i].entries()
            self.entries -= self.leaves[i].used
            self.leaves[i] = Container()


class _Words(dict):
    """Word -> id of one language; 0: too rare for a phrase, -1: nothing."""

    def __init__(self, owner: Ids, lang: str):
        super().__init__({b"": -1, b"\n": 0})
        self.owner, self.lang = owner, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = out = self.owner.new(self.lang, word)
        return out


class Ids:
    """A task's word ids over all languages, and the words' hashes."""

    def __init__(self, table: np.ndarray, bits: int, seed: int):
        self.table, self.bits, self.seed = table, bits, seed
        self.langs: dict[str, _Words] = {}
        self.hashes, self.seen, self.chars = array("q", [0]), 0, 0

    def new(self, lang: str, word: bytes) -> int:
        self.seen += 1
        h = word_hash(lang, word, self.seed)
        mask = self.bits - 1
        for place in (h & mask, (h % 2**64 >> 31) & mask):
            if not self.table[place >> 3] >> (place & 7) & 1:
                return 0
        self.hashes.append(h)
        return len(self.hashes) - 1

    def of(self, lang: str, texts: list[str]) -> np.ndarray:
        self.chars += sum(map(len, texts))
        words = self.langs.get(lang)
        if words is None:
            words = self.langs[lang] = _Words(self, lang)
        found = tokens(texts)
        ids = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
        return ids[ids >= 0]


# ---- passes -----------------------------------------------------------------------------------


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))


def _count_words(docs: DataFrame, seed: int, max_words: int, max_chars: int, batch_chars: int) -> DataFrame:
    """(w, lang, word, n, kinds): one row per word, and one with a null word per language (all
    words); ``kinds``: the words that share the hash."""

    def run(batches):
        schema = pa.schema([("w", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
        held: dict[str, Counter] = {}

        def runs():
            for lang, words in held.items():
                words.pop(b"", None)
                words.pop(b"\n", None)
                total = word_hash(lang, b"\n", seed)  # no word is a line end
                yield pa.RecordBatch.from_arrays(
                    [pa.array([total]), pa.array([lang]), pa.array([None], pa.string()), pa.array([words.total()])], schema=schema)
                names = sorted(words)
                for i in range(0, len(names), 50_000):
                    part = names[i:i + 50_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([word_hash(lang, x, seed) for x in part], pa.int64()), pa.array([lang] * len(part)),
                        pa.array([x.decode() for x in part]), pa.array([words[x] for x in part], pa.int64())], schema=schema)

        chars = 0
        for lang, texts in _languages(batches, batch_chars):
            held.setdefault(lang, Counter()).update(tokens(texts))
            chars += sum(map(len, texts))
            if chars > max_chars or sum(map(len, held.values())) > max_words:
                yield from runs()
                held.clear()
                chars = 0
        yield from runs()

    found = _docs(docs).mapInArrow(run, "w bigint, lang string, word string, n bigint").repartition("w")
    each = found.groupBy("w", "lang", "word").agg(F.sum("n").alias("n"))
    one = each.groupBy("w").agg(F.max(F.struct("n", "lang", "word")).alias("one"), F.count("*").alias("kinds"))
    return one.select("w", "one.lang", "one.word", "one.n", "kinds")


def _count_phrases(docs: DataFrame, size: int, seed: int, tables: list, bits: int, max_words: int, max_chars: int,
                   max_entries: int, burst: int, batch_chars: int) -> DataFrame:
    """(w1, ..., w<size>, n) of phrases whose parts of one word less are (likely) frequent;
    ``tables``: the bit tables of words and pairs as broadcasts."""
    names = [f"w{i + 1}" for i in range(size)]
    mask = (1 << ID_BITS) - 1

    def run(batches):
        schema = pa.schema([(c, pa.int64()) for c in (*names, "n")])
        ids, trie = Ids(tables[0].value, bits, seed), HatTrie(size, burst)

        def runs(upto):
            hashes = np.array(ids.hashes, np.int64)
            for keys, counts in trie.spill(upto):
                cols = [hashes[(keys >> (ID_BITS * (size - 1 - i))) & mask] for i in range(size)]
                order = np.lexsort(cols[::-1])
                cols = [c[order] for c in (*cols, counts)]
                for at in range(0, len(order), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 100_000]) for c in cols], schema=schema)

        for lang, texts in _languages(batches, batch_chars):
            at = ids.of(lang, texts)
            n = len(at) - size + 1
            if n > 0:
                parts = [at[i:i + n] for i in range(size)]
                fits = np.flatnonzero(np.logical_and.reduce([p > 0 for p in parts]))
                if size > 2 and len(fits):
                    hashes = np.array(ids.hashes, np.int64)
                    words = [hashes[p[fits]] for p in parts]
                    fits = fits[_held(tables[1].value, words[:-1], bits) & _held(tables[1].value, words[1:], bits)]
                key = np.zeros(len(fits), np.int64)
                for p in parts:
                    key = key << ID_BITS | p[fits]
                trie.add(key)
            if ids.seen > max_words or ids.chars > max_chars:  # ids end with the trie that holds them
                yield from runs(0)
                ids, trie = Ids(tables[0].value, bits, seed), HatTrie(size, burst)
            elif trie.entries > max_entries:
                yield from runs(max_entries // 2)
        yield from runs(0)

    found = _docs(docs).mapInArrow(run, ", ".join(f"{c} bigint" for c in (*names, "n")))
    mixed = F.col(names[1])
    for c in names[2:]:
        mixed = mixed.bitwiseXOR(F.shiftright(c, 8))
    found = found.withColumn("part", mixed.bitwiseAND(F.lit(SPREAD - 1))).repartition("w1", "part")
    return found.groupBy("w1", "part", *names[1:]).agg(F.sum("n").alias("n")).drop("part")


def count(docs: DataFrame, least: int = 10, longest: int = 3, max_words: int = 1_000_000, max_chars: int = 128_000_000,
          max_entries: int = 2_000_000, burst: int = 32_768, batch_chars: int = 2_000_000,
          bits: int = FILTER_BITS) -> tuple[DataFrame, list[DataFrame]]:
    """(all words of each language: lang, n), [words, pairs, triples] that occur ``least`` times
    or more. Words: w, lang, word, n; phrases: w1, w2 (, w3), n. All are written tables."""
    if longest not in (2, 3):
        raise ValueError("phrases of two or three words are mined")
    if not 0 < max_words <= 1 << ID_BITS - 1 or bits & (bits - 1) or bits < 1 << 15:
        raise ValueError("max_words must be at most 2^20, bits a power of two from 32768 on")
    spark = docs.sparkSession
    seed = 0
    while True:
        found = _count_words(docs, seed, max_words, max_chars, batch_chars)
        words = saved(found.where(F.col("word").isNull() | (F.col("n") >= least) | (F.col("kinds") > 1)), "words")
        if words.where("kinds > 1").isEmpty():
            break
        seed += 1
    totals = words.where("word IS NULL").select("lang", "n")
    out = [words.where("word IS NOT NULL").drop("kinds")]
    tables = []
    for size in range(2, longest + 1):
        names = ["w"] if size == 2 else ["w1", "w2"]
        tables.append(spark.sparkContext.broadcast(bit_table(out[-1], names, bits)))
        found = _count_phrases(docs, size, seed, tables, bits, max_words, max_chars, max_entries, burst, batch_chars)
        out.append(saved(found.where(F.col("n") >= least), f"phrases-{size}"))
    return totals, out


# ---- scores -----------------------------------------------------------------------------------


def _score(left: str, right: str) -> Column:
    """floor(a * a * 10^6 / (left * right)), exactly."""
    wide = lambda c: f"cast({c} AS decimal(16, 0))"
    return F.expr(f"({wide('a')} * {wide('a')} * 1000000) div ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, longest: int = 3, share: int = 50,
                 **limits) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score (all numbers
    long). A phrase is scored by its worst cut into l and r; one that lies in a longer candidate
    of at least ``share`` percent of its count is left out."""
    totals, counted = count(docs, least, longest, **limits)
    words, pairs = counted[:2]
    first = words.select(F.col("w").alias("w1"), "lang", F.col("word").alias("t1"), F.col("n").alias("n1"))
    second = words.select(F.col("w").alias("w2"), F.col("word").alias("t2"), F.col("n").alias("n2"))
    pairs = saved(pairs.withColumnRenamed("n", "a").join(first, "w1").join(second, "w2"), "pairs")
    shown = ("lang", "phrase", "a", "l", "r", "score")
    found = pairs.select("w1", "w2", "lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a",
                         F.col("n1").alias("l"), F.col("n2").alias("r"), _score("n1", "n2").alias("score"))
    if longest == 2:
        found = found.select(*shown)
    else:
        triples = counted[2].withColumnRenamed("n", "a")
        inside = triples.select("w1", "w2", F.col("a").alias("longer")).unionByName(
            triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("a").alias("longer")))
        inside = inside.groupBy("w1", "w2").agg(F.max("longer").alias("longer"))
        found = found.join(inside, ["w1", "w2"], "left").where(
            F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).select(*shown)
        head = pairs.select("w1", "w2", "lang", "t1", "t2", "n1", F.col("a").alias("n12"))
        rest = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("t2").alias("t3"),
                            F.col("n2").alias("n3"), F.col("a").alias("n23"))
        cut = triples.join(head, ["w1", "w2"]).join(rest, ["w2", "w3"])
        cut = cut.select("*", _score("n1", "n23").alias("s1"), _score("n12", "n3").alias("s2"))
        early = F.col("s1") <= F.col("s2")
        found = found.unionByName(cut.select(
            "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a",
            F.when(early, F.col("n1")).otherwise(F.col("n12")).alias("l"),
            F.when(early, F.col("n23")).otherwise(F.col("n3")).alias("r"), F.least("s1", "s2").alias("score")))
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    best = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):  # a language's last task ranks PARTS times ``top`` rows at most
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        best = best.withColumn("rank", place.cast("bigint")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
