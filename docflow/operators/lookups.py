"""Tool lookups and pricing (JN5, JN6, W2, JN8, J8, V4).

* counterparty lookup: LEFT JOIN on ``lower(name)``, one directory row per name; Spark picks
  the join from the sizes it sees;
* clause lookup: score = number of query tokens (duplicates counted) that occur as a
  substring of the entry text. Tokens meet the library's distinct words, not its texts, in one
  join on character n-grams. A query of one distinct token reads its rows from that token's
  list of first entries. For the others, entries that hold the same asked tokens score alike for every
  query, so of each such kind only the first ``top_k`` go on. These are broadcast in slices of
  bounded bytes, and only the best ``top_k`` entries of each query leave a task - no
  (query, entry) rows;
* pricing: LEFT JOIN of a fixed price table with a default-model fallback.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.functions.text import SPACE_RUN
from docflow.operators.retrieval import BLOCK_CELLS, best_rows
from docflow.session import saved, slices_of, spread

# USD per 1K tokens (input, output), and the fallback model.
PRICES = (
    ("gpt-4o", 0.005, 0.015),
    ("gpt-4o-mini", 0.00015, 0.0006),
    ("gpt-4-turbo", 0.01, 0.03),
    ("text-embedding-3-large", 0.00013, 0.0),
    ("text-embedding-3-small", 0.00002, 0.0),
)
DEFAULT_MODEL = "gpt-4o"
DEFAULT_CLAUSE_TOP_K = 3
GRAM = 3
MAX_LIBRARY_BYTES = 32 << 20


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "model string, usd_in_per_1k double, usd_out_per_1k double")


def with_cost(df: DataFrame, prices: DataFrame, model_col: str = "model",
              tokens_in: str = "tokens_in", tokens_out: str = "tokens_out") -> DataFrame:
    """JN8+J8: cost_usd = in/1000*p_in + out/1000*p_out; unknown model -> default price."""
    p = prices.select(F.col("model").alias("_pm"), "usd_in_per_1k", "usd_out_per_1k")
    d = p.where(F.col("_pm") == DEFAULT_MODEL).select(
        F.col("usd_in_per_1k").alias("_din"), F.col("usd_out_per_1k").alias("_dout"))
    din = d.select("_din").scalar()
    dout = d.select("_dout").scalar()
    j = df.join(p, F.col(model_col) == F.col("_pm"), "left")
    pin = F.coalesce(F.col("usd_in_per_1k"), din)
    pout = F.coalesce(F.col("usd_out_per_1k"), dout)
    cost = (F.col(tokens_in) / F.lit(1000.0)) * pin + (F.col(tokens_out) / F.lit(1000.0)) * pout
    return j.withColumn("cost_usd", cost).drop("_pm", "usd_in_per_1k", "usd_out_per_1k")


def counterparty_lookup(calls: DataFrame, directory: DataFrame, name_col: str = "entity_name") -> DataFrame:
    """JN5: status 'known' plus the directory record, or 'unknown'.

    directory: entity_name and any record columns; keyed by lower(entity_name). Of entries
    whose names differ in case only the first in order counts, so no call is multiplied.
    """
    rec = F.struct(F.col("entity_name").alias("known_name"), *[c for c in directory.columns if c != "entity_name"])
    d = directory.groupBy(F.lower("entity_name").alias("_key")).agg(F.min(rec).alias("_rec"))
    j = calls.join(d.select("_key", "_rec.*"), F.lower(F.col(name_col)) == F.col("_key"), "left")
    status = F.when(F.col("_key").isNull(), F.lit("unknown")).otherwise(F.lit("known"))
    return j.withColumn("status", status).drop("_key")


class ClauseSlice:
    """Library entries (clause_id, position, asked tokens held) in position order and, per token,
    the kinds of entries that hold it."""

    def __init__(self, rows: list):
        self.rows = sorted(rows, key=lambda r: (r[1], r[0]))
        kinds: dict[tuple, int] = {}
        self.kind_of = np.array([kinds.setdefault(tuple(r[2]), len(kinds)) for r in self.rows], np.int64)
        self.n_kinds = len(kinds)
        self.holding: dict[str, list[int]] = {}
        for held, kind in kinds.items():
            for t in held:
                self.holding.setdefault(t, []).append(kind)

    def score(self, queries: list[list[str]]) -> np.ndarray:
        """(query, entry): tokens of the query that the entry's text contains, repeats too. Added token by
        token to the kinds that hold it: no token x entry matrix."""
        asked: dict[str, dict[int, int]] = {}
        for i, q in enumerate(queries):
            for t, n in Counter(q).items():
                if t in self.holding:
                    asked.setdefault(t, {})[i] = n
        out = np.zeros((len(queries), self.n_kinds), np.int32)
        for t, who in asked.items():
            out[np.ix_(list(who), self.holding[t])] += np.array(list(who.values()), np.int32)[:, None]
        return out[:, self.kind_of]


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE_RUN, -1), lambda t: F.length(t) > 0)


def holding_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(word, tok): the distinct ``words`` that contain the distinct ``tokens`` as a substring. A token
    meets the words that hold its rarest n-gram; no token x word rows."""
    part = lambda c, i: F.substring(c, i, F.lit(GRAM))
    of_word = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.array(
        *[F.substring("word", i, F.lit(n + 1)) for n in range(GRAM)]))))
    of_token = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("tok") - GRAM + 1, F.lit(1))), lambda i: part("tok", i)))
    grams = words.select("word", F.explode(of_word).alias("gram"))
    sizes = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (tokens.select("tok", F.size(of_token).alias("need"), F.explode(of_token).alias("gram")).join(sizes, "gram")
              .groupBy("tok", "need").agg(F.count("*").alias("found"), F.min(F.struct("n", "gram")).alias("least"))
              .where("found = need").select("tok", "least.gram"))
    return rarest.join(grams, "gram").where(F.contains("word", "tok")).select("word", "tok")


def _first(library: DataFrame, same: str, most: int) -> DataFrame:
    """The first ``most`` entries of each value of ``same``; tasks drop the others before the shuffle."""
    order = Window.partitionBy(same).orderBy("position", "clause_id")
    return library.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def _entries(library: DataFrame, most: int) -> DataFrame:
    """The library's entries (``_e``: a number of its own, clause_id, position, words: the distinct ones
    of its text); of entries with the same words the first ``most`` by position."""
    lib = spread(library.select("clause_id", "position", "text"))
    lib = _first(lib.select("clause_id", "position", F.array_sort(F.array_distinct(_words("text"))).alias("words")), "words", most)
    return saved(lib.withColumn("_e", F.monotonically_increasing_id()), "clauses")


def entry_kinds(tokens: DataFrame, library: DataFrame, most: int) -> DataFrame:
    """clause_id, position, held: the library's entries with the ``tokens`` (tok, distinct) that their
    texts contain. A token has no white space, so a text contains it if one of its words does. Of
    entries that hold the same tokens the first ``most`` by position: the others' scores are the
    same for every query, so they come after these in every list of ``most``."""
    return _kinds(tokens, _entries(library, most), most)


def _kinds(tokens: DataFrame, lib: DataFrame, most: int) -> DataFrame:
    sets = lib.select("words").distinct().select("words", F.explode("words").alias("word"))
    holds = holding_words(tokens, lib.select(F.explode("words").alias("word")).distinct())
    holds = holds.groupBy("word").agg(F.collect_list("tok").alias("toks"))
    held = sets.join(holds, "word").groupBy("words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("toks")))).alias("held"))
    lib = lib.join(held, "words", "left").select(
        "clause_id", "position", F.coalesce("held", F.array().cast("array<string>")).alias("held"))
    return saved(_first(lib, "held", most), "clause-kinds")


def first_holding(tokens: DataFrame, lib: DataFrame, most: int) -> DataFrame:
    """tok, held: of each of the ``tokens`` that an entry's text contains, the first ``most`` such entries
    (position, clause_id, _e). One that is among a token's first is so among those of its word that
    contains the token, so a word meets tokens with ``most`` entries at most."""
    order = ("position", "clause_id", "_e")
    by_word = lib.select(F.explode("words").alias("word"), *order).withColumn(
        "_n", F.row_number().over(Window.partitionBy("word").orderBy(*order))).where(F.col("_n") <= most)
    holds = holding_words(tokens, lib.select(F.explode("words").alias("word")).distinct())
    by_token = holds.join(by_word, "word").withColumn(  # an entry comes once for each of its words
        "_n", F.dense_rank().over(Window.partitionBy("tok").orderBy(*order))).where(F.col("_n") <= most)
    return by_token.groupBy("tok").agg(F.array_sort(F.collect_set(F.struct(*order))).alias("held"))


def _listed(q: DataFrame, lib: DataFrame, most: int) -> DataFrame:
    """Queries of one distinct token or none: the first entries that hold it, then the library's first.
    Their rows are read from a list per token: no scores of whole libraries."""
    order = ("position", "clause_id", "_e")
    q = q.select("query_id", F.try_element_at("toks", F.lit(1)).alias("tok"), F.size("toks").cast("bigint").alias("_times"), "_k")
    lists = first_holding(q.where(F.col("tok").isNotNull()).select("tok").distinct(), lib, most)
    head = lib.orderBy(*order).limit(most).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("head"))
    q = q.join(lists, "tok", "left").crossJoin(F.broadcast(head))
    held = F.coalesce("held", F.slice("head", 1, 0))
    scored = lambda entries, score: F.transform(entries, lambda e: F.struct(
        e["clause_id"].alias("clause_id"), e["position"].alias("position"), score.alias("score")))
    rows = F.concat(scored(held, F.col("_times")), scored(F.array_except("head", held), F.lit(0).cast("bigint")))
    q = q.select("query_id", "_k", F.explode(F.slice(rows, F.lit(1), F.greatest("_k", F.lit(0)))).alias("e"))
    return q.select("query_id", "e.*", "_k")


def clause_lookup(queries: DataFrame, library: DataFrame, default_top_k: int = DEFAULT_CLAUSE_TOP_K,
                  max_library_bytes: int = MAX_LIBRARY_BYTES) -> DataFrame:
    """JN6+W2: per query its ``top_k`` (column, default 3) entries by score desc, stable by
    library position; zero-score entries still fill the list.
    Output: query_id, clause_id, position, score, rank."""
    top_k = (F.coalesce(F.col("top_k"), F.lit(default_top_k)) if "top_k" in queries.columns
             else F.lit(default_top_k))
    q = queries.select("query_id", _words("query").alias("toks"), top_k.cast("int").alias("_k"))
    several = F.size(F.array_distinct("toks")) > 1
    asked = q.agg(F.max("_k").alias("most"), F.count_if(several).alias("several"), F.count("*").alias("n")).first()
    most = max(asked["most"] or 0, 0)
    lib = _entries(library, most)
    found = []
    if asked["several"]:
        kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema.fields, *library.schema.fields)}
        found.append(_scored(q.where(several), lib, most, kinds, max_library_bytes))
    if asked["n"] > asked["several"] or not found:
        found.append(_listed(q.where(~several), lib, most))
    found = found[0].unionByName(found[1]) if len(found) > 1 else found[0]
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "position", "clause_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= F.col("_k")).drop("_k")


def _scored(q: DataFrame, lib: DataFrame, most: int, kinds: dict[str, str], max_library_bytes: int) -> DataFrame:
    """Queries scored against the kinds of entries, slice by slice."""
    spark = q.sparkSession
    lib = _kinds(q.select(F.explode("toks").alias("tok")).distinct(), lib, most)
    q = spread(q)
    schema = f"query_id {kinds['query_id']}, clause_id {kinds['clause_id']}, position {kinds['position']}, score bigint, _k int"

    def kernel(shared):
        def run(batches):
            block = ClauseSlice(shared.value)
            for pdf in batches:
                step = max(1, BLOCK_CELLS // max(1, len(block.rows)))
                for at in range(0, len(pdf) if block.rows else 0, step):
                    part = pdf.iloc[at:at + step]
                    s = block.score(list(part["toks"]))
                    k = part["_k"].to_numpy()
                    row, col = best_rows(s, int(max(k.max(), 0)))
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    row, col = row[place < k[row]], col[place < k[row]]
                    yield pd.DataFrame({
                        "query_id": part["query_id"].to_numpy()[row],
                        "clause_id": pd.Series([block.rows[c][0] for c in col], dtype=object),
                        "position": pd.Series([block.rows[c][1] for c in col], dtype=object),
                        "score": s[row, col].astype(np.int64), "_k": k[row]})
        return run

    found = None
    for part in slices_of(lib, "clause_id", F.length(F.array_join("held", "-")) * 8 + 64, max_library_bytes):
        shared = spark.sparkContext.broadcast([(r[0], r[1], r[2]) for r in part.collect()])
        rows = q.mapInPandas(kernel(shared), schema)
        found = rows if found is None else found.unionByName(rows)
    return found


def validate_tool_args(name: Column, arguments: Column) -> Column:
    """V4: argument validation per tool -> error message or null.

    lookup_clause_library: query (string, >= 3 chars), top_k (int 1..10, default 3);
    check_counterparty_history: entity_name (string, >= 2 chars). Malformed JSON or a
    missing/short field is an error value, never an exception.
    """
    keys = F.json_object_keys(arguments)
    q = F.get_json_object(arguments, "$.query")
    k = F.get_json_object(arguments, "$.top_k")
    e = F.get_json_object(arguments, "$.entity_name")
    k_int = k.try_cast("int")
    bad_json = keys.isNull()
    clause_err = (F.when(bad_json, F.lit("invalid arguments: malformed JSON"))
                   .when(q.isNull() | (F.char_length(q) < 3), F.lit("invalid arguments: query"))
                   .when(k.isNotNull() & (k_int.isNull() | (k_int < 1) | (k_int > 10)),
                         F.lit("invalid arguments: top_k")))
    party_err = (F.when(bad_json, F.lit("invalid arguments: malformed JSON"))
                  .when(e.isNull() | (F.char_length(e) < 2), F.lit("invalid arguments: entity_name")))
    return (F.when(name == "lookup_clause_library", clause_err)
             .when(name == "check_counterparty_history", party_err)
             .otherwise(F.concat(F.lit("unknown tool: "), name)))
