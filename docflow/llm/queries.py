"""One registered query per training-data operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from docflow.llm import (attention_mil, chat_format, chunk_bpe, circulant_minhash, class_lm, fm_index,
                         fst_count, hat_trie, heap_kmeans, license_scan, line_rules, path_ratio, prefix_bpe)
from docflow.llm.common import read, registry, remainder, text_of

QUERIES, query = registry()
SQL: dict[str, str] = {}


@query
def op3_chat_format(spark, sf):
    """All conversations, and conversation -1 whose texts hold another template's marks."""
    told = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digest(chat_format.format_conversations(chat_format.text_turns(rows)))


SQL["op3_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, 32 + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'))
            + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS n FROM rows),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(n)::BIGINT AS formatted_chars
  FROM marked GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(told) AS turns_sha256,
       length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
       0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM g"""


@query
def op2_decontaminate(spark, sf):
    """All documents against all windows of ten words of all benchmark items."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    found = fm_index.find_phrases(docs, fm_index.windows(read(spark, sf, "benchmark")))
    n_hit = F.aggregate("found.words", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform("found.items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query
def op7_chunk_bpe(spark, sf, tokenizer: str = "byte_bpe_50k.json"):
    """All documents, encoded and decoded again."""
    spec = chunk_bpe.read_json(public_tokenizers.path(tokenizer))
    back = chunk_bpe.encode(read(spark, sf, "documents").select("doc_id", "text"), spec, decoded=True).drop("text")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
                       sha(F.col("decoded")).alias("decoded_sha256"))


@query
def op10_fst_count(spark, sf, tokenizer: str = "word_bpe_49k.json", limit: int = 2048):
    """Token counts of all documents, and which exceed the model's window."""
    spec = chunk_bpe.read_json(public_tokenizers.path(tokenizer))
    docs = read(spark, sf, "documents").select("doc_id", "text", F.octet_length(text_of()).cast("bigint").alias("n_bytes"))
    return fst_count.count_tokens(docs, spec).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query
def op4_attention_mil(spark, sf):
    """Quality of all documents; learnt from labels outside the held-out quarter."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    model = attention_mil.train(docs, read(spark, sf, "labels"))
    return attention_mil.score(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op6_line_rules(spark, sf):
    """All documents; their ``source`` is the host."""
    judged = line_rules.judge(read(spark, sf, "documents").select("doc_id", "source", "text"))
    return judged.select("doc.doc_id", *[c for c in judged.columns if c != "doc"])


@query
def op5_circulant_minhash(spark, sf):
    """All documents, linked at 80 % of their four-word shingles."""
    return circulant_minhash.near_duplicates(read(spark, sf, "documents"), shingle=4, percent=80)


@query
def op1_class_lm(spark, sf):
    """Class-bigram scores of all documents, learnt from all but the held-out tenth."""
    return class_lm.score(read(spark, sf, "documents").select("doc_id", "text"))


@query
def op9_path_ratio(spark, sf):
    """The main text of all pages."""
    out = path_ratio.extract(read(spark, sf, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main").alias("text"), F.length("main").cast("bigint").alias("n_chars"))


@query
def op8_license_scan(spark, sf):
    """Licence notices quoted in all documents."""
    hits = license_scan.scan(read(spark, sf, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    return hits.select("doc_id", F.size("licenses").cast("bigint").alias("n_hits"),
                       F.array_join(names, ",").alias("license_ids"), "licenses")


@query
def op13_prefix_bpe(spark, sf, tokenizer: str = "piece_bpe_32k.model"):
    """All documents, encoded by last tokens of prefixes and decoded again."""
    model = prefix_bpe.read_model(public_tokenizers.path(tokenizer))
    back = prefix_bpe.encode(read(spark, sf, "documents").select("doc_id", "text"), model, decoded=True).drop("text")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
                       sha(F.col("decoded")).alias("decoded_sha256"))


@query
def op12_hat_trie(spark, sf):
    """Collocations of two and three words of all documents, the first 2000 of each language."""
    return hat_trie.collocations(read(spark, sf, "documents").select("doc_id", "lang", "text"), top=2000)


SQL["op12_hat_trie"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM words
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM words),
f AS (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= 10),
cuts AS (
  SELECT cand.*, cut.i, array_to_string(w[1:cut.i], ' ') AS head, array_to_string(w[cut.i + 1:k], ' ') AS rest
  FROM cand, (SELECT unnest([1, 2]) AS i) cut WHERE cut.i < k),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, i, fl.c AS l, fr.c AS r,
         (a::HUGEINT * a * 1000000 // (fl.c::HUGEINT * fr.c))::BIGINT AS score
  FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = head
       JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = rest),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
longer AS (
  SELECT lang, part, max(a) AS m FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM cand WHERE k = 3)
  GROUP BY ALL),
kept AS (
  SELECT worst.* FROM worst LEFT JOIN longer ON longer.lang = worst.lang AND part = phrase
  WHERE m IS NULL OR 100 * m < 50 * a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


@query
def op11_heap_kmeans(spark, sf):
    """All vectors of 64 components in 16 clusters, three rounds."""
    return heap_kmeans.clusters_of(read(spark, sf, "embeddings").select("vec_id", "embedding"))


def _kmeans_sql(clusters: int = 16, rounds: int = 3) -> str:
    far = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - cv[i]) * (v[i] - cv[i])))"
    out = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS cv FROM kept
  QUALIFY c < {clusters})"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS (
  SELECT vec_id, v, arg_min(c, d * {clusters} + c) AS c, min(d) AS d
  FROM (SELECT vec_id, v, c, {far}::BIGINT AS d FROM kept, c{r}) GROUP BY vec_id, v)"""
        if r < rounds:
            out += f""",
s{r} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{r}) GROUP BY c, i),
m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS cv FROM s{r} GROUP BY c),
c{r + 1} AS (SELECT c, coalesce(m{r}.cv, c{r}.cv) AS cv FROM c{r} LEFT JOIN m{r} USING (c))"""
    return out + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(cv, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} USING (c)"""


SQL["op11_heap_kmeans"] = _kmeans_sql()
