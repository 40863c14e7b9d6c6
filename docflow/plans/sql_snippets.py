"""Shared DuckDB SQL fragments for the oracles (same contracts as the Spark operators)."""

MAX_TOKENS = 400
OVERLAP = 40
STEP = MAX_TOKENS - OVERLAP

def chunks_cte(name: str = "chunks", src: str = "documents") -> str:
    """C1 in SQL over ``src`` (doc_id, text)."""
    return CHUNKS_CTE.replace("chunks AS (", f"{name} AS (", 1).replace(
        "FROM documents", f"FROM {src}", 1)


CHUNKS_CTE = rf"""
chunks AS (
  SELECT printf('%s_chunk_%04d', doc_id::VARCHAR, i) AS chunk_id, doc_id, i::BIGINT AS chunk_index,
         array_to_string(toks[i*{STEP}+1 : i*{STEP}+{MAX_TOKENS}], ' ') AS text,
         len(toks[i*{STEP}+1 : i*{STEP}+{MAX_TOKENS}])::BIGINT AS n_tokens
  FROM (SELECT doc_id, toks,
               unnest(range(0, greatest(ceil((len(toks) - {MAX_TOKENS}) / {STEP}), 0)::BIGINT + 1)) AS i
        FROM (SELECT doc_id, string_split(text, ' ') AS toks FROM documents
              WHERE text IS NOT NULL AND length(text) >= 1))
)"""


SPACE = (r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
         r"\x{202F}\x{205F}\x{3000}]+")


def kwset(col: str) -> str:
    return (rf"list_distinct(list_transform(list_filter(regexp_split_to_array({col}, '{SPACE}'), "
            rf"lambda t: length(t) > 2), lambda t: lower(t)))")


WORD_RE = "[A-Za-z][A-Za-z0-9_-]{2,}"


def words(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '{WORD_RE}')"


def md5_counts_cte(name: str, src: str, key: str, dim: int = 384) -> str:
    """Signed md5 bucket counts: key, idx, cnt (cnt <> 0)."""
    return rf"""
{name} AS (
  SELECT {key}, idx, sum(sgn)::BIGINT AS cnt FROM (
    SELECT {key}, (('0x' || substr(md5(tok), 1, 8))::UBIGINT % {dim})::BIGINT AS idx,
           CASE WHEN (('0x' || substr(md5(tok), 9, 2))::UBIGINT % 2) = 1 THEN 1 ELSE -1 END AS sgn
    FROM (SELECT {key}, unnest({words('text')}) AS tok FROM {src}))
  GROUP BY ALL HAVING sum(sgn) <> 0
)"""


def keyword_matches_cte(q_src: str = "q", c_src: str = "chunks") -> str:
    """m: query_id, chunk_id, doc_id, chunk_index, score for pairs sharing a token."""
    return rf"""
qt AS (SELECT query_id, len(qs) AS nq, unnest(qs) AS tok FROM (SELECT query_id, {kwset('text')} AS qs FROM {q_src})),
ct AS (SELECT chunk_id, doc_id, chunk_index, unnest({kwset('text')}) AS tok FROM {c_src}),
m AS (SELECT query_id, chunk_id, doc_id, chunk_index, count(*) / any_value(nq) AS score
      FROM qt JOIN ct USING (tok) GROUP BY query_id, chunk_id, doc_id, chunk_index)"""


# The masking patterns of functions/pii.py as RE2 has them.
EMAIL_RE2 = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CARD_RE2 = r"\b(?:\d[ -]*?){13,16}\b"
# RE2 has no look-around: the phone rule uses capture groups and is applied twice.
PHONE_RE2 = r"(^|\D)(?:\+?\d[\s\-()]?){9,14}\d(\D|$)"


def redact_sql(x: str) -> str:
    e = f"regexp_replace({x}, '{EMAIL_RE2}', '[EMAIL]', 'g')"
    c = f"regexp_replace({e}, '{CARD_RE2}', '[CARD]', 'g')"
    p1 = f"regexp_replace({c}, '{PHONE_RE2}', '\\1[PHONE]\\2', 'g')"
    return f"regexp_replace({p1}, '{PHONE_RE2}', '\\1[PHONE]\\2', 'g')"


def norm_sql(x: str) -> str:
    return rf"lower(trim(regexp_replace({x}, '{SPACE}', ' ', 'g')))"


def fixed3_sql(x: str) -> str:
    return f"printf('%.3f', round(({x})::DECIMAL(20, 9), 3)::DOUBLE)"


def keyword_topk_ctes(q_sql: str, k: int = 5) -> str:
    """chunks, q, m, allp, top: top-k chunks per query by keyword overlap with zero fill."""
    return f"""{CHUNKS_CTE},
q AS ({q_sql}),
{keyword_matches_cte()},
allp AS (SELECT q.query_id, c.chunk_id, c.doc_id, c.chunk_index, c.text AS chunk_text,
                coalesce(m.score, 0.0) AS score
         FROM q CROSS JOIN chunks c
         LEFT JOIN m ON m.query_id = q.query_id AND m.chunk_id = c.chunk_id),
top AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS rank
  FROM allp) WHERE rank <= {k})"""
