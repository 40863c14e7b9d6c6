"""Byte-level BPE over content-defined chunks.

A rolling hash over the bytes cuts every text into chunks, so equal passages give equal
chunks wherever they stand. A task encodes each distinct chunk once and keeps its tokens in a
store of bounded size. Where two chunks meet, their tokens may differ from those of the whole
text: the join is repaired by re-encoding it with a guard word on either side until the
guards' tokens agree exactly with the chunks' own; failing that it widens to the whole text.

Why agreement suffices: the split pattern always starts a new piece at a single space between
two ASCII letters or digits, so pieces left of it never depend on what follows. A chunk's body
runs between its first and last such place; only what lies outside of it is encoded again.

The store is one task's: sharing it between tasks would shuffle the chunks' texts and their
tokens back, above one and a half times the input.

Defined cases: a null text is empty and has no ids; a special token's string inside a text is
that token, as in the library's default; repeated rows stay; other columns pass through (a
column called ``ids`` or ``decoded`` is replaced); an empty table gives no rows.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: Fixed value: the byte-level split pattern that goes with these vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def chunks(text: str, mean_bits: int = 10) -> list[str]:
    """``text`` cut after each byte where a gear hash of the last 32 bytes ends in
    ``mean_bits`` zero bits (moved to the next character's start)."""
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) < 64:
        return [text] if text else []
    h, width = GEAR[data], 1
    while width < 32:
        far = h.copy()
        far[width:] += h[:-width] << np.uint32(width)
        h, width = far, 2 * width
    ends = np.flatnonzero(h >> np.uint32(32 - mean_bits) == 0) + 1
    if not len(ends):
        return [text]
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(heads, ends)
    edges = np.unique(at[at < len(heads)]).tolist()
    return [text[a:b] for a, b in zip([0, *edges], [*edges, len(heads)], strict=True) if b > a]


class Encoder:
    """Encodes texts with a store of chunk bodies and joins of about ``store_chars``."""

    def __init__(self, tokenizer_json: str, store_chars: int = 8_000_000, mean_bits: int = 10):
        import tiktoken

        spec = json.loads(tokenizer_json)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE without normalizer or prefix space is needed")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {t: i for i, t in enumerate(token_bytes(tokenizer_json)) if t and i not in special.values()}
        self.lib = tiktoken.Encoding("chunks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.mean_bits, self.limit = mean_bits, store_chars
        self.bodies: dict[str, tuple] = {}
        self.joins: dict[str, np.ndarray] = {}
        self.size = self.encoded_chars = self.widened = 0

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        self.encoded_chars += sum(map(len, texts))
        return [self.lib.encode_to_numpy(t, allowed_special="all").astype(np.int32) for t in texts]

    def _learn(self, new: list[str]) -> None:
        """Split each new chunk into head, body and tail; a body is first word, middle, last
        word, so the guards' tokens are known by themselves."""
        plans, texts = [], []
        for c in new:
            at = [m.start() for m in CUT.finditer(c)]
            if len(at) < 4:
                plans.append((c, None))
                continue
            a, b, y, z = at[0], at[1], at[-2], at[-1]
            plans.append((c, (c[:a], c[a:b], c[y:z], c[z:])))
            texts += [c[a:b], c[b:y], c[y:z]]
        ids = iter(self.plain(texts))
        for c, cut in plans:
            self.size += len(c) + 200
            if cut is None:
                self.bodies[c] = ()
            else:
                first, mid, last = next(ids), next(ids), next(ids)
                self.bodies[c] = (*cut, first, last, np.concatenate([first, mid, last]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.size > self.limit:
            self.bodies.clear(), self.joins.clear()
            self.size = 0
        cut = [chunks(t, self.mean_bits) for t in texts]
        self._learn(list(dict.fromkeys(c for x in cut for c in x if c not in self.bodies)))
        plans, wanted = [], {}
        for x in cut:
            plan, glue, left = [], "", None
            for c in x:
                body = self.bodies[c]
                if not body:
                    glue += c
                    continue
                head, guard, last, tail, first_ids, last_ids, ids = body
                plan.append(((left[0] if left else "") + glue + head + guard, left and left[1], first_ids))
                plan.append(ids)
                glue, left = tail, (last, last_ids)
            plan.append(((left[0] if left else "") + glue, left and left[1], None))
            plans.append(plan)
            wanted.update((p[0], None) for p in plan if isinstance(p, tuple) and p[0] not in self.joins)
        fresh = list(wanted)
        for w, ids in zip(fresh, self.plain(fresh), strict=True):
            self.joins[w] = ids
            self.size += 2 * len(w) + 200
        return [self._joined(t, p) for t, p in zip(texts, plans, strict=True)]

    def _joined(self, text: str, plan: list) -> np.ndarray:
        out = []
        for p in plan:
            if not isinstance(p, tuple):
                out.append(p)
                continue
            window, left, right = self.joins[p[0]], p[1], p[2]
            a = 0 if left is None else len(left)
            b = len(window) if right is None else len(window) - len(right)
            if (left is not None and not np.array_equal(window[:a], left)
                    or right is not None and not np.array_equal(window[max(b, 0):], right) or b < a):
                self.widened += 1
                return self.plain([text])[0]
            out.append(window[a:b])
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def token_bytes(tokenizer_json: str) -> list[bytes]:
    """Bytes of each id. The byte-level alphabet: printable Latin-1 stands for itself, the
    other bytes for the characters from U+0100 on, in order."""
    spec = json.loads(tokenizer_json)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    vocab |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [vocab.get(i, b"") for i in range(max(vocab) + 1)]


def read_json(path: str) -> str:
    """The tokenizer file, read once by the driver (a vocabulary: some MB) and broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer_json: str, mean_bits: int = 10,
           store_chars: int = 8_000_000, decoded: bool = False) -> DataFrame:
    """``docs`` plus ``ids``: the tokens of the whole ``text``; with ``decoded`` also the text that these
    ids stand for, from the same pass (one Python worker a core instead of two)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)
    names = spark.sparkContext.broadcast(token_bytes(tokenizer_json) if decoded else [])

    def run(batches):
        coder, get = Encoder(shared.value, store_chars, mean_bits), names.value.__getitem__
        for batch in batches:
            for piece in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = coder.encode([t or "" for t in piece.column("text").to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int32), *ids])
                at = piece.schema.get_field_index("ids")
                field = piece.schema.field("ids")
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())).cast(field.type)
                out = piece.set_column(at, field, column)
                if decoded:
                    field = piece.schema.field("decoded")
                    texts = [b"".join(map(get, x.tolist())).decode("utf-8", "replace") for x in ids]
                    out = out.set_column(piece.schema.get_field_index("decoded"), field, pa.array(texts, field.type))
                yield out

    out = docs.drop("ids", *["decoded"] * decoded).withColumn("ids", F.lit(None).cast("array<int>"))
    if decoded:
        out = out.withColumn("decoded", F.lit(None).cast("string"))
    return out.mapInArrow(run, out.schema)


def decode(encoded: DataFrame, tokenizer_json: str) -> DataFrame:
    """``encoded`` plus ``decoded``: the text that its ``ids`` stand for, special tokens too."""
    shared = encoded.sparkSession.sparkContext.broadcast(token_bytes(tokenizer_json))

    def run(batches):
        get = shared.value.__getitem__
        for batch in batches:
            ids = batch.column("ids")
            texts = [b"".join(map(get, x.as_py() or ())).decode("utf-8", "replace") for x in ids]
            field = batch.schema.field("decoded")
            yield batch.set_column(batch.schema.get_field_index("decoded"), field, pa.array(texts, field.type))

    out = encoded.drop("decoded").withColumn("decoded", F.lit(None).cast("string"))
    return out.mapInArrow(run, out.schema)
