"""Token counts by a finite-state transducer compiled from a word-end BPE tokenizer.

The transducer reads the normalised text character by character. A state is what is pending
of the current piece: nothing, a run of letters, a run of other signs, or an apostrophe that
may still become a contraction. Every transition is annotated with the tokens it emits: none
while a piece goes on, the piece's BPE length when the character ends it. It is deterministic
and compiled lazily: a transition is made when a text first takes it, and stays in a hash
table of bounded size.

Texts are cut into chunks of ``chunk`` characters that all run at once. A chunk's state map
(state before -> state after, tokens) is a constant after its first white space, whatever the
state before; the part up to there runs once the state before is known. The scan over the
chunks therefore needs one wave, plus one for each chunk in a row without white space.

Defined cases: a null text is empty and has no tokens; a special token's string inside a text
counts as one token, as in the library's default; repeated rows stay; other columns pass
through (one called ``n_tokens`` is replaced); an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, LETTER, NUMBER, SIGN = range(4)
START, IN_LETTERS, IN_SIGNS, APOSTROPHE, CONTRACTION = range(5)
#: Below this, lower case and composition are one character each and stable.
PLAIN_BELOW = 0x250


class Transducer:
    #: Pieces of more signs are put together one by one.
    SHORT = 48

    def __init__(self, tokenizer_json: str, max_states: int = 1_500_000):
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.norm = Tokenizer.from_str(tokenizer_json).normalizer
        self.lib = Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))
        self.lib.no_truncation()
        self.lib.no_padding()
        self.max_states, self.classes, self.lengths = max_states, {}, {}
        self.reset()

    def reset(self) -> None:
        self.parent, self.char, self.kind = array("i", [-1]), array("i", [0]), array("b", [START])
        self.child: dict[int, int] = {}
        self.slots, self.used = 1 << 16, 0
        self._tables()

    def _tables(self) -> None:
        self.key = np.full(self.slots, -1, np.int64)
        self.next, self.emit = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)

    # -- hash table of compiled transitions ------------------------------------------------
    def _at(self, key: np.ndarray) -> np.ndarray:
        """Slot of each key, or of the empty slot where it would go."""
        mask = self.slots - 1
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & mask
        found = self.key[slot]
        miss = np.flatnonzero((found != key) & (found >= 0))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & mask
            found = self.key[slot[miss]]
            miss = miss[(found != key[miss]) & (found >= 0)]
        return slot

    def _insert(self, key: np.ndarray, nxt: np.ndarray, emit: np.ndarray) -> None:
        if (self.used + len(key)) * 2 > self.slots:
            old = self.key >= 0
            kept = self.key[old], self.next[old], self.emit[old]
            while (self.used + len(key)) * 2 > self.slots:
                self.slots *= 2
            self._tables()
            self.used = 0
            self._insert(*kept)
        self.used += len(key)
        while len(key):  # of keys that meet in one empty slot, one gets it at a time
            slot = self._at(key)
            _, first = np.unique(slot, return_index=True)
            at = slot[first]
            self.key[at], self.next[at], self.emit[at] = key[first], nxt[first], emit[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, nxt, emit = key[rest], nxt[rest], emit[rest]

    # -- compiling transitions -------------------------------------------------------------
    def class_of(self, c: str) -> int:
        """What the library's own split makes of a character."""
        if c not in self.classes:
            pieces = lambda s: len(self.lib.pre_tokenizer.pre_tokenize_str(s))
            alone = pieces(c)
            self.classes[c] = (SPACE if not alone else LETTER if pieces("a" + c) == 1
                               else SIGN if pieces("!" + c) == 1 else NUMBER)
        return self.classes[c]

    def _state(self, parent: int, c: str, kind: int) -> int:
        key = (parent << 24 | ord(c)) << 3 | kind
        if key not in self.child:
            self.child[key] = len(self.parent)
            self.parent.append(parent)
            self.char.append(ord(c))
            self.kind.append(kind)
        return self.child[key]

    def pending(self, state: int) -> str:
        out = []
        while state > 0:
            out.append(chr(self.char[state]))
            state = self.parent[state]
        return "".join(reversed(out))

    def _step(self, state: int, c: str) -> tuple[int, list[str]]:
        """Next state and the pieces that this character ends."""
        kind, cls = self.kind[state], self.class_of(c)
        if kind == START:
            if cls == SPACE:
                return 0, []
            if cls == NUMBER:
                return 0, [c]
            if c == "'":
                return self._state(0, c, APOSTROPHE), []
            return self._state(0, c, IN_LETTERS if cls == LETTER else IN_SIGNS), []
        if kind == IN_LETTERS and cls == LETTER or kind == IN_SIGNS and cls == SIGN:
            return self._state(state, c, kind), []
        if kind == APOSTROPHE:
            if c in "stmd":
                return 0, ["'" + c]
            if c in "rvl":
                return self._state(state, c, CONTRACTION), []
            if cls == SIGN:
                return self._state(self._state(0, "'", IN_SIGNS), c, IN_SIGNS), []
        if kind == CONTRACTION:
            whole = self.pending(state) + c
            if whole in ("'re", "'ve", "'ll"):
                return 0, [whole]
            nxt, ended = self._step(self._state(0, whole[1], IN_LETTERS), c)
            return nxt, ["'", *ended]
        nxt, ended = self._step(0, c)
        return nxt, [self.pending(state), *ended]

    def _pending(self, states: np.ndarray) -> list[str]:
        """The pending pieces of many states."""
        parent, char = np.frombuffer(self.parent, np.int32), np.frombuffer(self.char, np.int32)
        signs, now = [], states
        while (now > 0).any() and len(signs) <= self.SHORT:
            signs.append(np.where(now > 0, char[now], 0))
            now = np.where(now > 0, parent[now], 0)
        if not signs:
            return [""] * len(states)
        back = np.stack(signs, 1)
        size = (back > 0).sum(1)
        at = size[:, None] - 1 - np.arange(back.shape[1])
        out = np.where(at >= 0, np.take_along_axis(back, np.maximum(at, 0), 1), 0).astype(np.uint32)
        words = np.ascontiguousarray(out).view(f"<U{back.shape[1]}").ravel().tolist()
        return [w if n <= 0 else self.pending(s) for w, n, s in zip(words, now.tolist(), states.tolist(), strict=True)]

    def _count_pieces(self, pieces: list[str]) -> None:
        """Tokens of the pieces that are not known yet."""
        if len(self.lengths) > self.max_states:
            self.lengths.clear()
        new = list({p for p in pieces if p not in self.lengths})
        for p, e in zip(new, self.lib.encode_batch(new, add_special_tokens=False), strict=True):
            self.lengths[p] = len(e.ids)

    def _compile(self, keys: np.ndarray) -> None:
        """Make the transitions ``keys``: those inside a run of letters or signs and those that end
        one all at once, the others (from the start, contractions) one by one."""
        state, char = keys >> 21, keys & 0x1FFFFF
        kind = np.frombuffer(self.kind, np.int8)[state]
        signs, at = np.unique(char, return_inverse=True)
        cls = np.array([self.class_of(chr(c)) for c in signs.tolist()])[at]
        inside = (kind == IN_LETTERS) & (cls == LETTER) | (kind == IN_SIGNS) & (cls == SIGN)
        ends = ~inside & ((kind == IN_LETTERS) | (kind == IN_SIGNS))
        nxt, emit = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int32)
        nxt[inside] = np.arange(len(self.parent), len(self.parent) + inside.sum())
        for name, values in (("parent", state), ("char", char), ("kind", kind)):
            column = getattr(self, name)
            column.frombytes(values[inside].astype(column.typecode).tobytes())
        after = [self._step(0, chr(c)) for c in signs.tolist()] if ends.any() else []
        others = np.flatnonzero(~inside & ~ends)
        made = [self._step(int(s), chr(int(c))) for s, c in zip(state[others], char[others], strict=True)]
        first, which = np.unique(state[ends], return_inverse=True)
        pieces = self._pending(first)
        self._count_pieces([*pieces, *(p for _, ended in (*after, *made) for p in ended)])
        count = lambda ended: sum(self.lengths[p] for p in ended)
        if ends.any():
            nxt[ends] = np.array([n for n, _ in after])[at[ends]]
            emit[ends] = np.array([self.lengths[p] for p in pieces])[which] + np.array([count(e) for _, e in after])[at[ends]]
        nxt[others], emit[others] = [n for n, _ in made], [count(e) for _, e in made]
        self._insert(keys, nxt, emit)

    # -- running ---------------------------------------------------------------------------
    def run(self, text: np.ndarray, start: np.ndarray, stop: np.ndarray, state: np.ndarray):
        """Run all stretches [start, stop) from their states; (state after, tokens) of each."""
        after, total = state.astype(np.int64), np.zeros(len(start), np.int64)
        live = np.flatnonzero(start < stop)
        pos, end, now, n = start[live], stop[live], after[live], total[live]
        while len(live):
            key = now << 21 | text[pos]
            slot = self._at(key)
            lacking = self.key[slot] != key
            if lacking.any():
                self._compile(np.unique(key[lacking]))
                slot = self._at(key)
            now = self.next[slot].astype(np.int64)
            n += self.emit[slot]
            pos += 1
            done = pos == end
            if done.any():
                after[live[done]], total[live[done]] = now[done], n[done]
                keep = ~done
                live, pos, end, now, n = live[keep], pos[keep], end[keep], now[keep], n[keep]
        return after, total

    def normal(self, text: str) -> str:
        """The library's normal form; white space need not be folded, as it is dropped."""
        if text.isascii() or max(text) < chr(PLAIN_BELOW) and "İ" not in text:
            return text.lower()
        return self.norm.normalize_str(text)

    def count(self, texts: list[str], chunk: int = 512) -> np.ndarray:
        """Tokens of each whole text."""
        if len(self.parent) > self.max_states:
            self.reset()
        pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if self.special and any(s in t for s in self.specials):
                extra[i] = len(self.special.findall(t))
                pieces += self.special.split(t)
                owner += [i] * (extra[i] + 1)
            else:
                pieces.append(t)
                owner.append(i)
        pieces = [self.normal(p) + " " for p in pieces]
        if not pieces:
            return extra
        size = np.array([len(p) for p in pieces])
        text = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(size) - size
        n = -(-size // chunk)
        lane = np.repeat(np.arange(len(pieces)), n)
        start = first[lane] + chunk * (np.arange(len(lane)) - np.repeat(np.cumsum(n) - n, n))
        stop = np.minimum(start + chunk, (first + size)[lane])
        spaces = np.append(np.flatnonzero(text == 32), len(text))
        sync = spaces[np.searchsorted(spaces, start)] + 1
        head = start == first[lane]
        sync[head] = start[head]
        constant = sync <= stop
        zero = np.zeros(len(lane), np.int64)
        after, total = self.run(text, np.where(constant, sync, stop), stop, zero)
        known = constant.copy()
        todo = ~head
        while todo.any():  # the scan: chunks whose state before is known
            ready = np.flatnonzero(todo & np.concatenate([[True], known[:-1]]))
            end, got = self.run(text, start[ready], np.minimum(sync[ready], stop[ready]), after[ready - 1])
            total[ready] += got
            fixed = constant[ready]
            after[ready[~fixed]] = end[~fixed]
            known[ready], todo[ready] = True, False
        return extra + np.bincount(np.array(owner)[lane], total, len(texts)).astype(np.int64)


def count_tokens(docs: DataFrame, tokenizer_json: str, batch_chars: int = 2_000_000,
                 chunk: int = 512, max_states: int = 1_500_000) -> DataFrame:
    """``docs`` plus ``n_tokens`` of the whole ``text``. One narrow stage, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        machine = Transducer(shared.value, max_states)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, held, size = [], [], 0
            for t in texts:
                held.append(t)
                size += len(t)
                if size >= batch_chars:
                    counts.append(machine.count(held, chunk))
                    held, size = [], 0
            counts.append(machine.count(held, chunk))
            field = batch.schema.field("n_tokens")
            yield batch.set_column(batch.schema.get_field_index("n_tokens"), field,
                                   pa.array(np.concatenate(counts), field.type))

    out = docs.drop("n_tokens").withColumn("n_tokens", F.lit(None).cast("bigint"))
    return out.mapInArrow(run, out.schema)
