"""SentencePiece BPE by a table of last tokens.

Every prefix of a text has one BPE encoding, and the encodings of its own prefixes are its
heads: so it is enough to keep, for each prefix, its unique last token. An automaton over the
vocabulary gives the tokens that end at a position; of these, the one is right that may stand
after the last token of the prefix before it. The ids are recovered backwards, from the whole
text's last token to the prefix that it leaves, and so on.

Which pairs may stand together: a pair is compatible if the merges of both strings written
together end in just these two tokens. As merges go by score alone (then by place), symbols
that never merge across a border are merged as if alone; so an encoding is right exactly if
all its neighbours are compatible. A token's own merges are found once; a pair's verdict runs
both side by side and is kept.

Texts are cut where no token can lie across: before white space that follows another sign, if
no piece has white space behind another sign, and around characters that no piece holds (these
become bytes). Equal stretches are encoded once a task, in a store of bounded size; a stretch
of any length takes time in proportion to it.

Defined cases: a null text is empty and has no ids; marks of begin and end inside a text are
ordinary text; repeated rows stay; other columns pass through (one called ``ids`` or
``decoded`` is replaced); an empty table gives no rows. Decoding follows the library: control
ids are silent, an unknown id gives its stated surface, bytes that are no UTF-8 give U+FFFD
each, the prefix blank goes.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain, groupby
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Field numbers and piece kinds of the model file's format.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MODEL_TYPE, BYTE_FALLBACK, UNK_SURFACE, BPE = 3, 35, 44, 2
CHARSMAP, DUMMY_PREFIX, EXTRA_BLANKS, ESCAPE = 2, 3, 4, 5
NEVER = float("-inf")


def read_model(path: str) -> bytes:
    """The model file, read once by the driver (a vocabulary: some MB) and broadcast."""
    with open(path, "rb") as f:
        return f.read()


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message in the protobuf wire format."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _number(data, at)
        else:
            size = 8 if kind == 1 else 4
            if kind == 2:
                size, at = _number(data, at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


class Vocabulary:
    """Pieces, scores and settings of a model file."""

    def __init__(self, model: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normal = {}, {}
        for field, value in fields(model):
            if field == PIECE:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
            elif field == TRAINER:
                trainer = dict(fields(value))
            elif field == NORMALIZER:
                normal = dict(fields(value))
        if (trainer.get(MODEL_TYPE) != BPE or not trainer.get(BYTE_FALLBACK) or normal.get(CHARSMAP)
                or normal.get(EXTRA_BLANKS, 1) or not normal.get(ESCAPE, 1)
                or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}):
            raise ValueError("a BPE model with byte fallback, identity normalizer and ordinary pieces is needed")
        self.prefix = bool(normal.get(DUMMY_PREFIX, 1))
        self.unknown = trainer.get(UNK_SURFACE, b" \xe2\x81\x87 ").decode()
        self.byte_id = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}


class Pairs:
    """Verdicts on pairs of tokens: a hash table over arrays."""

    def __init__(self, slots: int = 1 << 12):
        self.keys, self.fits, self.used = np.full(slots, -1, np.int64), np.zeros(slots, bool), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, or the empty slot where it would go."""
        mask = len(self.keys) - 1
        slot = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & mask
        at = self.keys[slot]
        miss = np.flatnonzero((at != keys) & (at >= 0))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & mask
            at = self.keys[slot[miss]]
            miss = miss[(at != keys[miss]) & (at >= 0)]
        return slot

    def add(self, keys: np.ndarray, fits: np.ndarray) -> None:
        """Add distinct keys that the table lacks."""
        if (self.used + len(keys)) * 2 > len(self.keys):
            held = self.keys >= 0
            old = self.keys[held], self.fits[held]
            self.__init__(1 << int((self.used + len(keys)) * 4).bit_length())
            self.add(*old)
        self.used += len(keys)
        while len(keys):  # of keys that meet in one empty slot, one gets it at a time
            slot = self._slots(keys)
            self.keys[slot] = keys
            won = self.keys[slot] == keys
            self.fits[slot[won]] = fits[won]
            keys, fits = keys[~won], fits[~won]

    def verdicts(self, keys: np.ndarray, decide) -> np.ndarray:
        """Verdict of each key; ``decide`` gives those that are new."""
        slot = self._slots(keys)
        new = self.keys[slot] != keys
        if new.any():
            fresh = np.unique(keys[new])
            self.add(fresh, np.array([decide(k >> 32, k & 0xFFFFFFFF) for k in fresh.tolist()], bool))
            slot = self._slots(keys)
        return self.fits[slot]


class Automaton:
    """An automaton over the pieces as arrays, to run many texts at once: ``step`` follows the
    characters; ``piece`` and ``shorter`` list the pieces that end in a state, longest first."""

    def __init__(self, pieces: dict[str, int]):
        edges: dict[tuple[int, str], int] = {}
        parent, token = [(0, "")], [-1]
        for p, i in sorted(pieces.items(), key=lambda x: len(x[0])):
            at = 0
            for c in p:
                nxt = edges.get((at, c))
                if nxt is None:
                    nxt = edges[at, c] = len(parent)
                    parent.append((at, c))
                    token.append(-1)
                at = nxt
            token[at] = i
        order = sorted(range(1, len(parent)), key=self._depths(parent).__getitem__)
        fail = [0] * len(parent)
        for n in order:
            up, c = parent[n]
            while up:
                up = fail[up]
                if (up, c) in edges:
                    fail[n] = edges[up, c]
                    break
        ending = [0] * len(parent)  # the nearest state on the way of failures that is a piece
        for n in order:
            ending[n] = n if token[n] >= 0 else ending[fail[n]]
        self.fail, self.ending = np.array(fail, np.int64), np.array(ending, np.int64)
        self.shorter = self.ending[self.fail]
        self.piece = np.array(token, np.int64)
        keys = np.array([n << 21 | ord(c) for n, c in edges], np.int64)
        self.table = Pairs(1 << int(len(keys) * 3).bit_length())
        self.table.add(keys, np.zeros(len(keys), bool))
        self.next = np.zeros(len(self.table.keys), np.int64)
        self.next[self.table._slots(keys)] = list(edges.values())
        self._lists = None

    def lists(self) -> SimpleNamespace:
        """The same as lists and a dictionary, for one text by itself."""
        if self._lists is None:
            held = self.table.keys >= 0
            self._lists = SimpleNamespace(
                next=dict(zip(self.table.keys[held].tolist(), self.next[held].tolist(), strict=True)), fail=self.fail.tolist(),
                ending=self.ending.tolist(), shorter=self.shorter.tolist(), piece=self.piece.tolist())
        return self._lists

    @staticmethod
    def _depths(parent: list[tuple[int, str]]) -> list[int]:
        out = [0] * len(parent)
        for n in range(1, len(parent)):  # a node is made after its parent
            out[n] = out[parent[n][0]] + 1
        return out

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            key = state << 21 | char
            slot = self.table._slots(key)
            there = self.table.keys[slot] == key
            out[todo[there]] = self.next[slot[there]]
            on = ~there & (state > 0)
            todo, state, char = todo[on], self.fail[state[on]], char[on]
        return out


class _Store(dict):
    """Stretch -> its number; a new one gets the next and is noted in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, stretch: str) -> int:
        self[stretch] = number = len(self)
        self.fresh.append(stretch)
        return number


class Encoder:
    """Encodes texts; keeps verdicts on pairs and the ids of stretches, both of bounded size.
    Stretches of up to ``SHORT`` signs are worked on together, character by character, and those
    that begin alike share their table; longer ones go through it by themselves."""

    SHORT = 48

    def __init__(self, model: bytes, store_chars: int = 12_000_000, max_pairs: int = 1_000_000):
        self.vocab = Vocabulary(model)
        v = self.vocab
        self.score = {p: v.scores[i] for i, p in enumerate(v.pieces) if v.kinds[i] == NORMAL}
        self.id = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == NORMAL}
        # A sign that only longer pieces hold still takes part in merges; by itself it is bytes.
        self.text = list(v.pieces)
        for c in sorted({c for p in self.id for c in p} - set(self.id)):
            self.id[c] = len(self.text)
            self.text.append(c)
        self.size = np.array([len(t) for t in self.text])
        self.automaton = Automaton(self.id)
        known = "".join(sorted(re.escape(c) for c in {c for p in self.id for c in p} - {BLANK}))
        free = any(BLANK in p.lstrip(BLANK) for p in self.id)
        run = rf"[{BLANK}{known}]+" if free else rf"{BLANK}+[{known}]*|[{known}]+"
        self.cut = re.compile(rf"{run}|.", re.DOTALL)
        self.limit, self.max_pairs = store_chars, max_pairs
        self.pairs, self.histories = Pairs(), {}
        self._reset()

    def _reset(self) -> None:
        self.store, self.held = _Store(), 0
        self.ids, self.starts, self.counts = array("i"), array("q"), array("q")

    # -- which tokens may stand together ------------------------------------------------------
    def _merge(self, symbols: list[str]) -> Iterator[int]:
        """Run the merges on ``symbols`` in place: best score first, then leftmost. Yields the
        index of the symbol that each merge makes."""
        score = self.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            yield at

    def _history(self, token: int) -> tuple[bool, list[float], list[str], list[str]]:
        """The token's own merges: whether they end in it, their scores in order, and the symbols
        at its left and right edge before the first and after each."""
        known = self.histories.get(token)
        if known is None:
            symbols = list(self.text[token])
            scores, left, right = [], [symbols[0]], [symbols[-1]]
            for at in self._merge(symbols):
                scores.append(self.score[symbols[at]])
                left.append(symbols[0])
                right.append(symbols[-1])
            known = self.histories[token] = (len(symbols) == 1, [*scores, NEVER], left, right)
        return known

    def whole(self, token: int) -> bool:
        """Whether the token is the encoding of its own string."""
        return self._history(token)[0]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' strings together end in these two tokens: both
        histories run side by side, best score first and of equal scores the leftmost, and at no
        time is a merge across the border next."""
        a_whole, a_scores, _, a_edges = self._history(left)
        b_whole, b_scores, b_edges, _ = self._history(right)
        if not (a_whole and b_whole):
            return False
        i = j = 0
        get = self.score.get
        while True:
            a, b, across = a_scores[i], b_scores[j], get(a_edges[i] + b_edges[j], NEVER)
            if across > a and across >= b:
                return False
            if a == b == NEVER:
                return True
            if a >= b:
                i += 1
            else:
                j += 1

    # -- last tokens ----------------------------------------------------------------------------
    def _ending(self, rows: np.ndarray, place: int, state: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The one token that ends at ``place`` of each row and fits what stands before it:
        ``last`` holds the rows' last tokens at the places before."""
        out = np.full(len(rows), -1, np.int64)
        at, todo = self.automaton.ending[state], np.arange(len(rows))
        while len(todo):
            token = self.automaton.piece[at]
            before = place - self.size[token]
            left = last[rows[todo], np.maximum(before, 0)].astype(np.int64)
            alone = before < 0
            fits = self.pairs.verdicts(np.where(alone, token, left) << 32 | token, self.compatible)
            if alone.any():
                fits[alone] = [self.whole(t) for t in token[alone].tolist()]
            out[todo[fits]] = token[fits]
            at, todo = self.automaton.shorter[at[~fits]], todo[~fits]
        return out

    def last_tokens(self, words: list[str]) -> np.ndarray:
        """For each of the sorted ``words`` and each place in it the last token of the prefix up
        to and with that place. A prefix that the word before has too is looked up there."""
        sizes = np.array([len(w) for w in words])
        chars = np.array(words).view(np.uint32).reshape(len(words), -1).astype(np.int64)
        differ = chars[1:] != chars[:-1]
        shared = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), chars.shape[1])])
        last = np.full(chars.shape, -1, np.int32)
        state, number = np.zeros(len(words), np.int64), np.arange(len(words))
        for place in range(chars.shape[1]):
            own = shared <= place
            rows = np.flatnonzero(own & (sizes > place))
            state[rows] = self.automaton.step(state[rows], chars[rows, place])
            last[rows, place] = self._ending(rows, place, state[rows], last)
            of = np.maximum.accumulate(np.where(own, number, 0))
            state, last[:, place] = state[of], last[of, place]
        return last

    def _last_of_long(self, word: str) -> list[int]:
        """The last tokens of one long stretch."""
        auto, size = self.automaton.lists(), self.size.tolist()
        last, verdicts, state = [], {}, 0
        for place, c in enumerate(word):
            nxt = auto.next.get((state << 21) + ord(c))
            while nxt is None:  # a single character's state at the latest
                state = auto.fail[state]
                nxt = auto.next.get((state << 21) + ord(c))
            state = nxt
            at = auto.ending[state]
            while True:
                token = auto.piece[at]
                before = place - size[token]
                if before < 0:
                    fits = self.whole(token)
                else:
                    key = last[before] << 32 | token
                    fits = verdicts.get(key)
                    if fits is None:
                        fits = verdicts[key] = self.compatible(last[before], token)
                if fits:
                    break
                at = auto.shorter[at]
            last.append(token)
        return last

    # -- ids, backwards ---------------------------------------------------------------------------
    def _backwards(self, last: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words in a row, number of tokens of each)."""
        steps, place, rows = [], sizes - 1, np.arange(len(sizes))
        counts = np.zeros(len(sizes), np.int64)
        while len(rows):
            token = last[rows, place]
            steps.append((rows, counts[rows], token))
            counts[rows] += 1
            place = place - self.size[token]
            more = place >= 0
            rows, place = rows[more], place[more]
        ends = np.cumsum(counts)
        out = np.zeros(ends[-1], np.int64)
        for rows, step, token in steps:
            out[ends[rows] - 1 - step] = token
        return out, counts

    def _ids(self, tokens: list[int]) -> list[int]:
        """Ids of tokens: signs without a piece of their own are bytes."""
        plain, byte_id = len(self.vocab.pieces), self.vocab.byte_id
        return [i for t in tokens for i in ([t] if t < plain else [byte_id[b] for b in self.text[t].encode()])]

    def _learn(self, new: list[str]) -> None:
        """Encode the stretches that were numbered last."""
        if self.pairs.used > self.max_pairs:
            self.pairs = Pairs()
        base = len(self.starts)
        self.starts.frombytes(bytes(8 * len(new)))
        self.counts.frombytes(bytes(8 * len(new)))
        self.held += sum(map(len, new)) + 20 * len(new)
        short = sorted((s, i) for i, s in enumerate(new, base) if s[0] in self.id and len(s) <= self.SHORT)
        if short:
            words, numbers = zip(*short, strict=True)
            tokens, counts = self._backwards(self.last_tokens(list(words)), np.array([len(w) for w in words]))
            if len(self.text) > len(self.vocab.pieces):
                lists = [self._ids(t.tolist()) for t in np.split(tokens, np.cumsum(counts)[:-1])]
                tokens, counts = np.array([i for x in lists for i in x]), np.array([len(x) for x in lists])
            self._keep(np.array(numbers), tokens, counts)
        for number, s in enumerate(new, base):
            if s[0] not in self.id:
                ids = [self.vocab.byte_id[b] for b in s.encode()]
            elif len(s) > self.SHORT:
                last, ids, place = self._last_of_long(s), [], len(s) - 1
                while place >= 0:
                    ids.append(last[place])
                    place -= int(self.size[last[place]])
                ids = self._ids(ids[::-1])
            else:
                continue
            self._keep(np.array([number]), np.array(ids), np.array([len(ids)]))

    def _keep(self, numbers: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        np.frombuffer(self.starts, np.int64)[numbers] = len(self.ids) + np.cumsum(counts) - counts
        np.frombuffer(self.counts, np.int64)[numbers] = counts
        self.ids.frombytes(ids.astype(np.int32).tobytes())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        if self.held > self.limit:
            self._reset()
        find, prefix = self.cut.findall, BLANK if self.vocab.prefix else ""
        cut = [find(prefix + t.replace(" ", BLANK)) if t else [] for t in texts]
        n = sum(map(len, cut))
        at = np.fromiter(map(self.store.__getitem__, chain.from_iterable(cut)), np.int64, n)
        if self.store.fresh:
            self._learn(self.store.fresh)
            self.store.fresh = []
        starts, sizes = np.array(self.starts, np.int64)[at], np.array(self.counts, np.int64)[at]
        total = np.cumsum(sizes)
        flat = np.arange(total[-1] if n else 0) + np.repeat(starts - total + sizes, sizes)
        edges = np.cumsum([0, *map(len, cut)])
        upto = np.concatenate([[0], total])[edges]
        return np.array(self.ids, np.int32)[flat], np.diff(upto)


class Decoder:
    def __init__(self, model: bytes):
        v = self.vocab = Vocabulary(model)
        self.bytes, self.silent = [], {i for i, k in enumerate(v.kinds) if k == CONTROL}
        for p, k in zip(v.pieces, v.kinds, strict=True):
            if k == BYTE:
                self.bytes.append(bytes([int(p[1:-1], 16)]))
            elif k == NORMAL:
                self.bytes.append(p.replace(BLANK, " ").encode())
            else:
                self.bytes.append(v.unknown.encode() if k == UNKNOWN else b"")

    def decode(self, ids: list[int]) -> str:
        whole = raw = b"".join(map(self.bytes.__getitem__, ids))
        first = next((i for i in ids if self.bytes[i]), None)
        if first is not None and self.vocab.prefix and self.vocab.kinds[first] == NORMAL and raw[:1] == b" ":
            raw = raw[1:]
        if self._whole(raw) and self.silent.isdisjoint(ids):
            return raw.decode()
        return self._broken(ids)[len(whole) - len(raw):]

    def _broken(self, ids: list[int]) -> str:
        """Runs of bytes by themselves: a byte that is in no character stands for one mark."""
        out = []
        for is_byte, group in groupby(ids, lambda i: self.vocab.kinds[i] == BYTE):
            raw = b"".join(map(self.bytes.__getitem__, group))
            while raw:
                n = next((n for n in range(1, 5 if is_byte else len(raw) + 1) if self._whole(raw[:n])), 0)
                out.append(raw[:n].decode() if n else "\ufffd")
                raw = raw[n or 1:]
        return "".join(out)

    @staticmethod
    def _whole(raw: bytes) -> bool:
        try:
            raw.decode()
        except UnicodeDecodeError:
            return False
        return True


def encode(docs: DataFrame, model: bytes, store_chars: int = 12_000_000, batch_chars: int = 1_000_000,
           decoded: bool = False) -> DataFrame:
    """``docs`` plus ``ids``: the tokens of the whole ``text``; with ``decoded`` also the text that these ids
    stand for, from the same pass. One narrow stage, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        coder, back = Encoder(shared.value, store_chars), Decoder(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            field = batch.schema.field("ids")
            column = batch.column("text")
            start, size, held = 0, 0, []
            for i in range(batch.num_rows):
                held.append(column[i].as_py() or "")
                size += len(held[-1])
                if size >= batch_chars or i + 1 == batch.num_rows:
                    flat, counts = coder.encode(held)
                    ends = np.cumsum(counts)
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())).cast(field.type)
                    out = batch.slice(start, i + 1 - start).set_column(at, field, made)
                    if decoded:
                        texts = [back.decode(part.tolist()) for part in np.split(flat, ends[:-1])]
                        name = batch.schema.field("decoded")
                        out = out.set_column(batch.schema.get_field_index("decoded"), name, pa.array(texts, name.type))
                    yield out
                    start, size, held = i + 1, 0, []

    out = docs.drop("ids", *["decoded"] * decoded).withColumn("ids", F.lit(None).cast("array<int>"))
    if decoded:
        out = out.withColumn("decoded", F.lit(None).cast("string"))
    return out.mapInArrow(run, out.schema)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``encoded`` plus ``decoded``: the text that its ``ids`` stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            ids = batch.column("ids").fill_null([])
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(ids).to_numpy())
            texts = [decoder.decode(part.tolist()) for part in np.split(flat, ends[:-1])] if len(ends) else []
            field = batch.schema.field("decoded")
            yield batch.set_column(batch.schema.get_field_index("decoded"), field, pa.array(texts, field.type))

    out = encoded.drop("decoded").withColumn("decoded", F.lit(None).cast("string"))
    return out.mapInArrow(run, out.schema)
