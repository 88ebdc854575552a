"""BPE encoding and decoding by a compiled automaton.

Compilation. The universal automaton over the byte tokens has one state with a loop for each byte. Each merge
(a, b) -> c, in order of rank, puts in one *merge gadget*: the state q that a leads to is split, so that a now
leads to a copy of q without the transition on b, and c is added from every state that has a, leading where b
led. Every token leads to one state only, so the state that a token leads to at some time is named by (token, time),
and a gadget is stored as (a, b) -> time; `allows` reads a transition from these by going back over the parts of the
two tokens. The automaton accepts exactly the token sequences that BPE produces (one for each byte string).

Encoding. A subset construction over the vocabulary trie turns it into a deterministic table over bytes. A table
state holds the token that ends at this byte, the unfinished tokens, and counts relative to this byte; each
transition carries the change in the number of tokens (used by token_count). States are made when first reached
and kept in a bounded table. The tokens of a word are read off by stepping back from its last state.

Decoding emits the arc label (bytes) of each token.

Defined results: null text is the empty text (no ids, empty decoded text); added special strings inside a text
become their id, as the library does by default; the same text always gives the same ids, so ties and repeated
rows agree; an empty table gives an empty table; extra columns are ignored, or kept by `encode` unless named like
an output column, which then wins.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm._common import arrow_map

# Letters that every Unicode version classes as \p{L}, then plain punctuation: split without the library.
_SIMPLE = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&*-/:-@]*)").fullmatch
# A space inside white space, which cutting at every space would separate from its neighbours.
_INNER = re.compile(r"\s [\s]|\s \Z")
MAX_STATES = 120_000
MAX_WORDS = 400_000


def byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Automaton:
    """A byte-level BPE vocabulary compiled into a deterministic automaton."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE tokenizer is needed")
        if spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("normalizers, ignore_merges and dropout are not supported")
        self.prefix_space = bool(spec["pre_tokenizer"].get("add_prefix_space"))
        to_char, vocab = byte_chars(), model["vocab"]
        self.from_char = {c: b for b, c in to_char.items()}
        self.labels: list[bytes] = [b""] * (1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]))
        for piece, i in vocab.items():
            self.labels[i] = bytes(self.from_char[c] for c in piece)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for piece, i in self.special.items():
            self.labels[i] = piece.encode()
        self._compile(vocab, model["merges"], to_char)
        by_length = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        self._split = None
        self.ids = [str(i) for i in range(len(self.labels))]
        self.words: dict[str, tuple[int, ...]] = {}
        self.counts: dict[str, int] = {}

    # -- compilation -------------------------------------------------------------------------------------------
    def _compile(self, vocab: dict, merges: list, to_char: dict) -> None:
        n = len(self.labels)
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        self.gadgets: dict[tuple[int, int], int] = {}
        for b in range(256):
            self.born[vocab[to_char[b]]] = 0
        for time, merge in enumerate(merges, 1):
            x, y = merge.split(" ") if isinstance(merge, str) else merge
            self._gadget(vocab[x], vocab[y], vocab[x + y], time)
        self.trie: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for i, piece in enumerate(self.labels):
            if self.born[i] < 0 or not piece:
                continue
            node = 0
            for b in piece:
                nxt = self.trie[node].get(b)
                if nxt is None:
                    nxt = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.below: list[list[int] | None] = [[] for _ in self.trie]
        for node in range(len(self.trie) - 1, -1, -1):  # children come after their parents
            found: list[int] | None = []
            for child in self.trie[node].values():
                under = self.below[child]
                own = [self.token_at[child]] if self.token_at[child] >= 0 else []
                found = None if under is None or found is None or len(found) + len(under) > 24 else [*found, *own, *under]
            self.below[node] = found
        self._reset()

    def _gadget(self, a: int, b: int, c: int, time: int) -> None:
        """Split the state that a leads to, unless a cannot be followed by b any more."""
        if self.born[a] < 0 or self.born[b] < 0 or self.born[c] >= 0 or not self.allows(a, b, time):
            return
        self.gadgets[a, b] = time
        self.left[c], self.right[c], self.born[c] = a, b, time

    def allows(self, x: int, t: int, before: int = 1 << 60) -> bool:
        """Has the state that token x leads to (after its gadgets earlier than `before`) a transition on t?"""
        if x < 0:
            return True  # the start state has kept all its transitions
        gadgets, born, left, right = self.gadgets, self.born, self.left, self.right
        while True:
            if born[t] < (time := gadgets.get((x, t), 0)) < before:
                return False
            if before <= born[t] + 1 or born[x] <= born[t]:  # the state is older than t: t came with its left part
                before = min(before, born[t] + 1)
                t = left[t]
                if t < 0:
                    return True
            else:  # t is older than the state: it was copied from the state of the right part
                before = born[x]
                x = right[x]

    # -- the table over bytes ----------------------------------------------------------------------------------
    def _reset(self) -> None:
        self.keys = [(-1, ((0, -1, 0),))]
        self.index: dict = {}
        self.step: list[dict[int, int]] = [{}]
        self.last, self.size, self.delta = [-1], [0], [0]
        self.open: dict = {}
        self.futures: dict = {}

    def _alive(self, node: int, x: int):
        """What may still end under the node: None if nothing, else a key equal for equal futures.

        x: the token before, or what may end under the node's parent.
        """
        found = self.open.get((node, x), 0)
        if found == 0:
            under = self.below[node]
            if x.__class__ is frozenset:
                found = frozenset(t for t in under if t in x) or None
            else:
                found = x if under is None else frozenset(t for t in under if self.allows(x, t)) or None
            found = self.open[node, x] = self.futures.setdefault(found, found)  # equal ones are one object
        return found

    def trim(self) -> None:
        """Start the table anew once it is full; only between words, as states' numbers change."""
        if len(self.keys) > MAX_STATES:
            self._reset()

    def _number(self, key: tuple, count: int) -> int:
        found = self.index.get((key, count))
        if found is None:
            found = self.index[key, count] = len(self.keys)
            self.keys.append(key)
            self.step.append({})
            self.last.append(key[0])
            self.size.append(len(self.labels[key[0]]))
            self.delta.append(count)
        return found

    def state_of(self, key: tuple) -> int:
        """A table state with this key; keys, unlike numbers, are the same in all workers."""
        return 0 if key == self.keys[0] else self._number(key, 0)

    def make(self, state: int, byte: int) -> int:
        """The table state after `byte`; by uniqueness just one token can end here."""
        token, count, alive = -1, 0, []
        for node, x, behind in self.keys[state][1]:
            nxt = self.trie[node].get(byte)
            if nxt is None:
                continue
            t = self.token_at[nxt]
            if t >= 0 and token < 0 and (t in x if x.__class__ is frozenset else self.allows(x, t)):
                token, count = t, behind + 1
            if self.trie[nxt]:
                future = self._alive(nxt, x)
                if future is not None:
                    alive.append((nxt, future, behind))
        if token < 0:
            raise AssertionError("no token ends here: the merges do not cover the bytes")
        key = (token, (*((node, x, behind - count) for node, x, behind in alive), (0, token, 0)))
        found = self.step[state][byte] = self._number(key, count)
        return found

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-split word: forward over the table, then back over the tokens that end."""
        self.trim()
        step, state, path = self.step, 0, []
        for b in word:
            try:
                state = step[state][b]
            except KeyError:
                state = self.make(state, b)
            path.append(state)
        out, at, last, size = [], len(path) - 1, self.last, self.size
        while at >= 0:
            s = path[at]
            out.append(last[s])
            at -= size[s]
        return tuple(out[::-1])

    def count_word(self, word: bytes) -> int:
        """Tokens of one pre-split word: the sum of what its transitions emit."""
        self.trim()
        step, delta, state, n = self.step, self.delta, 0, 0
        for b in word:
            try:
                state = step[state][b]
            except KeyError:
                state = self.make(state, b)
            n += delta[state]
        return n

    # -- texts -------------------------------------------------------------------------------------------------
    def split(self, piece: str) -> list[bytes]:
        """Pre-split a piece into words, as bytes, by the library's own rule."""
        if self._split is None:
            from tokenizers import pre_tokenizers

            self._split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        return [bytes(map(self.from_char.__getitem__, w)) for w, _ in self._split(piece)]

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        m = _SIMPLE(piece)
        if m is None:
            return tuple(chain.from_iterable(map(self.encode_word, self.split(piece))))
        word, mark = m.groups()
        if not mark:
            return self.encode_word(word.encode())
        return (self.words.get(word) or self.encode_word(word.encode())) + (self.words.get(mark) or self.encode_word(mark.encode()))

    def piece_count(self, piece: str) -> int:
        m = _SIMPLE(piece)
        if m is None:
            return sum(map(self.count_word, self.split(piece)))
        word, mark = m.groups()
        if not mark:
            return self.count_word(word.encode())
        return (self.counts.get(word) or self.count_word(word.encode())) + (self.counts.get(mark) or self.count_word(mark.encode()))

    def pieces(self, segment: str) -> list[str]:
        """Cut at the spaces; words never reach over such a cut unless the space is inside white space."""
        if _INNER.search(segment):
            return [segment]
        first, *rest = segment.split(" ")
        return [first, *(" " + x for x in rest)]

    def segments(self, text: str):
        """(text, id): ordinary text with id None, special strings with their id."""
        if self.prefix_space and text and not text[0].isspace():
            text = " " + text
        if self.cut is None or not any(s in text for s in self.special):
            return [(text, None)]
        return [(x, self.special.get(x)) for x in self.cut.split(text) if x]

    @staticmethod
    def _known(parts: list[str], cache: dict, value) -> list:
        """value(part) for each part; words that come again are looked up."""
        out = list(map(cache.get, parts))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    part = parts[i]
                    x = cache.get(part)
                    if x is None:
                        x = value(part)
                        if len(part) <= 64:
                            cache[part] = x
                    out[i] = x
            if len(cache) > MAX_WORDS:
                cache.clear()
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for segment, special in self.segments(text or ""):
            if special is not None:
                out.append(special)
            elif segment:
                out.extend(chain.from_iterable(self._known(self.pieces(segment), self.words, self.piece_ids)))
        return out

    def count_segment(self, segment: str) -> int:
        """Tokens of a text without special strings."""
        return sum(self._known(self.pieces(segment), self.counts, self.piece_count))

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Automaton] = {}


def load(path: str) -> Automaton:
    """The automaton of a tokenizer file, compiled once for each Python worker."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            _LOADED[path] = Automaton(json.load(f))
    return _LOADED[path]


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with a column of token ids (array<int>). No shuffle; rows stay where they are."""
    keep = df.drop(ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + f", `{ids_col}` array<int>"

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        a = load(path)
        ids = pa.array([a.encode(t) for t in batch.column(text_col).to_pylist()], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, ids_col])

    return arrow_map(keep, kernel, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the text of a column of token ids; null ids decode to the empty text."""
    keep = df.drop(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + f", `{text_col}` string"

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        a = load(path)
        text = pa.array([a.decode(x or []) for x in batch.column(ids_col).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, text_col])

    return arrow_map(keep, kernel, schema)


def round_trip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with a column of token ids, and the text that they decode to in place of the text: one pass, one worker a task."""
    keep = df.drop(ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + f", `{ids_col}` array<int>"

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        a = load(path)
        ids = [a.encode(t) for t in batch.column(text_col).to_pylist()]
        text = pa.array([a.decode(x) for x in ids], pa.string())
        columns = [text if name == text_col else column for name, column in zip(batch.schema.names, batch.columns, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, ids_col])

    return arrow_map(keep, kernel, schema)


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text: encode, then decode, in one pass over the batch."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, sha = load(path), hashlib.sha256
        n, ids_sha, text_sha = [], [], []
        for text in batch.column("text").to_pylist():
            ids = a.encode(text)
            n.append(len(ids))
            ids_sha.append(sha(",".join(map(a.ids.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(sha(a.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
