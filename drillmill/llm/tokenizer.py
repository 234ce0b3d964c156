"""Encoding of texts with a public byte-level BPE vocabulary (problem 7).

The merges are compiled into a finite-state transducer that reads bytes and writes token ids. A BPE encoding is the only
sequence of tokens whose neighbours are all compatible (merging their joined bytes gives the same two tokens back), so the
last token of each prefix follows from the last tokens of shorter prefixes. A state of the transducer is the last written
token and the bytes that are still open; a byte leads to the next state and writes the tokens that no continuation can
change. As an open stretch has to be the start of some vocabulary entry, the lookahead is bounded by the longest entry.
States and transitions are made when first needed (lazy determinisation) and kept per Python worker.

The pattern that splits a text into words resets the transducer; it is that of the public vocabulary. Special tokens don't
exist: their strings are ordinary text. Decoding streams ids through an incremental UTF-8 state machine.

Defined results: NULL and empty texts give an empty list; texts of any length are encoded whole; repeated rows are encoded
each; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import base64
import threading
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of the vocabulary files, and the word pattern that belongs to them (fixed value).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words and states kept per worker; beyond it they are dropped and made again, results don't change.
MAX_WORDS, MAX_STATES = 400_000, 400_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def merge_bytes(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """Plain BPE by rank; used for the short strings that define compatibility, and as the brute-force reference."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class _State:
    __slots__ = ("end", "last", "next", "open", "tails")

    def __init__(self, last: int, open_: bytes, tails: tuple[int, ...]):
        self.last, self.open, self.tails = last, open_, tails  # tails[i]: last token of open[:i + 1]
        self.next: dict[int, tuple[_State, tuple[int, ...]]] = {}
        self.end: tuple[int, ...] | None = None


class MergeTransducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = {i: len(b) for b, i in ranks.items()}
        self.bytes = {i: b for b, i in ranks.items()}
        self.starts = {b[:n] for b in ranks for n in range(1, len(b))}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.root = _State(-1, b"", ())
        self.states = {(-1, b""): self.root}

    def _own(self, token: int) -> bool:
        """Whether the token's bytes merge into that token."""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = merge_bytes(self.ranks, self.bytes[token]) == [token]
        return known

    def _fits(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        if (known := self._pairs.get((a, b))) is None:
            if len(self._pairs) > 4 * MAX_STATES:
                self._pairs.clear()
            known = self._pairs[a, b] = merge_bytes(self.ranks, self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def _chain(self, tails: tuple[int, ...], at: int) -> list[int]:
        """Boundaries of the encoding of the open stretch's first `at` bytes, last first."""
        out = [at]
        while at > 0:
            at -= self.size[tails[at - 1]]
            out.append(at)
        return out

    def _grow(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        text = state.open + bytes((byte,))
        n = len(text)
        token = -1
        for j in range(max(0, n - self.longest), n):
            t = self.ranks.get(text[j:])
            if t is not None and self._own(t) and self._fits(state.tails[j - 1] if j else state.last, t):
                token = t
                break
        tails = (*state.tails, token)
        # a later token can only begin where the rest is the start of a vocabulary entry, or here
        live = [j for j in range(n) if text[j:] in self.starts] + [n]
        chains = [set(self._chain(tails, j)) for j in live]
        sure = max(set.intersection(*chains))
        written = self._tokens(tails, sure)
        key = (written[-1] if written else state.last, text[sure:])
        new = self.states.get(key)
        if new is None:
            new = self.states[key] = _State(key[0], key[1], tails[sure:])
        return new, written

    def _tokens(self, tails: tuple[int, ...], at: int) -> tuple[int, ...]:
        out = []
        while at > 0:
            out.append(tails[at - 1])
            at -= self.size[tails[at - 1]]
        return tuple(reversed(out))

    def encode_word(self, data: bytes) -> tuple[int, ...]:
        if len(self.states) > MAX_STATES:
            self._reset()
        state, out = self.root, []
        for byte in data:
            step = state.next.get(byte)
            if step is None:
                step = state.next[byte] = self._grow(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        if state.end is None:
            state.end = self._tokens(state.tails, len(state.tails))
        out += state.end
        return tuple(out)


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.machine = MergeTransducer(ranks)
        self.split = regex.compile(PATTERN).findall
        self.words: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words, out = self.words, []
        for w in self.split(text):
            ids = words.get(w)
            if ids is None:
                ids = self.machine.encode_word(w.encode("utf-8"))
                if len(w) <= 64:  # longer ones hardly come twice
                    if len(words) >= MAX_WORDS:
                        words.clear()
                    words[w] = ids
            out += ids
        return out


class Utf8Machine:
    """Incremental UTF-8 decoder: bytes of an unfinished character wait; what can't become one gives U+FFFD."""

    def __init__(self) -> None:
        self.wait = b""

    @staticmethod
    def _open_tail(data: bytes) -> int:
        """Bytes at the end that begin a character and don't complete it."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                need = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
                return back if need > back else 0
            if lead < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.wait + data
        keep = self._open_tail(data)
        self.wait = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.wait = self.wait, b""
        return rest.decode("utf-8", "replace")


def decode_stream(names: dict[int, bytes], ids: Iterable[int]) -> Iterator[str]:
    machine = Utf8Machine()
    for i in ids:
        if piece := machine.feed(names[i]):
            yield piece
    if piece := machine.close():
        yield piece


_encoders: dict[int, Encoder] = {}
_lock = threading.Lock()


def _encoder(raw: bytes) -> Encoder:
    key = hash(raw)
    with _lock:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(read_ranks(raw))
        return _encoders[key]


def _shared(spark: SparkSession, path: str):
    """The vocabulary file (under 2 MB, fixed) is read by the driver and broadcast; executors need no copy of it."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def encode_column(spark: SparkSession, text: str | Column, path: str = VOCABULARY) -> Column:
    """ARRAY<INT>: token ids, empty for NULL."""
    raw = _shared(spark, path)

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        e = _encoder(raw.value)
        return pd.Series([e.encode(t) for t in texts], dtype=object)

    return encode(text)


def count_column(spark: SparkSession, text: str | Column, path: str = VOCABULARY) -> Column:
    """INT: number of tokens, 0 for NULL."""
    raw = _shared(spark, path)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        e = _encoder(raw.value)
        return pd.Series([len(e.encode(t)) for t in texts], dtype="int32")

    return count(text)


def decode_column(spark: SparkSession, ids: str | Column, path: str = VOCABULARY) -> Column:
    raw = _shared(spark, path)

    @F.pandas_udf("string")
    def decode(lists: pd.Series) -> pd.Series:
        names = _encoder(raw.value).machine.bytes
        return pd.Series(["".join(decode_stream(names, x if x is not None else ())) for x in lists], dtype=object)

    return decode(ids)


def encode_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    return documents.select("doc_id", encode_column(documents.sparkSession, "text", path).alias("ids"))


def round_trip(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, restored: whether decoding the ids gives the text back."""
    spark = documents.sparkSession
    ids = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), encode_column(spark, "text", path).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), (decode_column(spark, "ids", path) == F.col("text")).alias("restored"))
