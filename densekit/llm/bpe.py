"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

A task takes the texts of an Arrow batch in pieces of bounded size. Words come from the vocabulary's
splitting pattern; words not met before are encoded together: their symbols lie in one flat array, and in
each round the rank of every pair of neighbours is found by binary search among the sorted pair keys,
every word merges its lowest-ranked pair wherever it occurs (from the left, without overlap), and the
array closes up. A round costs a few numpy calls however many words there are. Finished words leave the
array. Encoded words are remembered per task, up to a bound, and texts are put together by numpy.

The vocabulary is read on the driver from the path given and sent to the tasks: its size is fixed and
checked. One merge gives one token (checked), so the order of merges within a round cannot matter.

Defined cases: a null or empty text has no ids; null ids decode to the empty text; ids outside the
vocabulary raise an error; special tokens in a text are taken as such, as the tokenizers library does by
default; an empty table gives an empty result; an input column named like the output is replaced.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how the byte-level vocabularies split a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY = 1_000_000
PIECE_CHARS = 1 << 18  # characters of the texts encoded at a time, or ids decoded, unless a text has more
REMEMBERED_BYTES = 48 << 20  # of words a task remembers, about
WORD_BYTES = 180  # of a remembered word beside its characters: dictionary slot, string, number, ids
REMEMBERED_CHARS = 64  # longer words are not remembered


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 characters for
    themselves, the others for the characters from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def _latin_pattern() -> str:
    """PATTERN for texts of Latin-1 characters, its classes written out for the standard library's `re`,
    which is several times faster. Letters stand first, as no other choice can begin with one."""
    latin = "".join(map(chr, range(256)))
    letter, number, space = ("".join(map(re.escape, regex.findall(c, latin))) for c in (r"\p{L}", r"\p{N}", r"\s"))
    return (
        f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


class Vocabulary:
    """Arrays made from a tokenizer file: what tasks need, and nothing else."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        pre = spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only byte-level BPE files without normaliser and added prefix space are supported")
        if len(vocab) > MAX_VOCABULARY:
            raise ValueError(f"more than {MAX_VOCABULARY} tokens")
        chars = byte_characters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.byte_ids = np.array([vocab[c] for c in chars], np.int64)
        to_byte = {c: b for b, c in enumerate(chars)}
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in (vocab | self.specials).items():
            self.token_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges give the same token")
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split_any, self.split_latin = regex.compile(PATTERN).findall, re.compile(_latin_pattern()).findall
        special = sorted(vocabulary.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self._forget()

    def _forget(self) -> None:
        self.known = {word: i for i, word in enumerate(self.v.specials)}
        self.ids = np.array(list(self.v.specials.values()), np.int32)
        self.sizes = np.ones(len(self.known), np.int64)
        self.held = 0

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)

    def _words(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.v.specials):
            return self.split(text)
        words: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            words += [part] if k % 2 else self.split(part)
        return words

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        lists = [self._words(t) for t in texts]
        if self.held > REMEMBERED_BYTES:
            self._forget()
        words = list(chain.from_iterable(lists))
        first = len(self.known)
        fresh = list(set(words).difference(self.known))
        if fresh:
            # the longest last, so that those too long to remember can be cut off again
            fresh.sort(key=len)
            self.known.update(zip(fresh, range(first, first + len(fresh))))
            self.held += sum(len(w) + WORD_BYTES for w in fresh if len(w) <= REMEMBERED_CHARS)
            ids, sizes = self.merge([w.encode("utf-8", "surrogatepass") for w in fresh])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        starts = np.cumsum(self.sizes) - self.sizes
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        taken = self.sizes[which]
        ends = np.cumsum(taken)
        values = self.ids[np.repeat(starts[which] - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.cumsum([0, *map(len, lists)])]
        if fresh and len(fresh[-1]) > REMEMBERED_CHARS:
            long = [w for w in fresh if len(w) > REMEMBERED_CHARS]
            for w in long:
                del self.known[w]
            self.sizes = self.sizes[: len(self.known)]
            self.ids = self.ids[: self.sizes.sum()]
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(values, pa.int32()))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        v = self.v
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        none = len(v.keys)
        # place and rank of the pair that each symbol makes with its right neighbour
        place, rank = np.zeros(len(symbols), np.int64), np.full(len(symbols), none, np.int64)
        look = np.arange(len(symbols))
        done_symbols, done_owners = [], []
        while len(symbols):
            last = look == len(symbols) - 1
            right = np.where(last, 0, look + 1)
            key = symbols[look] * v.size + symbols[right]
            at = np.searchsorted(v.keys, key)
            at[at == none] = 0
            pair = (v.keys[at] == key) & (owner[look] == owner[right]) & ~last
            place[look], rank[look] = at, np.where(pair, v.ranks[at], none)
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            best = np.repeat(best, np.diff(np.concatenate([heads, [len(symbols)]])))
            stay = best < none
            if not stay.all():
                done_symbols.append(symbols[~stay])
                done_owners.append(owner[~stay])
            hit = np.flatnonzero(stay & (rank == best))
            changed = np.zeros(len(symbols), bool)
            if len(hit):
                # in a run of overlapping hits every other one counts, from the left
                new_run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
                symbols[hit] = v.made[place[hit]]
                changed[hit] = changed[np.maximum(hit - 1, 0)] = True
                stay[hit + 1] = False
            symbols, owner, place, rank = symbols[stay], owner[stay], place[stay], rank[stay]
            look = np.flatnonzero(changed[stay])
        ids = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        owners = np.concatenate(done_owners) if done_owners else np.zeros(0, np.int64)
        order = np.argsort(owners, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owners, minlength=len(words)).astype(np.int64)


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    piece, size = [], 0
    for t in texts:
        piece.append(t)
        size += len(t)
        if size >= PIECE_CHARS:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


class Decoder:
    def __init__(self, token_bytes: list[bytes]):
        self.sizes = np.array([len(t) for t in token_bytes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(token_bytes), np.uint8)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list."""
        counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        values = ids.flatten().to_numpy(zero_copy_only=False)
        if len(values) and not 0 <= values.min() <= values.max() < len(self.sizes):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.sizes[values]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[values] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        data = self.bytes[at].tobytes()
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
        inner = upto[(upto > 0) & (upto < len(data))]
        try:
            data.decode("utf-8")
            whole = not any(0x80 <= data[i] < 0xC0 for i in inner)
        except UnicodeDecodeError:
            whole = False
        if whole:
            return pa.StringArray.from_buffers(len(counts), pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(data))
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(upto, upto[1:])], pa.string())


def _id_pieces(ids: pa.ListArray) -> Iterator[pa.ListArray]:
    """Slices of about PIECE_CHARS ids."""
    upto = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ids):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE_CHARS)))
        yield ids.slice(at, end - at)
        at = end


#: Encoders of this worker process by vocabulary, so that the next task finds the words of the last
_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    found = _ENCODERS.get(id(vocabulary))
    if found is None or found.v is not vocabulary:
        _ENCODERS.clear()
        found = _ENCODERS[id(vocabulary)] = Encoder(vocabulary)
    return found


@lru_cache(maxsize=4)
def _load(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the token ids of the whole text (array of int)."""
    sent = docs.sparkSession.sparkContext.broadcast(_load(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(sent.value)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.to_pylist()]
            parts = [encoder.encode(piece) for piece in _pieces(texts)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(ids, F.arrow_udf(run, "array<int>")(F.col(text)))


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """`rows` with the text that the ids spell; bytes that are no UTF-8 become U+FFFD."""
    sent = rows.sparkSession.sparkContext.broadcast(_load(path).token_bytes)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(sent.value)
        for batch in batches:
            parts = [decoder.decode(piece) for piece in _id_pieces(batch)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return rows.withColumn(text, F.arrow_udf(run, "string")(F.col(ids)))


def encode_checked(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", same: str = "round_trip") -> DataFrame:
    """`docs` with the token ids of the whole text, and whether they decode to it; both in one pass over the text."""
    sent = docs.sparkSession.sparkContext.broadcast(_load(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = _encoder(sent.value), Decoder(sent.value.token_bytes)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.to_pylist()]
            found, alike = [], []
            for piece in _pieces(texts):
                found.append(encoder.encode(piece))
                alike += [a == b for a, b in zip(piece, decoder.decode(found[-1]).to_pylist())]
            lists = pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int32()))
            yield pa.StructArray.from_arrays([lists, pa.array(alike, pa.bool_())], names=["ids", "same"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = docs.withColumn("_encoded", F.arrow_udf(run, "ids array<int>, same boolean")(F.col(text)))
    return made.withColumns({ids: F.col("_encoded.ids"), same: F.col("_encoded.same")}).drop("_encoded")
