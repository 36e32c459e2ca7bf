"""Two tokenizers aligned: which tokens of one lie over which tokens of the other, and how often in the corpus.

Tokenizer A is a byte-level BPE file of the tokenizers library and encodes a space and the text; tokenizer B is a sentencepiece model and
encodes the text, to which it adds that space. Special tokens are plain text. Runs of plain segments are encoded to ids alone: once the
bytes that the tokens decode to are found to be the text's own, they say where each token ends. For anything else the libraries give spans:
character offsets of A's tokens and byte offsets in B's proto of the encoded text. Their ends are coarse cuts; where several tokens share a
span (pieces of one character, byte-fallback tokens), the decoded bytes cut it further. Places where a token of A and one of B
both end part a text into groups; within and across groups, tokens whose bytes overlap are linked. Between two neighbouring ends of any
token lies exactly one link.

A text is cut into segments where neither tokenizer can join what it parts (`_Segments` says where and checks the vocabularies for it; if
they do not allow it, a text is one segment). A task encodes a segment once and remembers it, up to a bound on bytes. It writes
blocks of documents of about `BLOCK_BYTES` text: the tokens of the block's distinct segments, its documents as lists of segments,
and how often each pair of ids is linked. Counts are summed over the blocks per pair, the highest count per id of B is found,
and every block gets the counts of its own pairs back in a join; so neither texts nor links are shuffled, and no table of all pairs is held anywhere.

Defined cases: texts that are null, empty, or not spelled by the tokens byte for byte have no tokens: zeros and no groups.
Rows with the same id or text have results of their own; a null id stays null; an empty table gives an empty result; only `doc_id` and `text` are
read, whatever the other columns are called. A text longer than a block is a block of its own.
"""

from __future__ import annotations

import os
import re
import uuid
from functools import lru_cache
from itertools import chain
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from densekit.llm.bpe import byte_characters
from densekit.session import pin

BLOCK_BYTES = 4 << 20  # text of the documents of a block, unless one has more
CACHE_BYTES = 96 << 20  # of remembered segments, about, in a worker
SEGMENT_BYTES = 280  # of a remembered segment beside its characters: dictionary slot, string, number, tokens
SPLIT_CHARS = 1 << 20  # text cut into segments at a time, unless a text is longer
RUN_CHARS = 1 << 16  # segments encoded in one call
MAX_FILE_BYTES = 64 << 20  # of a tokenizer file, sent to every task
OUT_BYTES = 4 << 20  # of groups handed back to Spark at a time
MARK = "▁"  # what sentencepiece writes for a space
PAIR = 1 << 32  # a pair of ids is a number: that of A times this, plus that of B


class Tokens(NamedTuple):
    """Tokens of several segments in order: ids, bytes of each, and how many each segment has."""

    ids: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of all rows, one row after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class _A:
    """Tokenizer A."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.sizes = np.array([len(t) for t in self.token_bytes], np.int64)

    def ids(self, text: str) -> list[int]:
        """Ids alone, without the library's work on offsets."""
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the byte offset behind each token as far as the library's character offsets tell: -1 where the next
        token shares a character with it."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        ends = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[spans[:, 1]]
        shared = np.append(spans[1:, 0] < spans[:-1, 1], False) if len(ids) else np.zeros(0, bool)
        return ids, np.where(shared, -1, ends)


class _B:
    """Tokenizer B."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.processor.get_piece_size()
        self.pieces = [self.processor.id_to_piece(i) for i in range(size)]
        self.byte = np.array([self.processor.is_byte(i) for i in range(size)], bool)
        self.token_bytes = [bytes([int(p[1:-1], 16)]) if b else p.replace(MARK, " ").encode() for p, b in zip(self.pieces, self.byte)]
        self.sizes = np.array([len(t) for t in self.token_bytes], np.int64)

    def ids(self, text: str) -> list[int]:
        return self.processor.encode(text)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """As `_A.encode`, for the text with the space that sentencepiece adds: offsets count that space as byte 0.
        The span of a byte-fallback token is empty unless it ends its character, so only decoded bytes can cut there."""
        spans = [(p.id, p.begin, p.end) for p in self.processor.encode(text, return_type="proto").pieces]
        ids, begins, ends = np.fromiter(chain.from_iterable(spans), np.int64, 3 * len(spans)).reshape(-1, 3).T
        return ids, np.where(self.byte[ids] & (begins == ends), -1, ends + 1)


def _refined(ids: np.ndarray, coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
    """The byte offset behind every token: the coarse cut, or between two coarse cuts that of the decoded bytes. None if
    these do not fill the space between two cuts."""
    if not len(ids):
        return coarse
    run = np.cumsum(sizes[ids])
    known = np.flatnonzero(coarse >= 0)
    if not len(known) or known[-1] != len(ids) - 1:
        return None
    # tokens up to a cut are counted from the cut before
    before = np.searchsorted(known, np.arange(len(ids)))
    start = np.concatenate([[0], coarse[known]])[before]
    passed = np.concatenate([[0], run[known]])[before]
    ends = start + run - passed
    return ends if (ends[known] == coarse[known]).all() else None


class _Segments:
    """Cuts texts where neither tokenizer can join what is parted.

    A single space or line feed between two characters that are no white space begins a segment: A's splitting pattern begins a word
    there, and no piece of B may hold a space behind another character, or a line feed at all. So does an ASCII mark behind a letter or number:
    a run of either ends there for A, and no piece of B may hold the mark behind a letter or number.
    """

    def __init__(self, a: _A, b: _B):
        import json

        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(b.processor.serialized_model_proto())
        plain = spec.normalizer_spec
        pre = json.loads(a.tokenizer.to_str())["pre_tokenizer"] or {}
        pieces = [p for p, byte in zip(b.pieces, b.byte) if not byte]
        self.safe = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and a.tokenizer.normalizer is None
            and not plain.precompiled_charsmap and plain.add_dummy_prefix and not plain.remove_extra_whitespaces
            and spec.trainer_spec.model_type == 2 and not spec.trainer_spec.treat_whitespace_as_suffix
            and not any(MARK in p.lstrip(MARK) or "\n" in p or " " in p for p in pieces)
        )
        joined = {y for p in pieces for x, y in zip(p, p[1:]) if re.match(r"[^\W_]", x)}
        marks = "".join(re.escape(c) for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in joined)
        mark = rf"(?=[{marks}])" if marks else "(?!)"
        # a word up to the next cut, which most segments are; else anything up to it
        word = rf"[ \n]?[^\W_]+(?:{mark}|(?=[ \n]\S)|\Z)"
        self.cuts = re.compile(rf"{word}|[\s\S]+?(?:(?<=\S)(?=[ \n]\S)|(?<=[^\W_]){mark}|\Z)").findall
        self.simple = re.compile(rf"[ \n]?[^\s{MARK}]+").fullmatch

    def split(self, text: str) -> list[str]:
        return self.cuts(text) if self.safe else [text]


class Aligner:
    """Encodes texts by both tokenizers, segment by segment, and remembers the segments."""

    def __init__(self, file: str, model: bytes):
        self.a, self.b = _A(file), _B(model)
        self.segments = _Segments(self.a, self.b)
        self.known: dict[str, int] = {}
        self.held = 0
        self.parts: tuple[list[Tokens], list[Tokens]] = ([], [])
        self.good: list[np.ndarray] = []
        self.used = np.zeros(0, np.int64)

    def learn(self, fresh: list[str]) -> None:
        """Remember segments that are not known yet."""
        simple = self.segments.simple if self.segments.safe else lambda s: None
        runs, odd = [s for s in fresh if simple(s)], [s for s in fresh if not simple(s)]
        first = len(self.known)
        self.known.update(zip(chain(runs, odd), range(first, first + len(fresh))))
        self.held += sum(map(len, fresh)) + SEGMENT_BYTES * len(fresh)
        step = max(1, RUN_CHARS * len(runs) // max(1, sum(map(len, runs))))
        for at in range(0, len(runs), step):
            self._encode(runs[at : at + step])
        for s in odd:
            self._encode([s])

    def shrink(self) -> None:
        """Keep the segments used most, as far as they take half the bound."""
        a, b, good = self.tables()
        order = np.argsort(-self.used[: len(self.known)], kind="stable")
        words = list(self.known)
        size = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))[order] + SEGMENT_BYTES)
        kept = np.sort(order[: np.searchsorted(size, CACHE_BYTES // 2)])
        self.known = {words[i]: n for n, i in enumerate(kept.tolist())}
        self.held = int(size[len(kept) - 1]) if len(kept) else 0
        self.used = self.used[kept] // 2

        def some(t: Tokens) -> Tokens:
            at = _ragged((np.cumsum(t.counts) - t.counts)[kept], t.counts[kept])
            return Tokens(t.ids[at], t.sizes[at], t.counts[kept])

        self.parts, self.good = ([some(a)], [some(b)]), [good[kept]]

    def _encode(self, segments: list[str]) -> None:
        """One call of each library for segments parted by line feeds, which join with nothing; a single one may hold any text."""
        if not segments:
            return
        data = [s.encode("utf-8") for s in segments]
        sizes = np.array([len(d) for d in data], np.int64)
        if len(segments) > 1:
            # a line feed before each; A may join it with white space of a segment that is not simple, so that one stands alone
            text, spelled = "\n" + "\n".join(segments), b"\n" + b"\n".join(data)
            starts = np.cumsum(sizes + 1) - sizes  # of each segment, in the text
            got_a = self._counted(self.a, text, spelled, starts, sizes)
            got_b = None if got_a is None else self._counted(self.b, text, b" " + spelled, starts + 1, sizes)
            if got_b is None:
                for s in segments:
                    self._encode([s])
                return
            whole = True
        else:
            # in a segment, B's space is cut off with the line feed behind it; a whole text has its own space in front
            safe, start = self.segments.safe, np.zeros(1, np.int64)
            got_a = self._tokens(self.a, segments[0], 0, start, sizes)
            got_b = self._tokens(self.b, "\n" + segments[0] if safe else segments[0][1:], int(safe), start + 2 * safe, sizes)
            whole = got_a is not None and got_b is not None and all(
                b"".join(map(side.token_bytes.__getitem__, got.ids.tolist())) == data[0] for side, got in ((self.a, got_a), (self.b, got_b))
            )
        none = Tokens(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int32))
        self.parts[0].append(got_a if whole else none)
        self.parts[1].append(got_b if whole else none)
        self.good.append(np.full(len(segments), whole))

    @classmethod
    def _counted(cls, side, text: str, spelled: bytes, starts: np.ndarray, sizes: np.ndarray) -> Tokens | None:
        """The tokens that lie in the segments, from ids alone: None unless their bytes are those of the whole text."""
        ids = side.ids(text)
        if b"".join(map(side.token_bytes.__getitem__, ids)) != spelled:
            return None
        ids = np.array(ids, np.int64)
        return cls._inside(ids, np.cumsum(side.sizes[ids]), 0, starts, sizes)

    @classmethod
    def _tokens(cls, side, text: str, skip: int, starts: np.ndarray, sizes: np.ndarray) -> Tokens | None:
        """The tokens that lie in the segments [start, start + size), from spans; None if these do not fit the decoded bytes.
        `skip` tokens come first."""
        ids, coarse = side.encode(text)
        ends = _refined(ids, coarse, side.sizes)
        return None if ends is None else cls._inside(ids, ends, skip, starts, sizes)

    @staticmethod
    def _inside(ids: np.ndarray, ends: np.ndarray, skip: int, starts: np.ndarray, sizes: np.ndarray) -> Tokens | None:
        """The tokens that lie in the segments; None if they do not fill them, or one crosses an edge."""
        begins = np.concatenate([[0], ends[:-1]])[skip:]
        ids, ends = ids[skip:], ends[skip:]
        of = np.searchsorted(starts, begins, "right") - 1
        stops = starts + sizes
        inside = (of >= 0) & (begins < stops[of])
        ids, begins, ends, of = ids[inside], begins[inside], ends[inside], of[inside]
        if (ends > stops[of]).any() or (ends - begins).sum() != sizes.sum():
            return None
        return Tokens(*(x.astype(np.int32) for x in (ids, ends - begins, np.bincount(of, minlength=len(starts)))))

    def tables(self) -> tuple[Tokens, Tokens, np.ndarray]:
        """What is remembered, in one piece."""
        for i in (0, 1):
            if len(self.parts[i]) > 1:
                self.parts[i][:] = [Tokens(*(np.concatenate(p) for p in zip(*self.parts[i])))]
        if len(self.good) > 1:
            self.good[:] = [np.concatenate(self.good)]
        none = Tokens(*(np.zeros(0, np.int32),) * 3)
        a, b = (part[0] if part else none for part in self.parts)
        return a, b, self.good[0] if self.good else np.zeros(0, bool)

    def _numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all segments, and how many each text has."""
        lists = [self.segments.split(" " + t) if t else [] for t in texts]
        flat = list(chain.from_iterable(lists))
        fresh = set(flat).difference(self.known)
        if fresh:
            self.learn(list(fresh))
        which = np.fromiter(map(self.known.__getitem__, flat), np.int32, len(flat))
        return which, np.fromiter(map(len, lists), np.int64, len(lists))

    def block(self, texts: list[str | None]) -> "Block":
        """The tokens of some documents."""
        if self.held > CACHE_BYTES:
            self.shrink()
        parts, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t or "")
            if size >= SPLIT_CHARS:
                parts.append(self._numbered(some))
                some, size = [], 0
        parts.append(self._numbered(some))
        which, counts = (np.concatenate(p) for p in zip(*parts))
        a, b, good = self.tables()
        owner = np.repeat(np.arange(len(counts)), counts)
        bad = np.bincount(owner[~good[which]], minlength=len(counts)) > 0
        if bad.any():
            which = which[~bad[owner]]
            counts = np.where(bad, 0, counts)
        del owner
        # the most frequent first: small numbers pack well
        distinct, which, times = np.unique(which, return_inverse=True, return_counts=True)
        self.used = np.concatenate([self.used, np.zeros(len(self.known) - len(self.used), np.int64)])
        self.used[distinct] += times
        order = np.argsort(-times, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        distinct, which = distinct[order], place[which]

        def tokens(t: Tokens) -> Tokens:
            at = _ragged((np.cumsum(t.counts) - t.counts)[distinct], t.counts[distinct])
            return Tokens(t.ids[at].astype(np.int64), t.sizes[at], t.counts[distinct])

        return Block(tokens(a), tokens(b), which, counts)


class Block(NamedTuple):
    """Distinct segments as tokens of both kinds, and documents as lists of segments."""

    a: Tokens
    b: Tokens
    which: np.ndarray
    counts: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each link in order: its segment, A's and B's token as places in `a` and `b`, and whether it ends a group; then links per segment.

        Ends of tokens, counted through all segments, cut them into one link each.
        """
        end_a, end_b = np.cumsum(self.a.sizes), np.cumsum(self.b.sizes)
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        shut = (end_a[at_a] == ends) & (end_b[at_b] == ends) if len(ends) else np.zeros(0, bool)
        segment = np.repeat(np.arange(len(self.a.counts)), self.a.counts)[at_a]
        return segment, at_a, at_b, shut, np.bincount(segment, minlength=len(self.a.counts))

    def per_document(self, values: np.ndarray) -> np.ndarray:
        """Sums over each document's segments."""
        run = np.concatenate([[0], np.cumsum(values[self.which])])
        upto = np.concatenate([[0], np.cumsum(self.counts)])
        return (run[upto[1:]] - run[upto[:-1]]).astype(np.int64)


_BLOCK = "block string, rows array<struct<doc_id: {id}>>, pairs array<struct<pair: long, n: long>>, " + ", ".join(
    f"{c} binary" for c in ("a_ids", "a_sizes", "a_counts", "b_ids", "b_sizes", "b_counts", "which", "counts")
)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest needs, all low bytes first, and compressed; in front the bytes of a number and their number."""
    most = int(x.max()) if len(x) else 0
    n = max(1, -(-most.bit_length() // 8))
    x = x.astype(np.int64)
    planes = b"".join(((x >> (8 * i)) & 0xFF).astype(np.uint8).tobytes() for i in range(n))
    return bytes([n]) + len(x).to_bytes(8, "big") + pa.compress(planes, codec="zstd", asbytes=True)


def _wide(data: bytes) -> np.ndarray:
    n, size = data[0], int.from_bytes(data[1:9], "big")
    out = np.zeros(size, np.int64)
    planes = np.frombuffer(pa.decompress(data[9:], n * size, codec="zstd", asbytes=True), np.uint8).reshape(n, size)
    for i, plane in enumerate(planes):
        out |= plane.astype(np.int64) << (8 * i)
    return out


@lru_cache(maxsize=1)
def _aligner(file: str, model: bytes) -> Aligner:
    return Aligner(file, model)


def _files(path_a: str, path_b: str) -> tuple[str, bytes]:
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        file, model = f.read(MAX_FILE_BYTES + 1), g.read(MAX_FILE_BYTES + 1)
    if max(len(file), len(model)) > MAX_FILE_BYTES:
        raise ValueError(f"a tokenizer file has more than {MAX_FILE_BYTES} bytes")
    return file, model


def blocks_of(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The documents as blocks; `rows`, `counts` and `which` are in the documents' order."""
    sent = docs.sparkSession.sparkContext.broadcast(_files(path_a, path_b))
    schema = _BLOCK.format(id=docs.schema["doc_id"].dataType.simpleString())
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*sent.value)

        def made(ids: list, texts: list) -> pa.RecordBatch:
            block = aligner.block(texts)
            _, at_a, at_b, _, per_segment = block.links()
            times = np.bincount(block.which, minlength=len(per_segment))
            keys = block.a.ids[at_a] * PAIR + block.b.ids[at_b]
            pairs, of = np.unique(keys, return_inverse=True)
            weights = np.zeros(len(pairs), np.int64)
            np.add.at(weights, of, np.repeat(times, per_segment))
            row = {
                "block": [uuid.uuid4().hex], "rows": [[{"doc_id": i} for i in ids]],
                "pairs": [[{"pair": p, "n": n} for p, n in zip(pairs.tolist(), weights.tolist())]],
                "a_ids": [_narrow(block.a.ids)], "a_sizes": [_narrow(block.a.sizes)], "a_counts": [_narrow(block.a.counts)],
                "b_ids": [_narrow(block.b.ids)], "b_sizes": [_narrow(block.b.sizes)], "b_counts": [_narrow(block.b.counts)],
                "which": [_narrow(block.which)], "counts": [_narrow(block.counts)],
            }
            return pa.RecordBatch.from_pydict(row, schema=arrow)

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                length = len(text) if text else 0
                if ids and size + length > BLOCK_BYTES:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += length + 16
        if ids:
            yield made(ids, texts)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """`pair`, `count` of its links, and whether no pair of that B id has more."""
    summed = pin(blocks.select(F.explode("pairs").alias("_p")).groupBy("_p.pair").agg(F.sum("_p.n").alias("count")))
    highest = summed.groupBy((F.col("pair") % PAIR).alias("b")).agg(F.max("count").alias("_most"))
    met = summed.withColumn("b", F.col("pair") % PAIR).join(highest, "b")
    return met.select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """`doc_id`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best` (links whose count is the highest of their B id), `count_sum` (of the counts of all
    links) and `groups` (`a1,a2|b1;a3|b2,b3`: ids in order) of every document."""
    blocks = pin(blocks_of(docs, path_a, path_b))
    stats = pin(pair_counts(blocks))
    own = blocks.select("block", F.explode("pairs.pair").alias("pair"))
    told = own.join(stats, "pair")  # two plain shuffles: a pair that is in every block can be split
    lists = told.groupBy("block").agg(F.collect_list(F.struct("pair", "count", "best")).alias("told"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _aligner.cache_clear()  # a worker that encoded blocks needs its segments no longer
        for batch in batches:
            for r in range(batch.num_rows):
                yield from _documents(batch.slice(r, 1))

    return blocks.drop("pairs").join(lists, "block", "left").mapInArrow(run, out)


def _documents(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The results of the documents of one block."""
    at = {c: _wide(row.column(c)[0].as_py()) for c in row.schema.names if c not in ("block", "rows", "told")}
    block = Block(
        Tokens(at["a_ids"], at["a_sizes"], at["a_counts"]), Tokens(at["b_ids"], at["b_sizes"], at["b_counts"]), at["which"], at["counts"],
    )
    segment, at_a, at_b, shut, per_segment = block.links()
    told = row.column("told")[0].values if row.column("told")[0].is_valid else None
    total, best = np.zeros(len(per_segment), np.int64), np.zeros(len(per_segment), np.int64)
    if len(segment):
        keys, count, high = (told.field(c).to_numpy(zero_copy_only=False) for c in ("pair", "count", "best"))
        order = np.argsort(keys)
        found = order[np.searchsorted(keys[order], block.a.ids[at_a] * PAIR + block.b.ids[at_b])]
        np.add.at(total, segment, count[found])
        np.add.at(best, segment, high[found].astype(np.int64))
    groups = np.bincount(segment[shut], minlength=len(per_segment))
    columns = [block.per_document(v) for v in (block.a.counts, block.b.counts, groups, per_segment, best, total)]
    spelled = _spelled(block, segment, at_a, at_b, shut)
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1
    upto = np.concatenate([[0], np.cumsum(block.counts)])
    length = np.cumsum(block.per_document(sizes))
    ids = row.column("rows")[0].values.field("doc_id")
    start = 0
    while start < len(ids):
        done = length[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(length, done + OUT_BYTES)))
        texts = [";".join(map(spelled.__getitem__, block.which[upto[i] : upto[i + 1]].tolist())) for i in range(start, min(end, len(ids)))]
        part = [c[start:end] for c in columns]
        yield pa.RecordBatch.from_arrays(
            [ids.slice(start, end - start), *map(pa.array, part), pa.array(texts, pa.string())],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
        )
        start = end


def _spelled(block: Block, segment: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, shut: np.ndarray) -> list[str]:
    """The groups of each segment as text: per group the ids of A, a bar, the ids of B."""
    if not len(segment):
        return [""] * len(block.a.counts)
    group = np.concatenate([[0], np.cumsum(shut)[:-1]])  # number of the group of each link
    n_groups = int(group[-1]) + 1

    def listed(tokens: Tokens, at: np.ndarray, last: str) -> tuple[np.ndarray, np.ndarray]:
        """Each token's id with what follows it, and its group."""
        first = np.concatenate([[True], at[1:] != at[:-1]])
        of = group[first]  # tokens come in order and each stands in one group
        ends = np.append(of[1:] != of[:-1], True)
        distinct, which = np.unique(tokens.ids, return_inverse=True)
        names = list(map(str, distinct.tolist()))
        words = np.array([n + "," for n in names] + [n + last for n in names], object)
        return words[which + len(names) * ends], of

    words_a, of_a = listed(block.a, at_a, "|")
    words_b, of_b = listed(block.b, at_b, ";")
    words = np.concatenate([words_a, words_b])[np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")].tolist()
    # words up to the end of each group, and groups up to the end of each segment
    upto = np.cumsum(np.bincount(of_a, minlength=n_groups) + np.bincount(of_b, minlength=n_groups))
    last = np.cumsum(np.bincount(segment[shut], minlength=len(block.a.counts)))
    ends = np.concatenate([[0], upto])[last].tolist()
    return ["".join(words[s:e])[:-1] for s, e in zip([0, *ends], ends)]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
