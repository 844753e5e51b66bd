"""Byte-level BPE through sentencepiece: a model written directly from a table of byte ranks, never trained.

Each rank's bytes become a piece, one character for each byte, with the negative rank as its score: sentencepiece merges
the pair whose joined piece scores best, which is the pair of the lowest rank. Piece numbers are ranks. The normaliser is
the identity, so nothing is escaped, added or collapsed. A text is split into pre-tokens by the vocabulary's pattern; each
distinct pre-token is encoded once per worker and kept in a table of bounded size. Decoding maps ids back to bytes. What
counts as a letter or number follows the tables of the library that the ranks are made for, as they differ by version.

The vocabulary is a fixed table (tens of thousands of entries), broadcast once. Rows are independent, so any partitioning
works and nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from sparkquill.llm.common import each

#: Pre-tokens that a worker remembers.
REMEMBERED = 150_000
#: The character of byte b is chr(FIRST + b): none of them is white space, a control or sentencepiece's own mark.
FIRST = 0x100


def read_ranks(path: str) -> dict[bytes, int]:
    """bytes -> rank from lines of base64 and a number. Ranks must count from 0 without gaps."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return ranks


def as_piece(token: bytes) -> str:
    return "".join(chr(FIRST + b) for b in token)


def as_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model of these ranks; its unknown piece has the first free number."""
    model = sentencepiece_model_pb2.ModelProto()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece=as_piece(token), score=-float(rank), type=model.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=model.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = model.trainer_spec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(ranks)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


def stand_ins() -> dict[int, str]:
    """Characters whose class here isn't that of tiktoken's tables -> one of that class."""
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    ours, theirs = {}, {}
    for kind, example in ((r"\p{L}", "x"), (r"\p{N}", "1"), (r"\s", " ")):
        ours |= dict.fromkeys(regex.findall(kind, everything), example)
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs |= dict.fromkeys(bytes(probe.encode_ordinary(everything)).decode(), example)  # what doesn't match is left out
    return {ord(c): theirs.get(c, "!") for c in {*ours, *theirs} if ours.get(c) != theirs.get(c)}


class ByteBpe:
    """Encodes and decodes whole texts; built on each worker from the serialised model."""

    def __init__(self, model: bytes, pattern: str, stand_ins: dict[int, str]) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern, self.stand_ins = regex.compile(pattern), stand_ins
        self.odd = frozenset(map(chr, stand_ins))
        self.high = re.compile(f"[{min(self.odd)}-\U0010ffff]").search if self.odd else lambda text: None
        size = self.processor.get_piece_size() - 1  # without the unknown piece
        self.tokens = [bytes(ord(c) - FIRST for c in self.processor.id_to_piece(i)) for i in range(size)]
        self.whole = {token: i for i, token in enumerate(self.tokens)}
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> array:
        if text.isascii() or not self.high(text) or self.odd.isdisjoint(text):
            pretokens = self.pattern.findall(text)
        else:
            pretokens = [text[slice(*m.span())] for m in self.pattern.finditer(text.translate(self.stand_ins))]
        new = []
        for pretoken in set(pretokens).difference(self.known):
            rank = self.whole.get(pretoken.encode())
            if rank is None:
                new.append(pretoken)
            else:
                self.known[pretoken] = array("I", (rank,)).tobytes()
        if new:
            for pretoken, ids in zip(new, self.processor.encode([as_piece(p.encode()) for p in new], num_threads=1), strict=True):
                self.known[pretoken] = array("I", ids).tobytes()
        out = array("I", b"".join(map(self.known.__getitem__, pretokens)))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def broadcast_model(spark: SparkSession, ranks_path: str) -> Broadcast:
    """What workers need of the ranks; both directions can share one."""
    return spark.sparkContext.broadcast((as_model(read_ranks(ranks_path)), stand_ins()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, model: Broadcast | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for each row of docs (doc_id, text), without special tokens. Null text counts as empty: no ids.
    Further columns are ignored; an empty table gives an empty result."""
    model = model or broadcast_model(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(model.value[0], pattern, model.value[1])
        for batch in each(batches):
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = [bpe.encode(text.as_py()) for text in part.column(1)]
                ends = [0]
                for x in ids:
                    ends.append(ends[-1] + len(x))
                flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(x.tobytes() for x in ids))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "ids"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, model: Broadcast | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256 of the ids as little-endian unsigned 32-bit integers, decoded binary) for each row of encoded (doc_id, ids).
    Null ids count as none."""
    model = model or broadcast_model(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(model.value[0], pattern, model.value[1])
        for batch in each(batches):
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists = [x.values.to_numpy().astype("<u4") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in lists], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in lists]), pa.array([bpe.decode(x.tolist()) for x in lists], pa.binary())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded"],
                )

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (doc_id, text): encoded, then decoded from the ids."""
    model = broadcast_model(docs.sparkSession, ranks_path)
    return decode(encode(docs, ranks_path, pattern, model), ranks_path, pattern, model).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
