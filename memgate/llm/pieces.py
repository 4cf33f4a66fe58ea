"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reports, at each position, every piece that ends there (its output links); each relaxes the best score of
the position. Characters that no piece covers become byte pieces, as does a literal U+2581, so decode(encode(x)) == x
for every text. As no piece has the space mark behind another character, the best path always breaks before a run of
spaces, and the segments between breaks are solved once and cached, up to a fixed number.

Among equal scores the longer last piece wins. Null texts give null ids and decode to null; an empty text has no ids.
Scores are the model's own; for a BPE vocabulary (score = minus the merge's rank) the path with the best sum may differ
from the one that merging gives.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memgate.llm._shared import small_batches, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SEGMENT = re.compile(" *[^ ]+| +$")
BYTE_SCORE = -1e12
#: Segments of up to LONG characters are cached, CACHE of them per worker.
CACHE, LONG = 150_000, 48


def vocabulary(model: str = MODEL) -> dict:
    """Pieces with scores, byte ids, and the bytes of each id, read from a SentencePiece model file on the driver."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(m.get_piece_size())
    byte = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
    words = {m.id_to_piece(i): (i, float(m.get_score(i))) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
    if any(MARK in p.lstrip(MARK) for p in words):
        raise ValueError("a piece has a space mark behind another character")
    if MARK not in words:
        raise ValueError("the space mark is no piece of its own")
    plain = [b""] * len(ids)
    for p, (i, _) in words.items():
        plain[i] = p.replace(MARK, " ").encode()
    for b, i in byte.items():
        plain[i] = bytes([b])
    return {"words": words, "byte": [byte[b] for b in range(256)], "plain": plain}


class Segments(dict):
    """From a segment (spaces, then other characters) to its packed ids, solved when first asked for."""

    def __init__(self, vocab: dict):
        import ahocorasick

        self.byte = vocab["byte"]
        self.automaton = ahocorasick.Automaton()
        for p, (i, score) in vocab["words"].items():
            self.automaton.add_word(p, (len(p), score, i))
        self.automaton.make_automaton()

    def solve(self, text: str) -> list[int]:
        """Ids of the best path through text, in which spaces are marks."""
        n = len(text)
        best, last = [0.0] * (n + 1), [(1, -1)] * (n + 1)
        done = 0
        for end, (size, score, i) in self.automaton.iter(text):
            while done <= end:
                done += 1
                best[done] = best[done - 1] + BYTE_SCORE
            if (s := best[done - size] + score) > best[done]:
                best[done], last[done] = s, (size, i)
        out: list[int] = []
        at = n
        while at:
            size, i = last[at]
            if i < 0:
                out += [self.byte[b] for b in reversed(text[at - 1].encode())]
            else:
                out.append(i)
            at -= size
        return out[::-1]

    def __missing__(self, segment: str) -> bytes:
        ids: list[int] = []
        for k, part in enumerate(segment.split(MARK)):  # a literal mark
            if k:
                ids += [self.byte[b] for b in MARK.encode()]
            ids += self.solve(part.replace(" ", MARK))
        packed = np.array(ids, np.int32).tobytes()
        if len(segment) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[segment] = packed
        return packed

    def encode(self, raw: bytes) -> np.ndarray:
        if not raw:
            return np.empty(0, np.int32)
        return np.frombuffer(b"".join(map(self.__getitem__, SEGMENT.findall(" " + raw.decode()))), np.int32)


def decoded(ids, plain: list[bytes]) -> bytes:
    return b"".join(map(plain.__getitem__, ids))[1:]


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL, out_col: str = "token_ids") -> DataFrame:
    """docs without the text, with its ids as array<int>."""
    spark = small_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vocabulary(model))
    rest = [c for c in docs.columns if c not in (text_col, out_col)]
    frame = docs.select(*rest, F.col(text_col))

    def run(batches):
        segments = Segments(shared.value)
        for batch in batches:
            ids = [None if t is None else segments.encode(t) for t in batch.column(len(rest)).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], [*rest, out_col])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:-1], T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, ids_col: str = "token_ids", model: str = MODEL, out_col: str = "text") -> DataFrame:
    """tokens without the ids, with their text."""
    spark = small_batches(tokens.sparkSession)
    shared = spark.sparkContext.broadcast(vocabulary(model)["plain"])
    rest = [c for c in tokens.columns if c not in (ids_col, out_col)]
    frame = tokens.select(*rest, F.col(ids_col))

    def run(batches):
        for batch in batches:
            texts = [None if i is None else decoded(i, shared.value) for i in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary()).cast(pa.string())], [*rest, out_col])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:-1], T.StructField(out_col, T.StringType())]))


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and same_text: both directions in one pass, so ids never leave the worker."""
    spark = small_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vocabulary(model))

    def run(batches):
        segments, plain = Segments(shared.value), shared.value["plain"]
        for doc_ids, texts in text_slices(batches):
            ids = [segments.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids]), pa.array([decoded(i.tolist(), plain) == t for i, t in zip(ids, texts)])],
                ["doc_id", "n_tokens", "ids_sha256", "same_text"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, same_text boolean")
