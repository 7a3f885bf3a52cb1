"""Operator 3: byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factorspark.llm.common import map_batches, table

#: Texts over this many characters are split at safe places before the library's own splitting.
LONG = 200_000
#: White space runs over this many characters are given to the merges as one match, past the regex engine.
RUN = 20_000
#: A match of the pattern never goes on from a letter or digit of ASCII into a space or line feed, and what comes
#: before such a place is matched without a look at what follows: the only look-ahead stands after white space.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")
_RUNS = re.compile(r"[ \t\n\r\x0b\x0c]{%d,}" % RUN)


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The encoding of a rank file (lines of base64 and rank), built once in each Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, longest: int = LONG) -> Iterator[str]:
    """Cuts text into pieces whose matches together are the matches of the whole; a piece without a safe place stays whole."""
    at = 0
    while len(text) - at > longest:
        cut = next((m.start() for m in _SAFE.finditer(text, at + longest // 2)), None)
        if cut is None:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(text: str, enc) -> np.ndarray:
    """Ids of a text as uint32, equal to enc.encode_ordinary(text), for texts of any length.

    A very long run of ASCII white space would exhaust the regex engine's backtracking: of such a run that text
    follows, all but the last character are one match and the last begins what follows.
    """
    if not text:
        return np.zeros(0, np.uint32)
    if len(text) <= min(LONG, RUN):
        return np.array(enc.encode_ordinary(text), dtype=np.uint32)
    out: list[np.ndarray] = []
    at = 0
    for m in _RUNS.finditer(text):
        a, b = m.span()
        # White space beyond ASCII next to the run belongs to the same match: leave such runs to the library.
        if (a and text[a - 1].isspace()) or (b < len(text) and text[b].isspace()):
            continue
        end = b if b == len(text) else b - 1
        out += [np.array(enc.encode_ordinary(x), dtype=np.uint32) for x in safe_pieces(text[at:a]) if x]
        out.append(np.array(enc._core_bpe.encode_single_piece(text[a:end].encode()), dtype=np.uint32))
        at = end
    out += [np.array(enc.encode_ordinary(x), dtype=np.uint32) for x in safe_pieces(text[at:]) if x]
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_tokens, ids) or, with digest, (id, n_tokens, ids_sha256, decoded_sha256) for every row of docs.

    Ids are little-endian unsigned 32-bit integers in one binary. Null texts count as empty, repeated rows
    get a row each, no rows give none; other columns are not looked at. A scan and one Arrow pass: no shuffle, so neither hot sources nor copies matter.
    """
    wide = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            counts, first, second = [], [], []
            for text in batch.column(1):
                ids = encode(text.as_py() or "", enc)
                raw = ids.astype("<u4").tobytes()
                counts.append(len(ids))
                if digest:
                    first.append(hashlib.sha256(raw).hexdigest())
                    second.append(hashlib.sha256(decode(raw, enc)).hexdigest())
                else:
                    first.append(raw)
            rows = [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string() if digest else pa.binary())]
            yield pa.RecordBatch.from_arrays(rows + [pa.array(second, pa.string())] * digest, names=["i", "n", "a", "b"][: len(rows) + digest])

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids"]
    kinds = ["long", "string", "string"] if digest else ["long", "binary"]
    out = map_batches(docs.select(id_col, text_col), run, ", ".join(f"{n} {k}" for n, k in zip(["i", "n", "a", "b"], [wide, *kinds], strict=False)))
    return out.toDF(id_col, *names)


def decode(ids: bytes, enc) -> bytes:
    """The raw bytes behind little-endian ids; they need not be UTF-8 where ids were cut."""
    return enc.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, bytes) from (id, ids); null ids give empty bytes."""
    wide = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x.as_py() or b"", enc) for x in batch.column(1)], pa.binary())], names=["i", "bytes"])

    return map_batches(encoded.select(id_col, "ids"), run, f"i {wide}, bytes binary").toDF(id_col, "bytes")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of what they decode to; odd rows as encode_documents says."""
    import public_tokenizers as tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, digest=True)
