"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 code points of a text picks cut positions that
depend on content alone, so passages that documents share fall into the same
chunks. Within an executor's Python worker each distinct chunk is encoded once
(the store of chunks is bounded in bytes) and its ids are reused for every
document that holds it. A cut may fall inside a word; each join is therefore
repaired: the text between the white space on either side of the cut is encoded
again and spliced in once its left part agrees with the end of the left chunk's
ids and its right part with the start of the right chunk's. While they don't
agree the window grows by a word on both sides.

Reuse is per worker on purpose. Sharing chunk ids between executors would shuffle
every text twice to save the encoding of the repeated share only, and moving a
chunk costs more than encoding it. The operator is one map over the input: no
shuffle, no broadcast, and a lost executor repeats only its own tasks.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, kept_in_worker, slices

WINDOW, MEAN_CHUNK_BITS = 16, 10
#: Bytes, at most, of the stores of pieces and of chunks in a worker.
PIECE_BYTES, CHUNK_BYTES = 24_000_000, 32_000_000

#: Texts of these characters alone take the quick path: their NFC form is themselves,
#: their lower case has as many characters, and one byte of Latin-1 stands for each.
QUICK = re.compile(r"[\t-\r -~¡-ÿ]*")
LETTERS, NUMBERS, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r" \t-\r"
#: The split patterns of the two vocabularies, over those characters.
WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+")
BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def merged(model) -> Callable[[str], bytes]:
    """Piece of text -> its ids as little-endian 32-bit integers, by the tokenizer's model."""
    shown = byte_alphabet()
    table = {cp: "".join(shown[b] for b in chr(cp).encode()) for cp in range(256)}

    def ids(piece: str) -> bytes:
        found = [t.id for t in model.tokenize(piece.translate(table))]
        return struct.pack(f"<{len(found)}I", *found)

    return ids


class Encoder:
    """Ids of a text exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, piece_bytes: int = PIECE_BYTES):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.lower = self.tok.normalizer is not None
        self.find = (WORD_PIECES if self.lower else BYTE_PIECES).findall
        self.pieces = Store(merged(self.tok.model), piece_bytes)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.chunks = Store(self.plain, CHUNK_BYTES)

    @cached_property
    def names(self) -> list[str]:
        vocab = self.tok.get_vocab(with_added_tokens=True)
        out = [""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            out[i] = name
        return out

    def plain(self, text: str) -> bytes:
        """Ids as bytes, without chunks."""
        if QUICK.fullmatch(text) is None or any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, self.find(text.lower() if self.lower else text)))

    def encode(self, text: str) -> bytes:
        """Ids as bytes, from shared chunks with repaired joins."""
        cuts, spaces = cut_positions(text)
        if not cuts:
            return self.chunks[text]
        edges = [0, *cuts, len(text)]
        parts = [self.chunks[text[a:b]] for a, b in zip(edges, edges[1:])]
        out = [parts[0]]
        for n, cut in enumerate(cuts, 1):
            last, window, right = self.join(text, edges[n - 1], cut, edges[n + 1], spaces, out[-1], parts[n])
            out[-1] = last
            out.append(window)
            out.append(right)
        return b"".join(out)

    def join(self, text, start, cut, end, spaces, left, right):
        """``left`` without its last words, the ids of the window round the cut, ``right`` without its first words."""
        here, grow = int(np.searchsorted(spaces, cut)), 1
        while True:
            i, j = here - grow, here + grow - 1
            a = int(spaces[i]) if i >= 0 and spaces[i] > start else start
            b = int(spaces[j]) if j < len(spaces) and spaces[j] < end else end
            tail, head = self.plain(text[a:cut]), self.plain(text[cut:b])
            if left.endswith(tail) and right.startswith(head):
                return left[: len(left) - len(tail)], self.plain(text[a:b]), right[len(head) :]
            if a == start and b == end:
                return b"", self.plain(text[start:end]), b""
            grow *= 2

    def decode(self, ids: bytes) -> str:
        """As ``Tokenizer.decode(ids, skip_special_tokens=False)`` where the vocabulary has no decoder."""
        names = map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist())
        if self.tok.decoder is None:
            return " ".join(names)
        return self.tok.decoder.decode(list(names))


GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 256, np.uint32)


def cut_positions(text: str) -> tuple[list[int], np.ndarray]:
    """Cut positions set by content, at most one a word, and the places of ASCII white space.

    A cut needs white space in the chunk on either side, so the window of its
    repair ends within the two chunks. A run without white space is never cut.
    """
    if len(text) < 2 << MEAN_CHUNK_BITS:
        return [], GEAR[:0]
    try:
        codes = np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    spaces = np.flatnonzero((codes == 32) | ((codes >= 9) & (codes <= 13)))
    rolling = GEAR[codes & 255]
    width = 1
    while width < WINDOW:  # sums of shifted values over 2, 4, 8, 16 code points
        wider = rolling.copy()
        wider[width:] += rolling[:-width] << np.uint32(width)
        rolling, width = wider, 2 * width
    hits = np.flatnonzero((rolling >> np.uint32(32 - WINDOW)) & np.uint32((1 << MEAN_CHUNK_BITS) - 1) == 0) + 1
    hits = hits[(hits >= WINDOW) & (hits < len(codes))]
    word = np.searchsorted(spaces, hits)
    keep = np.ones(len(hits), bool)
    keep[1:] = word[1:] != word[:-1]
    keep &= (word > 0) & (word < len(spaces))
    return hits[keep].tolist(), spaces


def encoder(path: str, piece_bytes: int = PIECE_BYTES) -> Encoder:
    """One encoder for each vocabulary, bound of its pieces, and worker; its stores are bounded."""
    return kept_in_worker("bpe", f"{path} {piece_bytes}", lambda: Encoder(path, piece_bytes))


#: Columns the operator can return, in Arrow and Spark types.
OUTPUTS: dict[str, tuple[pa.DataType, str]] = {
    "n_tokens": (pa.int64(), "long"), "ids": (pa.binary(), "binary"), "ids_sha256": (pa.string(), "string"),
    "decoded": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string"),
}


def encode_decode(df: DataFrame, tokenizer: str, outputs=("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode it again.

    ``ids`` holds little-endian unsigned 32-bit integers. Null texts count as
    empty: no ids, an empty decoded text. Ids may be null or repeat; each row
    gives one row. Other columns of ``df`` are not read.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{c} {OUTPUTS[c][1]}" for c in outputs)
    return df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInArrow(_mapper(tokenizer, tuple(outputs)), schema)


def _mapper(path: str, outputs: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        enc = encoder(path)
        decoding = any(c.startswith("decoded") for c in outputs)
        for batch in batches:
            for part in slices(batch):
                cols: dict[str, list] = {c: [] for c in outputs}
                for text in part.column(1).to_pylist():
                    ids = enc.encode(text)
                    row = {"n_tokens": len(ids) // 4, "ids": ids, "ids_sha256": hashlib.sha256(ids).hexdigest() if "ids_sha256" in cols else None}
                    if decoding:
                        back = enc.decode(ids)
                        row |= {"decoded": back, "decoded_sha256": hashlib.sha256(back.encode()).hexdigest()}
                    for c in outputs:
                        cols[c].append(row[c])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(cols[c], OUTPUTS[c][0]) for c in outputs)], names=[part.schema.names[0], *outputs])

    return run
