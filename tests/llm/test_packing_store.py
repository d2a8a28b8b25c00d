"""What the packing operator keeps of pieces."""

from __future__ import annotations

from terrace.llm import bpe
from terrace.llm.queries import vocabulary


def test_pieces_take_the_room_of_chunks_where_none_are_kept():
    """More distinct words than fit in the room of pieces alone: a second look at them encodes none again."""
    path = vocabulary("byte_bpe_50k.json")
    enc, made = bpe.encoder(path, bpe.PIECE_BYTES + bpe.CHUNK_BYTES), []
    make = enc.pieces.make
    enc.pieces.make = lambda piece: made.append(piece) or make(piece)
    text = " ".join(f"w{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}{chr(97 + n // 676 % 26)}{chr(97 + n // 17576)}" for n in range(150_000))
    first = enc.plain(text)
    known = len(made)
    assert known >= 150_000 and enc.plain(text) == first and len(made) == known
    assert bpe.encoder(path) is not enc and bpe.encoder(path).plain(text[:5000]) == bpe.np.array(enc.tok.encode(text[:5000], add_special_tokens=False).ids, "<u4").tobytes()
