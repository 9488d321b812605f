"""The pieces of a SentencePiece model file, as plain data that can be broadcast."""

from __future__ import annotations

from dataclasses import dataclass

#: Stands for a space in pieces; and, in texts, for a literal one: no text of Spark has lone surrogates.
SPACE, LITERAL = "▁", "\udc00"


@dataclass(frozen=True)
class Pieces:
    """``scores`` by piece, ``ids`` by piece, ``bytes_`` the ids of the 256 byte pieces, ``raw`` what each id stands for."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    raw: list[bytes]
    longest: int
    unknown_score: float


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str | None = None) -> Pieces:
    """The file is read here, on the driver; tasks get the pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    ids, scores, bytes_, raw = {}, {}, [0] * 256, []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[1:-1], 16)
            bytes_[value] = i
            raw.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            ids[piece], scores[piece] = i, model.get_score(i)
            raw.append(piece.replace(SPACE, " ").encode())
    return Pieces(ids, scores, bytes_, raw, max(map(len, ids)), min(scores.values()) - 10.0)
