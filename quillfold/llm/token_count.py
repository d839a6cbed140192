"""Token counts of whole texts in Arrow batches; only the lengths leave the function."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm.common import per_text, structs

_MARK = "▁"  # how the piece model writes a blank


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def blank_starts_piece(pieces: list[str]) -> bool:
    """Whether the vocabulary has blanks only at the start of pieces.

    Then no merge reaches over the place between a letter and a following blank, and a text may be
    cut there.
    """
    return not any(_MARK in p.lstrip(_MARK) for p in pieces)


def safe_parts(text: str, limit: int) -> list[str]:
    """Cut ``text`` after about ``limit`` characters each, only at a blank that follows a non-blank.

    That blank is dropped: the encoder itself puts one before every part.  A stretch without such a
    place stays whole.
    """
    parts, at, n = [], 0, len(text)
    while n - at > limit:
        cut = text.find(" ", at + limit)
        while cut > 0 and text[cut - 1] in (" ", _MARK):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        if cut + 1 >= n:  # nothing follows, so the blank itself is a token
            break
        parts.append(text[at:cut])
        at = cut + 1
    parts.append(text[at:])
    return parts


def _counter(model_path: str | None, part_chars: int) -> Callable[[list[str | None]], list[int]]:
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_path or default_model())
    cuttable = blank_starts_piece([sp.id_to_piece(i) for i in range(sp.get_piece_size())])

    def count(texts: list[str | None]) -> list[int]:
        parts, owner = [], []
        for i, t in enumerate(texts):
            own = [""] if not t else safe_parts(t, part_chars) if cuttable and len(t) > part_chars else [t]
            parts += own
            owner += [i] * len(own)
        out = [0] * len(texts)
        for i, ids in zip(owner, sp.encode(parts, num_threads=1), strict=True):
            out[i] += len(ids)
        return out

    return count


def count_tokens(
    docs: DataFrame,
    *,
    text_col: str = "text",
    model_path: str | None = None,
    batch_bytes: int = 1 << 20,
    part_chars: int = 20_000,
    out_col: str = "tokens",
) -> DataFrame:
    """``docs`` with a struct column ``out_col`` of ``n_bytes`` (UTF-8) and ``n_tokens``.

    ``model_path`` is a sentencepiece model; by default that of the installed tokenizer package, so
    every executor finds its own copy.  No begin, end or other special tokens are added.

    Defined cases: a null text counts as empty (0 and 0); very long texts are encoded whole, in
    parts cut where no token can reach over; repeated rows count alike; an existing column
    ``out_col`` is replaced; an empty table stays empty.
    """
    kinds = {"n_bytes": pa.int64(), "n_tokens": pa.int64()}

    def make():
        count = _counter(model_path, part_chars)

        def run(texts: list[str | None]) -> pa.Array:
            return structs(kinds, [[len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], count(texts)])

        return run

    return docs.withColumn(out_col, per_text(make, "n_bytes long, n_tokens long", batch_bytes)(F.col(text_col).cast("string")))
