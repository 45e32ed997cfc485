"""Encoding with a public byte-level BPE vocabulary, and decoding from raw bytes.

Defined results: a null and an empty text have an empty list; a text of any length is encoded whole; special tokens are
never produced (their strings are ordinary text). Other columns of the input are kept; a column that has the name of the
result is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pre-splitting pattern of the vocabulary (public).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters before which a run of letters ends in every Unicode version.
STOPS = " \n\t,.;:!?，。、；：！？"
#: Texts longer than this many characters are encoded piece by piece.
LONG = 1 << 18


def vocabulary_folder() -> str:
    """Folder of the installed public vocabularies."""
    import public_tokenizers

    return str(Path(public_tokenizers.__file__).parent)


@dataclass(frozen=True)
class Vocabulary:
    """A rank file in the public text format (base64 bytes, blank, rank); ``folder`` None means the installed one."""

    name: str = "byte_bpe_50k"
    folder: str | None = None
    pattern: str = PATTERN

    @property
    def path(self) -> str:
        return f"{self.folder or vocabulary_folder()}/{self.name}.tiktoken"


@lru_cache(maxsize=4)
def encoding(vocabulary: Vocabulary):
    """The encoder, loaded once in each Python worker."""
    import tiktoken

    with open(vocabulary.path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary.name, pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = LONG) -> Iterator[str]:
    """Pieces of about ``size`` characters; encoding them one by one gives the ids of the whole.

    A cut lies between a letter and one of ``STOPS``: every alternative of the pattern that takes the letter ends there, and
    none that starts at the stop looks back. Where there is no such place the piece goes on to the next one.
    """
    start = 0
    while len(text) - start > size:
        cut = start + size
        while cut > start and not (text[cut] in STOPS and text[cut - 1].isalpha()):
            cut -= 1
        if cut == start:
            cut = start + size
            while cut < len(text) and not (text[cut] in STOPS and text[cut - 1].isalpha()):
                cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode_text(text: str | None, vocabulary: Vocabulary = Vocabulary(), size: int = LONG) -> list[int]:
    if not text:
        return []
    enc = encoding(vocabulary)
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for piece in safe_pieces(text, size) for i in enc.encode_ordinary(piece)]


def decode_ids(ids: list[int] | None, vocabulary: Vocabulary = Vocabulary()) -> str:
    """The text of ``ids``, from the tokens' bytes; bytes that are no UTF-8 become U+FFFD, none is lost before decoding."""
    return b"".join(encoding(vocabulary).decode_tokens_bytes(ids or [])).decode("utf-8", errors="replace")


def encode_array(texts: pa.Array, vocabulary: Vocabulary) -> pa.ListArray:
    """Ids of an Arrow batch, built straight into Arrow buffers."""
    lists = [encode_text(t, vocabulary) for t in texts.to_pylist()]
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def token_ids(text: Column | str, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """Column of ids (array of int) of a text column."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield encode_array(texts, vocabulary)

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, "array<int>")(text)


def token_text(ids: Column | str, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """Column of texts of a column of ids; the inverse of ``token_ids`` (null and empty lists give an empty text)."""

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([decode_ids(x, vocabulary) for x in batch.to_pylist()], pa.string())

    decode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, "string")(ids)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """``df`` with the ids of its column ``text``; no shuffle, one pass over the scan."""
    return df.withColumn(ids, token_ids(F.col(text), vocabulary))
