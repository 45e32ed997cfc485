"""Blocks of texts as token ids, in batches within the Python workers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.blocks import explode_blocks


# The markers of the chat format and their ids, behind a vocabulary of 32,000.
CHAT_MARKERS = (
    ("<|endoftext|>", 32000), ("<|assistant|>", 32001), ("<|placeholder1|>", 32002), ("<|placeholder2|>", 32003), ("<|placeholder3|>", 32004), ("<|placeholder4|>", 32005),
    ("<|system|>", 32006), ("<|end|>", 32007), ("<|placeholder5|>", 32008), ("<|placeholder6|>", 32009), ("<|user|>", 32010),
)
#: The marker behind which white space stays.
END_OF_TEXT = "<|endoftext|>"
#: The declared longest sequence; nothing is cut to it unless ``max_length`` is given.
DECLARED_LENGTH = 4096


@dataclass(frozen=True)
class TokenizerConfig:
    """A SentencePiece model (``.model``) or a tokenizer file (``.json``); no ids are added before or after a text.

    ``markers`` become their ids wherever their strings stand, and take the white space behind them along (but for the end of a
    text); without them every string is ordinary text.
    """

    path: str
    batch: int = 256
    markers: tuple[tuple[str, int], ...] = ()
    max_length: int | None = None


def public_model(name: str = "piece_bpe_32k.model") -> str:
    """Path of a public vocabulary that is installed on this machine."""
    import public_tokenizers

    return str(Path(public_tokenizers.__file__).parent / name)


@lru_cache(maxsize=4)
def _encoder(path: str):
    """Loaded once in each Python worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def _decoder(path: str):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).decode
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).decode_batch


def encoded(texts: list[str], config: TokenizerConfig) -> list[list[int]]:
    """Ids of each text."""
    encode = _encoder(config.path)
    if not config.markers:
        out = encode(texts)
    else:
        ids = dict(config.markers)
        marker = re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + rf")(?:(?<!{re.escape(END_OF_TEXT)})\s+)?")
        parts = [marker.split(t) for t in texts]
        plain = iter(encode([p for own in parts for p in own[::2]]))
        out = [[i for k, p in enumerate(own) for i in ([ids[p]] if k % 2 else next(plain))] for own in parts]
    return out if config.max_length is None else [x[: config.max_length] for x in out]


def left_padded(ids: Column | str, length: int, pad: int = CHAT_MARKERS[0][1]) -> Column:
    """The ids with ``pad`` before them up to ``length``; longer lists stay as they are."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(ids))), ids)


def token_column(text: Column | str, config: TokenizerConfig) -> Column:
    """Array of token ids; null and empty texts have an empty one."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            out: list[list[int]] = []
            for start in range(0, len(texts), config.batch):
                out += encoded(texts[start : start + config.batch], config)
            yield pa.array(out, pa.list_(pa.int32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>")(text)


def text_column(ids: Column | str, config: TokenizerConfig) -> Column:
    """The text of a column of ids, without markers; null and empty lists give an empty text."""
    markers = {i for _, i in config.markers}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = _decoder(config.path)
        for batch in batches:
            yield pa.array(decode([[i for i in x or () if i not in markers] for x in batch.to_pylist()]), pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(ids)


def tokenized_blocks(files: DataFrame, config: TokenizerConfig, blocker: str = "chapter") -> DataFrame:
    """(block_id, tokens) of every block of the files."""
    return explode_blocks(files, blocker=blocker).select("block_id", token_column("text", config).alias("tokens"))


def json_line(block_id: str, tokens: list[int]) -> str:
    """One line of the token sink."""
    return json.dumps({"blockId": block_id, "tokens": tokens}, ensure_ascii=False, separators=(",", ":"))
