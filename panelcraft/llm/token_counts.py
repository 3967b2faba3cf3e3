"""Token counts per text with a whole-token shortcut.

``proven_strings`` establishes offline, with the tokenizer itself, which
vocabulary strings encode alone as exactly one token. Counting then splits
texts at ASCII white space, looks every distinct piece of a batch up once
(pre-tokens that are proven strings count one each) and leaves only the rest
to the tokenizer's merges.

Cutting at ASCII white space is safe for this tokenizer family: its normaliser
turns white space into single spaces and composes characters (no composition
crosses a space), and its pre-tokenizer drops the spaces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from panelcraft.llm._ship import ship_package
from panelcraft.llm._words import CASED_WORDS, slices, split_words

WORD_END = "</w>"
#: the pre-tokenizer's pattern (fixed value, from the vocabulary file)
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: pieces whose normal form and pre-tokens are the same under any Unicode version
PLAIN = re.compile(r"[!-~¡-ɏ]+\Z")
#: distinct pieces remembered by a worker between batches
REMEMBERED = 500_000


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core already
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: letter -> byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def proven_strings(path: str) -> frozenset[str]:
    """Vocabulary strings that the tokenizer encodes alone as exactly one token."""
    tokenizer, letters = load(path), _byte_letters()
    found = {}
    for token, index in tokenizer.get_vocab(with_added_tokens=False).items():
        if not token.endswith(WORD_END):
            continue
        try:
            text = bytes(letters[c] for c in token.removesuffix(WORD_END)).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and not text.isspace():
            found[text] = index
    strings = list(found)
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded) if e.ids == [found[s]])


class PieceCounter:
    """Tokens of pieces without ASCII white space; remembers what it has counted."""

    def __init__(self, path: str):
        self.tokenizer, self.proven = load(path), proven_strings(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = {byte: letter for letter, byte in _byte_letters().items()}
        self.known: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def merged(self, parts: list[str]) -> list[int]:
        merge, letters = self.tokenizer.model.tokenize, self.letters
        return [len(merge(x.encode().decode("latin-1").translate(letters))) for x in parts]

    def parts(self, piece: str) -> list[str] | None:
        """Its pre-tokens in normal form; None if only the tokenizer can tell."""
        low = piece.lower()
        if not PLAIN.match(low) or any(s in piece for s in self.specials):
            return None
        return [low] if low.isalpha() else PRE_TOKENS.findall(low)

    def many(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece: proven pre-tokens count one, the rest is merged in one call."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        parts = [self.parts(p) for p in pieces]
        whole = [p for p, found in zip(pieces, parts) if found is None]
        new = {x for found in parts if found for x in found if x not in self.proven and x not in self.known}
        self.known.update(zip(new, self.merged(list(new))))
        of_whole = iter(self.whole(whole))
        size = self.known.get  # a proven string is never in here
        return np.fromiter(
            (next(of_whole) if found is None else sum(size(x, 1) for x in found) for found in parts),
            np.int64,
            len(pieces),
        )


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_texts(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of every text of a string array."""
    words = split_words(texts, CASED_WORDS)
    if not len(words.codes):
        return np.zeros(len(words), np.int64)
    tokens = counter(path).many(words.vocabulary.to_pylist())[words.codes]
    return np.diff(np.concatenate([[0], np.cumsum(tokens)])[words.starts])


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit``).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
    each; a null id is kept. Other columns of ``docs`` are not read. Whole texts
    are counted; no begin, end or added tokens, and special strings inside a
    text count as the tokenizer's default has it (one token each).
    """
    ship_package(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = batch.column(1)
            n = count_texts(texts, vocabulary)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit)],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean"
    )
    return out.withColumnRenamed("id", id_col)
