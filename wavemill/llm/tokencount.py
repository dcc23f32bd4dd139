"""Token counts: texts are encoded in batches inside Arrow functions, which return lengths alone.

Every text is cut at safe boundaries, places where the tokenizer cuts as well, so that the tokens of the parts are those of the whole. Parts that
come again are counted from memory; new ones are encoded together, in batches of about as many bytes each. No ids leave the encoder.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Counting:
    """tokenizer: path of a `tokenizers` file (.json) or a `sentencepiece` model (.model), the same on every machine. limit: over which a text is marked.
    batch_bytes: of text that is cut and encoded at once, about; a text or part longer than that is a batch of its own. parts: that a
    worker remembers; short: the most characters of those."""

    tokenizer: str
    limit: int = 2048
    batch_bytes: int = 1 << 20
    parts: int = 1_000_000
    short: int = 64


#: Before single white space between two other characters. What follows keeps it, as byte-level vocabularies join it to the next word.
_BEFORE_SPACE = re.compile(r"(?<=\S)(?=[ \t\n\r]\S)")
#: At a single space between plain letters or digits. It goes: the library puts one before each text.
_AT_SPACE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def _words_apart(config: dict) -> bool:
    """Whether a `tokenizers` file keeps words apart, so that its texts can be cut before white space: its patterns do, it puts nothing before a text or after it, and no
    added token takes neighbours in."""
    steps = config.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    last = steps[-1] if steps else {}
    by_pattern = last.get("use_regex") or any(s.get("type") == "Split" and s.get("invert") and s["behavior"] == "Removed" for s in steps)
    normal = config.get("normalizer") or {}
    known = all(n.get("type") in ("NFC", "NFD", "Replace", "Lowercase") and n.get("pattern", {}).get("Regex", r"\s+") == r"\s+" for n in normal.get("normalizers", [normal] if normal else []))
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in config.get("added_tokens", []))
    return bool(last.get("type") == "ByteLevel" and not last.get("add_prefix_space") and by_pattern and known and plain)


class Encoder:
    """How many tokens texts have. `cut` gives a text's parts, `count` the lengths of parts."""

    held: dict[Counting, Encoder] = {}  # a worker keeps them from task to task

    def __init__(self, how: Counting):
        self.how, self.known = how, {}
        self.cut: Callable[[str], list[str]] = lambda text: [text]
        if how.tokenizer.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=how.tokenizer)
            self.count = lambda parts: list(map(len, model.encode(parts, num_threads=1)))
            pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
            # no piece goes on after white space, and a text's first word is encoded as its others
            if all("▁" not in p.lstrip("▁") for p in pieces) and model.encode("a a") == 2 * model.encode("a"):
                self.cut = _AT_SPACE.split
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the only parallelism
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(how.tokenizer)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.count = lambda parts: list(map(len, tokenizer.encode_batch_fast(parts, add_special_tokens=False)))
            if _words_apart(json.loads(tokenizer.to_str())):
                self.cut = _BEFORE_SPACE.split

    @classmethod
    def of(cls, how: Counting) -> Encoder:
        if how not in cls.held:
            cls.held[how] = cls(how)
        return cls.held[how]

    def lengths(self, texts: list[str]) -> list[int]:
        """The tokens of each text, a batch of them at once."""
        parts = list(map(self.cut, texts))
        new = list(set(chain.from_iterable(parts)).difference(self.known))
        for batch in by_bytes(new, self.how.batch_bytes):
            self.known.update(zip(batch, self.count(batch), strict=True))
        out = [sum(map(self.known.__getitem__, own)) for own in parts]
        for part in new:
            if len(part) > self.how.short:
                del self.known[part]
        if len(self.known) > self.how.parts:
            self.known.clear()
        return out


def by_bytes(texts: list[str], most: int) -> Iterator[list[str]]:
    """The texts in order, in batches of about as many bytes: one ends where the next text would take it over the most."""
    batch, size = [], 0
    for text in texts:
        n = len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += n
    if batch:
        yield batch


def n_tokens(text: Column, how: Counting) -> Column:
    """The number of tokens of a text; a null one has none."""

    @F.arrow_udf("long")
    def lengths(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder.of(how)
        for column in columns:
            texts = [t or "" for t in column.to_pylist()]
            yield pa.array(np.fromiter(chain.from_iterable(map(encoder.lengths, by_bytes(texts, how.batch_bytes))), np.int64, len(texts)))

    return lengths(text)


def token_counts(docs: DataFrame, how: Counting) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row of docs(doc_id, text); other columns are not read.

    Texts are counted whole, without begin, end or other added tokens; the strings of special tokens in a text are those tokens where the
    library takes them so. Null and empty texts have 0 bytes and tokens. Repeated rows and null doc_ids are rows like others. Text without a
    safe boundary, however long, is encoded whole. Empty: no rows.
    """
    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, how).alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > how.limit).alias("over_limit"))
