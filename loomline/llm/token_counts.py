"""Token counts by prefix sums over the pieces of a text.

A tokenizer that drops white space and never joins text across it can be counted piece by piece:
the count of a prefix that ends at a piece boundary is the sum over its pieces.  ``prefix_counts``
keeps that sum at every boundary, so that truncation and budget questions are answered by binary
search without encoding again.  A piece is encoded once by the library; its count is then looked up.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from itertools import accumulate, groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Any other character sends a text to the library whole. Of these, all steps treat each character by itself.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
OTHER = re.compile(f"[^{LETTERS}\\x00-\\x7f]")
#: The pattern of the file, for those characters (white space is dropped). Fixed value.
PIECES = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[\\x00-\\x08\\x0e-\\x1f!-/:-@[-`{{-\\x7f]+|[0-9]")
#: Bytes of pieces that a worker remembers at most, and what a piece takes besides its characters and its result, about.
REMEMBERED, ENTRY = 192 << 20, 200

COUNTS_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file (installed with its package, never copied here)."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteAlphabet(dict):
    """For str.translate: a character to the characters that stand for its bytes in a byte-level vocabulary."""

    def __init__(self):
        from tokenizers import pre_tokenizers

        self.level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, code: int) -> str:
        self[code] = out = self.level.pre_tokenize_str(chr(code))[0][0]
        return out


class Remembered:
    """What pieces gave, in two generations: the older half goes when the younger is full."""

    def __init__(self, compute):
        self.compute, self.young, self.old, self.size = compute, {}, {}, 0

    def all(self, pieces: list[str]) -> list:
        got = list(map(self.young.get, pieces))
        if None in got:
            for i, x in enumerate(got):
                if x is None and (x := self.young.get(p := pieces[i])) is None:
                    if (x := self.old.get(p)) is None:
                        x = self.compute(p)
                    if len(p) <= 64:
                        if self.size >= REMEMBERED // 2:
                            self.young, self.old, self.size = {}, self.young, 0
                        self.young[p] = x
                        self.size += ENTRY + len(p)
                got[i] = x
        return got


class PieceCounter:
    """Exact token counts of texts under word_bpe_49k.json (or a file of the same normaliser and pattern)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = ByteAlphabet()
        self.known = Remembered(lambda piece: len(self.tokenizer.model.tokenize(piece.translate(self.alphabet))))

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece_counts(self, text: str) -> list[int]:
        """Tokens of each piece, in order; a text with unusual characters or special strings is cut into pieces by the library."""
        if not text.isascii() and OTHER.search(text) or any(s in text for s in self.special):
            words = self.tokenizer.encode(text, add_special_tokens=False).word_ids
            return [len(list(tokens)) for _, tokens in groupby(words)]
        return self.known.all(PIECES.findall(text.lower()))

    def prefix_counts(self, text: str) -> list[int]:
        """Token count of the first 0, 1, 2, ... pieces."""
        return [0, *accumulate(self.piece_counts(text))]

    def count(self, text: str) -> int:
        return self.prefix_counts(text)[-1]

    def within(self, text: str, limit: int) -> tuple[int, bool]:
        """Tokens of the text, and whether some of its pieces are beyond the limit; both from the prefix counts."""
        prefix = self.prefix_counts(text)
        return prefix[-1], self.pieces_within(prefix, limit) < len(prefix) - 1

    @staticmethod
    def pieces_within(prefix: list[int], budget: int) -> int:
        """How many leading pieces fit a budget of tokens."""
        return bisect_right(prefix, budget) - 1


_COUNTERS: dict[str, PieceCounter] = {}


def counter_of(path: str) -> PieceCounter:
    """The counter of this worker process, which later tasks find with what it knows."""
    return _COUNTERS.get(path) or _COUNTERS.setdefault(path, PieceCounter(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Token count of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    Null or empty texts count zero bytes and tokens; repeated rows are counted each; a null doc_id stays
    null; other columns of ``docs`` are not read.  One pass, no shuffle; memory is one Arrow batch and the remembered pieces.
    """

    def run(batches):
        import pyarrow as pa

        counter = counter_of(path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            got = [counter.within(t, limit) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([n for n, _ in got], pa.int64()), pa.array([over for _, over in got], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTS_SCHEMA)


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token count at every prefix of its text (array of longs, first 0)."""

    def run(batches):
        import pyarrow as pa

        counter = counter_of(path)
        for batch in slices(batches):
            rows = [counter.prefix_counts(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "prefix_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, prefix_tokens array<long>")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
