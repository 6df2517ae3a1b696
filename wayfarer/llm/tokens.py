"""Token ids and token counts of whole texts, with a digest cache for the counts.

Encoding. The vocabulary file splits texts at white space before anything else, so
the ids of a text are those of its words in order; words are encoded by the library
itself, in batches, and remembered in a bounded table of the Python worker.

Counting. ``count_tokens`` joins the digests of content and tokenizer file to stored
counts, encodes only the distinct contents that miss, appends their counts to the
cache table and joins them back to all rows. The cache is a Parquet table; Spark's
commit makes an append whole or absent, and a digest stored twice counts once.

Defined results: a null text is empty and has 0 tokens; repeated rows and repeated
texts are encoded once and get a row each; an empty table gives an empty result.
Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm.common import new_folder, text_or_empty

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Words kept per Python worker, and the longest that is kept.
MEMO_WORDS, MEMO_LENGTH = 600_000, 48
#: str.split() takes these for white space, the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Latin letters whose lower case is one letter, then marks: the pre-tokenizer makes a piece of each.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]{1,48})([.,;:!?|]{0,3})")
#: Byte-level symbols: printable Latin-1 stands for itself, every other byte for a letter from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_SYMBOLS = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to encoding each text whole."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memo_words = memo_words

    def _piece(self, piece: str) -> bytes:
        """One piece as the pre-tokenizer cuts it, through the library's model."""
        symbols = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_SYMBOLS)
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def _remember(self, words: set[str]) -> list[str]:
        """Put every word into the table; the long ones are returned, to be forgotten again."""
        memo, older, hard = self.memo, self.older, []
        for word in words:
            known = older.get(word)
            if known is not None:
                memo[word] = known
            elif plain := _PLAIN.fullmatch(word):
                letters, marks = plain.groups()
                letters = letters.lower()
                ids = self._piece(letters)
                memo[word] = ids + self._piece(marks) if marks else ids
            else:
                hard.append(word)
        for at in range(0, len(hard), 4096):
            part = hard[at : at + 4096]
            found = self.library.encode_batch_fast(part, add_special_tokens=False)
            memo.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, found))
        return [w for w in hard if len(w) > MEMO_LENGTH]

    def _words(self, text: str) -> list[str]:
        return re.split("[ \t\n\r]+", text.strip(" \t\n\r")) if _SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._words(t) for t in texts]
        words = set().union(*split)
        if len(self.memo) > self.memo_words:
            self.older, self.memo = self.memo, {}
        long = self._remember(words.difference(self.memo))
        memo = self.memo
        out = [b"".join([memo[w] for w in one]) for one in split]
        for w in long:
            del memo[w]
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def slices(texts: list[str], chars: int = 1_000_000):
    """Runs of consecutive texts with about ``chars`` characters, to bound what is held at once."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def token_counter(path: str):
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(ids) // 4 for part in slices(texts.tolist()) for ids in encoder(path).encode(part)])

    return count


def version_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; an absent cache is an empty one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def count_tokens(docs: DataFrame, path: str | None = None, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``cache`` names the cache table, kept from run to run; None starts an empty one
    in the shared folder. ``path`` is the vocabulary file.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path()
    cache = cache or new_folder(spark, "token-cache")
    version = version_digest(path)
    text = text_or_empty()
    keyed = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("digest"))
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    misses = keyed.select("digest", "text").dropDuplicates(["digest"]).join(stored, "digest", "left_anti")
    misses.select("digest", F.lit(version).alias("tokenizer"), token_counter(path)("text").alias("n_tokens")).write.mode(
        "append"
    ).parquet(cache)
    counts = read_cache(spark, cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(
        F.max("n_tokens").alias("n_tokens")
    )
    return (
        keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(counts, "digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def token_table(batch: pa.RecordBatch, column: str, path: str) -> list[bytes]:
    """The id bytes of one batch's texts."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    return [ids for part in slices(texts) for ids in encoder(path).encode(part)]
