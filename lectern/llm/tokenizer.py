"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: one pass splits every text into pre-tokens with positions, coded against the distinct words of
its block; the distinct words of all blocks meet in one shuffle, each is encoded exactly once, and the
ids travel back to the blocks, where numpy puts them in the order of the positions.

Null texts and empty texts give an empty list of ids. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.runtime import load, staged, task_count

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed by the vocabulary: the pattern that splits text before merging.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same split for texts without letter-like or fractional numerals, in the faster standard engine.
PLAIN_TOKEN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Control characters that only the standard engine calls white space.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Characters of one block: bounds the memory of a block's row.
BLOCK_CHARS = 1_000_000
#: A word is hot in more than this many blocks and more than one part in ``HOT_PARTS`` of them; more hot words than ``MAX_HOT`` are joined by key too.
HOT_BLOCKS, HOT_PARTS, MAX_HOT = 64, 16, 500_000


def _odd_characters() -> frozenset[str]:
    """The characters that the two engines put into different classes, from the Unicode data itself."""
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No")) | frozenset(SEPARATORS)


def read_ranks(path: str) -> dict[bytes, int]:
    """The token bytes of a rank file with their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _blocks(batches: Iterator[pd.DataFrame], odd: frozenset[str]) -> Iterator[pd.DataFrame]:
    """Rows (block, doc_ids, lengths, codes, words): the texts of a block as numbers of its own words."""
    import regex
    from pyspark import TaskContext

    full = regex.compile(PRE_TOKEN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    part, made = TaskContext.get().partitionId(), 0

    def flush():
        nonlocal made
        block = (part << 32) + made
        made += 1
        return pd.DataFrame({"block": [block], "doc_ids": [np.array(ids, dtype=np.int64)], "lengths": [np.array(lengths, dtype=np.int32)], "codes": [np.array(codes, dtype=np.int32)], "words": [list(seen)]})

    ids, lengths, codes, seen, size = [], [], [], {}, 0
    for pdf in batches:
        for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
            words = (PLAIN_TOKEN if odd.isdisjoint(SEPARATORS if text.isascii() and any(map(text.__contains__, SEPARATORS)) else () if text.isascii() else set(text)) else full).findall(text) if text else []
            for w in words:
                code = seen.get(w)
                if code is None:
                    seen[w] = code = len(seen)
                codes.append(code)
            ids.append(doc_id)
            lengths.append(len(words))
            size += len(text or "")
            if size >= BLOCK_CHARS:
                yield flush()
                ids, lengths, codes, seen, size = [], [], [], {}, 0
    if ids:
        yield flush()


def encode(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text); repeated rows are encoded once each.

    The vocabulary is read where the driver runs and shipped to the tasks: its size is fixed (under 1 MB).
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(f"{tokenizer_dir}/{vocabulary}.tiktoken"))

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        enc = tiktoken.Encoding("corpus", pat_str=PRE_TOKEN, mergeable_ranks=ranks.value, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"word": pdf["word"], "ids": [enc._encode_single_piece(w) for w in pdf["word"]]})

    def assembled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_ids, lengths, codes, table in zip(pdf["doc_ids"], pdf["lengths"], pdf["codes"], pdf["table"]):
                pieces = [None] * (0 if table is None else len(table))
                for row in table if table is not None else ():
                    pieces[row["no"]] = row["ids"]
                sizes = np.array([len(p) for p in pieces], dtype=np.int64)
                flat = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.int32)
                starts = np.cumsum(sizes) - sizes
                per = sizes[codes] if len(codes) else np.zeros(0, dtype=np.int64)
                ends = np.cumsum(per)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - (ends - per), per) if len(codes) else np.zeros(0, dtype=np.int64)
                out = flat[at].astype(np.int32)
                bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
                yield pd.DataFrame({"doc_id": doc_ids, "ids": [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]})

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    odd = _odd_characters()
    blocks = staged(source.mapInPandas(lambda batches: _blocks(batches, odd), "block long, doc_ids array<long>, lengths array<int>, codes array<int>, words array<string>"), "token-blocks")
    words = blocks.select("block", F.posexplode("words").alias("no", "word"))
    # A word that a large part of the blocks hold would be one key of the join. Such words are at most HOT_PARTS times an average
    # block's, whatever the corpus; they are broadcast, the others joined by key.
    count = blocks.count()
    hot = staged(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HOT_BLOCKS, count // HOT_PARTS)).select("word"), "hot-words")
    few = hot.count() <= MAX_HOT
    hot = F.broadcast(hot.coalesce(1).mapInPandas(encoded, "word string, ids array<int>")) if few else None
    rest = words.join(F.broadcast(hot.select("word")), "word", "left_anti") if few else words
    distinct = rest.select("word").distinct().repartition(task_count(spark), "word").mapInPandas(encoded, "word string, ids array<int>")
    joined_back = rest.join(distinct, "word")
    joined_back = joined_back.unionByName(words.join(hot, "word")) if few else joined_back
    tables = joined_back.groupBy("block").agg(F.collect_list(F.struct("no", "ids")).alias("table"))
    return blocks.drop("words").join(tables, "block", "left").mapInPandas(assembled, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the distinct ids meet the token-byte table, whose size the vocabulary fixes."""
    table = encoded.sparkSession.sparkContext.broadcast([t for t, _ in sorted(read_ranks(f"{tokenizer_dir}/{vocabulary}.tiktoken").items(), key=lambda x: x[1])])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [b"".join([table.value[i] for i in ids]).decode("utf-8", "replace") for ids in pdf["ids"]]})

    return encoded.mapInPandas(joined, "doc_id long, text string")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the ids of its whole text."""
    return encode(load(spark, sf_dir, "documents").select("doc_id", "text"))
