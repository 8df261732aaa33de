"""Evaluation passages inside training text.

Method: the words of the passages are normalised (case, accents, punctuation and white space do not count)
and their n-grams put into a broadcast hash set; every window of every document is looked up, and hits are
verified word by word: chained runs must cover at least ``MIN_COVER`` of the passage's words in order, with at
most one changed word in ``WORDS_PER_CHANGE``. The n-grams of a passage are as long as the shortest unchanged run that the
longest one of a qualifying stretch can be (``gram_size``), so no window that qualifies is missed, wherever its words
are changed. ``cleaned`` cuts the reproduced spans out of the texts.

The broadcast is bounded: passages go in blocks of at most ``BLOCK_PASSAGES`` (distinct passages), and a larger
set is scanned block by block. Null and wordless texts and passages take part in no pair. Texts are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.runtime import load

MIN_COVER = 0.5
WORDS_PER_CHANGE = 6
BLOCK_PASSAGES = 20_000
WORD = re.compile(r"[^\W_]+")
#: Scripts written without spaces: every character counts as a word.
SPACELESS = re.compile("([぀-ヿ㐀-鿿가-힯฀-๿])")
MARKS = re.compile("[̀-ͯ­​-‏⁠﻿]")
MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_size(n: int) -> int:
    """The length of the longest unchanged run that every qualifying stretch of a passage of ``n`` words has at least.

    A stretch of t words with c changes has c + 1 runs, the longest of which has a (c + 1)-th part of the unchanged words or more. The least of
    these is reached below two changes' worth of words beyond the shortest stretch.
    """
    shortest = max(1, math.ceil(n * MIN_COVER))
    runs = lambda t: math.ceil((t - t // WORDS_PER_CHANGE) / (t // WORDS_PER_CHANGE + 1))
    return min(map(runs, range(shortest, shortest + 2 * WORDS_PER_CHANGE + 1)))


def words_of(text: str) -> list[str]:
    """The words of a text in their comparable form."""
    text = text.lower()
    if not text.isascii():
        text = SPACELESS.sub(r" \1 ", MARKS.sub("", unicodedata.normalize("NFKD", text)))
    return WORD.findall(text)


def gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for each window of ``n`` word codes."""
    keys = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint64)
    for k in range(n):
        keys = (keys ^ codes[k : len(codes) - n + 1 + k]) * MIX
        keys ^= keys >> np.uint64(29)
    return keys


class PassageIndex:
    """The n-grams of a block of passages with their places."""

    def __init__(self, passages: list[list[str]]):
        self.passages = passages
        self.vocabulary: dict[str, int] = {}
        for p in passages:
            for w in p:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.sizes = sorted({gram_size(len(p)) for p in passages if p})
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = {n: defaultdict(list) for n in self.sizes}
        self.coded = [np.array([self.vocabulary[w] for w in p], dtype=np.uint64) for p in passages]
        for k, p in enumerate(self.coded):
            if len(p):
                n = gram_size(len(p))
                for at, key in enumerate(gram_keys(p, n).tolist()):
                    self.places[n][key].append((k, at))
        self.keys = {n: np.array(sorted(places), dtype=np.uint64) for n, places in self.places.items()}

    def found(self, text: str) -> list[tuple[int, int, int]]:
        """(passage, first, last): the passages reproduced in a text, and the words of the text that do it."""
        get = self.vocabulary.get
        codes = np.array([get(w, 0) for w in words_of(text)], dtype=np.uint64)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, known in self.keys.items():
            keys = gram_keys(codes, n)
            if not len(keys):
                continue
            at = np.searchsorted(known, keys)
            at[at == len(known)] = 0
            for i in np.nonzero(known[at] == keys)[0].tolist():
                for k, j in self.places[n][int(keys[i])]:
                    hits[k].append((i, j))
        out = []
        for k, places in hits.items():
            stretch = reproduced(codes, self.coded[k], places, gram_size(len(self.coded[k])))
            if stretch:
                out.append((k, *stretch))
        return out


def reproduced(text: np.ndarray, passage: np.ndarray, hits: list[tuple[int, int]], n: int) -> tuple[int, int] | None:
    """(first, last) word of the stretch that reproduces enough of the passage, else None.

    Hits are joined to maximal runs on their diagonals; runs are chained in order of both texts. A gap costs
    the words changed in it. Of all chains that keep the allowed rate of changes the longest counts.
    """
    runs, seen = [], set()
    for i, j in sorted(hits):
        if (i, j) in seen:
            continue
        a, b, length = i, j, 0
        while a > 0 and b > 0 and text[a - 1] == passage[b - 1]:
            a, b = a - 1, b - 1
        while a + length < len(text) and b + length < len(passage) and text[a + length] == passage[b + length]:
            seen.add((a + length, b + length))
            length += 1
        if length >= n:
            runs.append((a, b, length))
    # Short unchanged runs between two changes are no hits: the words between two chained runs are compared one by one.
    best: list[list[tuple[int, int, int, int]]] = []
    for a, b, length in (runs := sorted(set(runs))):
        states = {(a, length, 0)}
        for (pa, pb, pl), before in zip(runs, best):
            ga, gb = a - pa - pl, b - pb - pl
            over = max(0, -ga, -gb)  # runs may share a repeated word
            ga, gb = ga + over, gb + over
            if pa + pl > a + length - 1 or pb + pl > b + length - 1 or over >= length or max(ga, gb) > len(passage):
                continue
            same = int((text[a + over - ga : a + over] == passage[b + over - gb : b + over]).sum()) if ga == gb and ga else 0
            cost = max(ga, gb) - same
            for first, matched, changed in before:
                states.add((first, matched + length - over + same, changed + cost))
        # A state is of use only if no other has at least its matches with fewer changes.
        kept, least = [], None
        for s in sorted(states, key=lambda s: (-s[1], s[2])):
            if least is None or s[2] < least:
                kept.append(s)
                least = s[2]
        best.append(kept)
    for (a, b, length), states in sorted(zip(runs, best), key=lambda x: -max(s[1] for s in x[1])):
        most = len(passage) // (WORDS_PER_CHANGE - 1) + 1  # no stretch has more changes
        after = beyond(text[a + length :], passage[b + length :], most)
        for first, matched, changed in states:
            start = next(pb for pa, pb, _ in runs if pa == first)
            for m1, c1 in beyond(text[:first][::-1], passage[:start][::-1], most):
                for m2, c2 in after:
                    m, c = matched + m1 + m2, changed + c1 + c2
                    if c * WORDS_PER_CHANGE <= m + c and m + c >= MIN_COVER * len(passage):
                        return first - m1 - c1, a + length - 1 + m2 + c2
    return None


def beyond(text: np.ndarray, passage: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(same, changed) words of the ways to go on past the end of a run, each ending with a word that is the same."""
    out, same, changed = [(0, 0)], 0, 0
    passage, text = passage[: len(text)], text[: len(passage)]
    for x, y in zip(text.tolist(), passage.tolist()):
        if x == y:
            same += 1
            out.append((same, changed))
        else:
            changed += 1
            if changed > most:
                break
    return out


def passage_blocks(items: DataFrame) -> Iterator[dict[str, list[int]]]:
    """The distinct passages with their items, in blocks of ``BLOCK_PASSAGES``; one empty block if there are none."""
    rows = items.where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).select("item_id", "passage").distinct().orderBy("passage", "item_id").toLocalIterator()
    block: dict[str, list[int]] = {}
    for row in rows:
        if row.passage not in block and len(block) == BLOCK_PASSAGES:
            yield block
            block = {}
        block.setdefault(row.passage, []).append(row.item_id)
    yield block


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, last_word) of every passage of ``items`` reproduced in ``docs`` (doc_id, text)."""
    schema = "doc_id long, item_id long, first_word int, last_word int"

    def scan(block: dict[str, list[int]]) -> DataFrame:
        shipped = docs.sparkSession.sparkContext.broadcast(([words_of(p) for p in block], list(block.values())))

        def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            passages, ids = shipped.value
            index = PassageIndex(passages)
            for pdf in batches:
                found = [(d, item, a, b) for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()) for k, a, b in index.found(t) for item in ids[k]]
                if found:
                    yield pd.DataFrame(found, columns=["doc_id", "item_id", "first_word", "last_word"])

        return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(over, schema)

    return reduce(DataFrame.unionByName, map(scan, passage_blocks(items)))


#: What can stand between two cuts: a character of a script without spaces, or a run of others up to the next white space.
PIECE = re.compile(f"{SPACELESS.pattern}|[^\\s{SPACELESS.pattern[2:-2]}]+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the spans (first, last) and what stands between these words."""
    gone = sorted(spans)
    out, at, word, k = [], 0, 0, 0
    start = None
    for m in PIECE.finditer(text):
        n = len(words_of(m[0]))
        while k < len(gone) and gone[k][1] < word:
            k += 1
        cut = n > 0 and k < len(gone) and gone[k][0] < word + n
        if cut and start is None:
            start = m.start()
            out.append(text[at:start])
        elif not cut and n and start is not None:
            start = None
        if cut:
            at = m.end()
        word += n
    return "".join(out) + text[at:]


def cleaned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text, leaked_items) of every row of ``docs`` (doc_id, text): the text without the spans that reproduce a passage, and how many items these were of.

    A text is scanned again after its spans are cut, until it holds none. Null texts stay null; texts without a leak stay as they are.
    """
    out = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.lit(0).alias("leaked_items"))
    for block in passage_blocks(items):
        shipped = docs.sparkSession.sparkContext.broadcast(([words_of(p) for p in block], [len(x) for x in block.values()]))

        def over(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            passages, sizes = shipped.value
            index = PassageIndex(passages)
            for pdf in batches:
                texts, counts = [], []
                for text, leaked in zip(pdf["text"].tolist(), pdf["leaked_items"].tolist()):
                    seen: set[int] = set()
                    while text and (found := index.found(text)):
                        seen |= {k for k, *_ in found}
                        less = without(text, [(a, b) for _, a, b in found])
                        if less == text:
                            break
                        text = less
                    texts.append(text)
                    counts.append(leaked + sum(sizes[k] for k in seen))
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": pd.Series(texts, dtype=object), "leaked_items": counts})

        out = out.mapInPandas(over, "doc_id long, text string, leaked_items int")
    return out


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): the documents and the test items that leaked into them."""
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, leaked_items) of every document: its text with the leaked spans cut out, and how many test items it held."""
    return cleaned(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))
