"""The language of each document and of each paragraph, whatever its label says.

Method: per language a unigram model over the pieces of a fixed public vocabulary; a forward pass sums the
probabilities of all segmentations of a word into pieces, so no single segmentation has to be right. The
piece probabilities are fitted by expectation-maximisation on a bounded sample of labelled rows; labels are noisy,
so the sample is re-labelled paragraph by paragraph with the first fit and fitted again. A paragraph's score is
the sum over its words; quotations do not count while enough other words remain, and the document's main language
has a prior, which the words of a real change of language outweigh.

Null and wordless texts have no language and give no rows. Texts and paragraphs are scored whole.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.runtime import load, staged

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k"
#: Labelled rows of each language that the fit may use, and the characters of each of them.
SAMPLE_ROWS = 150
SAMPLE_CHARS = 3_000
#: Notations of labels that are sent to every executor at most.
MAX_LABELS = 10_000
LONGEST_PIECE = 18
ROUNDS = 2
STEPS = 2
#: Log-odds that a paragraph is in its document's main language.
PRIOR = 4.0
#: Words that must remain beside the quotations for these to be left out.
BESIDE = 3
#: Languages in the order of the model, with the names that labels use besides their codes (fixed values).
LANGUAGES = {
    "ar": ("ara", "arabic", "العربية", "عربي"),
    "de": ("deu", "ger", "german", "deutsch"),
    "en": ("eng", "english", "inglés", "anglais"),
    "es": ("spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fra", "fre", "french", "français", "francais"),
    "hi": ("hin", "hindi", "हिन्दी", "हिंदी"),
    "it": ("ita", "italian", "italiano"),
    "ja": ("jpn", "japanese", "日本語"),
    "pt": ("por", "portuguese", "português", "portugues"),
    "ru": ("rus", "russian", "русский"),
    "zh": ("zho", "chi", "chinese", "中文", "汉语", "漢語", "普通话"),
}
CODES = tuple(LANGUAGES)
NAMES = {n: code for code, names in LANGUAGES.items() for n in (code, *names)}
#: Runs of one script: kana, Han, or whatever spaces, digits and punctuation delimit; 24 characters at most at once.
RUN = re.compile("[぀-ヿ]{1,24}|[㐀-䶿一-鿿]{1,24}|[^\\s\\d!-/:-@\\[-`{-~«»“”„‘’‹›…—–·•。、！？「」『』（）：；，।॥؟،؛｜／％　​﻿぀-ヿ㐀-䶿一-鿿]{1,24}")
QUOTED = re.compile("«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]|「[^「」]*」|『[^『』]*』|\"[^\"]*\"")


def label_code(label: str | None) -> str | None:
    """The two-letter code that a label means in any notation, else None."""
    if not label:
        return None
    text = label.strip().lower()
    return NAMES.get(text) or NAMES.get(re.split(r"[-_]", text)[0])


def piece_word(run: str) -> bytes:
    """A run as the bytes that are segmented, after a space where its script has them; none if it has no letter."""
    return (run if "぀" <= run[0] <= "鿿" else " " + run).encode() if any(map(str.isalpha, run)) else b""


def piece_words(text: str) -> list[bytes]:
    """The words of a text."""
    return [w for w in map(piece_word, RUN.findall(text.lower())) if w]


class Segmenter:
    """Sums over the segmentations of words: ``table`` has a row of language probabilities for each piece."""

    def __init__(self, table: dict[bytes, np.ndarray], floor: float):
        self.table, self.floor, self.cache = table, np.full(len(CODES), floor), {}
        self.known, self.rows = np.zeros((1024, len(CODES))), 0

    def spans(self, word: bytes) -> list[tuple[int, int, np.ndarray]]:
        get, n, out = self.table.get, len(word), []
        for i in range(n):
            for j in range(i + 1, min(n, i + LONGEST_PIECE) + 1):
                p = get(word[i:j])
                if p is not None:
                    out.append((i, j, p))
                elif j == i + 1:
                    out.append((i, j, self.floor))
        return out

    def forward(self, word: bytes) -> tuple[np.ndarray, np.ndarray, list]:
        """(alpha, log scale, spans); alpha is rescaled as it goes, so long runs do not vanish."""
        spans = self.spans(word)
        alpha = np.zeros((len(word) + 1, len(CODES)))
        alpha[0] = 1.0
        for i, j, p in spans:
            alpha[j] += alpha[i] * p
        return alpha, np.log(np.maximum(alpha[-1], 1e-300)), spans

    def index(self, run: str) -> int:
        """The row of a run's log-probabilities in ``known``, which grows with the words met so far; -1 for no word."""
        word = piece_word(run)
        if not word:
            self.cache[run] = -1
            return -1
        self.rows += 1
        if self.rows > len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        self.cache[run] = at = self.rows - 1
        self.known[at] = self.forward(word)[1]
        return at

    def score(self, text: str) -> tuple[np.ndarray, int]:
        """(log-probability under each language, number of words)."""
        if len(self.cache) > 400_000:
            self.cache.clear()  # bounds the memory of a long task
            self.rows = 0
        get, rows = self.cache.get, []
        for run in RUN.findall(text.lower()):
            at = get(run)
            if at is None:
                at = self.index(run)
            if at >= 0:
                rows.append(at)
        return (self.known.take(rows, axis=0).sum(axis=0), len(rows)) if rows else (np.zeros(len(CODES)), 0)


def paragraph_score(model: Segmenter, line: str) -> tuple[np.ndarray, int]:
    """The score of a line without its quotations, unless too little remains."""
    bare = QUOTED.sub(" ", line)
    if len(bare) < len(line):
        score, n = model.score(bare)
        if n >= BESIDE:
            return score, n
    return model.score(line)


def paragraphs(model: Segmenter, text: str) -> list[tuple[int, int, float]]:
    """(line number, language, confidence) of each line with words."""
    scored = [(no, *paragraph_score(model, line)) for no, line in enumerate(re.split(r"\r\n|\n|\r", text), 1)]
    scored = [x for x in scored if x[2]]
    if not scored:
        return []
    votes = np.zeros(len(CODES))
    for _, s, n in scored:
        votes[int(s.argmax())] += n
    prior = np.where(np.arange(len(CODES)) == int(votes.argmax()), PRIOR, 0.0)
    out = []
    for no, s, _ in scored:
        p = s + prior
        p = np.exp(p - p.max())
        out.append((no, int(p.argmax()), float(p.max() / p.sum())))
    return out


def fit(rows: list[tuple[str, str]], vocabulary: list[bytes]) -> tuple[dict[bytes, np.ndarray], float]:
    """The piece probabilities from (code, text) rows."""
    pieces = set(vocabulary)
    lines = [(CODES.index(c), line) for c, text in rows for line in text.split("\n")]
    model = None
    for _ in range(ROUNDS):
        counts: dict[bytes, np.ndarray] = defaultdict(lambda: np.zeros(len(CODES)))
        for own, line in lines:
            if model is not None:
                score, n = paragraph_score(model, line)
                if n >= BESIDE:
                    own = int(score.argmax())
            for w, n in Counter(piece_words(line)).items():
                counts[w][own] += n
        # The first estimate counts every piece of a word, longer ones for more.
        table: dict[bytes, np.ndarray] = defaultdict(lambda: np.zeros(len(CODES)))
        for w, c in counts.items():
            for i in range(len(w)):
                for j in range(i + 1, min(len(w), i + LONGEST_PIECE) + 1):
                    if j == i + 1 or w[i:j] in pieces:
                        table[w[i:j]] += c * (j - i) ** 2 / len(w)
        for _ in range(STEPS):
            model = Segmenter(*normalised(table))
            table = defaultdict(lambda: np.zeros(len(CODES)))
            for w, c in counts.items():
                alpha, _, spans = model.forward(w)
                beta = np.zeros_like(alpha)
                beta[-1] = 1.0
                for i, j, p in reversed(spans):
                    beta[i] += p * beta[j]
                scale = c / np.maximum(alpha[-1], 1e-300)
                for i, j, p in spans:
                    table[w[i:j]] += scale * alpha[i] * p * beta[j]
        model = Segmenter(*normalised(table))
    return dict(model.table), float(model.floor[0])


def normalised(table: dict[bytes, np.ndarray]) -> tuple[dict[bytes, np.ndarray], float]:
    """Probabilities with a little mass for pieces unseen in a language, and the floor of pieces unseen in all."""
    total = sum(table.values(), np.zeros(len(CODES))) + 1.0
    smooth = 0.02
    return {p: (c + smooth) / (total + smooth * len(table)) for p, c in table.items() if c.max() > 1e-3}, float(smooth / (total.max() + smooth * len(table)) / 50)


def labelled_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """At most about ``SAMPLE_ROWS`` (code, text) rows of each language, chosen by a hash of the id."""
    code = F.udf(label_code, "string")
    labels = docs.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("code", code("lang")).where(F.col("code").isNotNull())
    shares = labels.groupBy("code").agg(F.sum("n").alias("all")).join(labels, "code").select("code", "lang", (F.lit(float(SAMPLE_ROWS)) / F.col("all")).alias("share"))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    # The labels that mean a language are few; they travel to the rows, no text is shuffled.
    shares = staged(shares, "label-shares")
    shares = F.broadcast(shares) if shares.count() <= MAX_LABELS else shares
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    chosen = rows.join(shares, "lang").where(chance < F.col("share")).select("code", "text", "doc_id")
    return [(r.code, r.text) for r in chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE_ROWS * len(CODES)).collect()]


def segments(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, label, segment, first_line, last_line, lang, confidence): runs of lines in one language."""
    spark = docs.sparkSession
    with open(f"{tokenizer_dir}/{VOCABULARY}.tiktoken", "rb") as f:
        vocabulary = [base64.b64decode(line.split()[0]) for line in f]
    table, floor = fit(labelled_sample(docs), [v for v in vocabulary if len(v) <= LONGEST_PIECE])
    # Bounded by the vocabulary: at most a row for each of its pieces.
    shipped = spark.sparkContext.broadcast((list(table), np.array(list(table.values()), dtype=np.float32).reshape(-1, len(CODES)), floor))
    columns = ["doc_id", "label", "segment", "first_line", "last_line", "lang", "confidence"]

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, rows, floor = shipped.value
        model = Segmenter(dict(zip(pieces, rows.astype(np.float64))), floor)
        for pdf in batches:
            out = []
            for doc_id, text, label in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["lang"].tolist()):
                runs: list[list] = []
                for no, lang, confidence in paragraphs(model, text):
                    if runs and runs[-1][2] == lang:
                        runs[-1][1] = no
                        runs[-1][3] = min(runs[-1][3], confidence)
                    else:
                        runs.append([no, no, lang, confidence])
                out += [(doc_id, label_code(label), k, a, b, CODES[lang], c) for k, (a, b, lang, c) in enumerate(runs)]
            if out:
                yield pd.DataFrame(out, columns=columns)

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string"))
    return rows.mapInPandas(over, "doc_id long, label string, segment int, first_line int, last_line int, lang string, confidence double")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang) of the documents with no usable label, a wrong one, or several languages: a row for each language of a whole paragraph."""
    found = segments(load(spark, sf_dir, "documents")).groupBy("doc_id", "label").agg(F.collect_set("lang").alias("langs"))
    asked = F.col("label").isNull() | ~F.array_contains("langs", F.col("label")) | (F.size("langs") > 1)
    return found.where(asked).select("doc_id", F.explode("langs").alias("lang"))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, segment, first_line, last_line, lang, confidence) of every document with words."""
    return segments(load(spark, sf_dir, "documents")).select("doc_id", "segment", "first_line", "last_line", "lang", F.round("confidence", 6).alias("confidence"))
