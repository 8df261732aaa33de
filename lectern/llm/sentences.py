"""Sentence units of every line, in any language or script.

Method: abbreviations, number collocations and sentence starters are learned without labels, per language, by
log-likelihood ratios over the whole corpus; then each period is classified with these statistics. The other
sentence marks end a unit wherever they stand outside a quotation. A line's end always ends a unit, and
a quotation inside a sentence does not.

Evidence for an abbreviation is a word that hardly occurs without its period and whose period is seen inside
sentences: before a lower-case word, a digit or a comma, or so near a sentence's start and so regularly away from
a line's end that it cannot close one. Blank lines, null and empty contents give no units; very long lines are
split whole; repeated rows of an id count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.lines import one_row_each, with_site
from lectern.runtime import load, staged

#: Log-likelihood ratio from which an association counts (the 0.995 point of chi-squared with one degree).
SIGNIFICANT = 7.88
OPENERS = "«“\"„‹'‘(¿¡*_[「『"
TRAILERS = ",;:!?…»”\"’)]*_"
#: A distinct type may be of use only if it was seen so often.
MIN_SEEN = 3
#: Bounds what is shipped to the tasks: significant types are few, whatever the corpus' size.
MAX_MODEL = 1_000_000
DOT_WORD = re.compile(r"(\S*[^\s.…])\.(?=(,|;|:|\s+([^\s«“\"„‹'‘(¿¡*_\[]?)|\s*$))")
EARLY = re.compile(r"(?:^|[.!?…।。][\"»”)]*\s+)(?:[-*>#•]+\s+)?(?:[^\s.]+\s+)?([^\s.]+)\.(?=\s)")
AFTER_NUMBER = re.compile(r"(?<![\w.,])\d+\.\s+([^\W\d_]+)(?![\w'’])")
AFTER_STOP = re.compile(r"[.!?…।。][\"»”)]*\s+([^\W\d_]+)")
INITIALS = re.compile(r"(?:^|[\s(])(\S)\.\s?$")


def word_type(token: str, before: str) -> str:
    """The type of a word with a period: itself, with the single letter and period before it if there is one."""
    token = token.lstrip(OPENERS)
    if token.isdigit():
        return "0"
    if len(token) == 1 and (m := INITIALS.search(before)):
        return f"{m[1]}. {token}"
    return token


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts (lang, kind, type, n): kinds w with period, u without, l before lower case, digit or comma, c before those but digits, e at a line's end, f near a sentence's start, a after a number, s after a stop, t total."""
    counts: dict[str, Counter] = defaultdict(Counter)

    def flush():
        out = []
        for lang, c in counts.items():
            sums: Counter = Counter()
            for (kind, token), n in c.items():
                if kind == "r":
                    core = token.lstrip(OPENERS).rstrip(TRAILERS)
                    if core and not core.endswith("."):
                        sums["u", core] += n
                else:
                    sums[kind, token] += n
            out += [(lang, kind, token, n) for (kind, token), n in sums.items()]
        counts.clear()
        return pd.DataFrame(out, columns=["lang", "kind", "type", "n"])

    for pdf in batches:
        for lang, content in zip(pdf["lang"].tolist(), pdf["content"].tolist()):
            c = counts[lang]
            for line in content.split("\n"):
                words = line.split()
                if not words:
                    continue
                for w in words:
                    c["r", w] += 1
                if "." not in line:
                    continue
                for m in DOT_WORD.finditer(line):
                    t = word_type(m[1], line[max(0, m.start() - 4) : m.start()])
                    c["w", t] += 1
                    if m[2] in (",", ";", ":"):
                        c["l", t] += 1
                        c["c", t] += 1
                    elif m[3]:
                        if m[3].islower():
                            c["l", t] += 1
                            c["c", t] += 1
                        elif m[3].isdigit():
                            c["l", t] += 1
                    elif not m[2].strip() and m.end() + len(m[2]) >= len(line):
                        c["e", t] += 1
                for t in EARLY.findall(line):
                    c["f", t.lstrip(OPENERS)] += 1
                for t in AFTER_NUMBER.findall(line):
                    c["a", t] += 1
                for t in AFTER_STOP.findall(line):
                    c["s", t] += 1
        if sum(map(len, counts.values())) > 400_000:
            yield flush()
    if counts:
        yield flush()


def ratio(k: float, n: float, p0: float, p1: float) -> float:
    """Twice the log-likelihood ratio of k successes in n under p1 against p0."""
    bound = lambda p: min(max(p, 1e-9), 1 - 1e-9)
    p0, p1 = bound(p0), bound(p1)
    return 2 * (k * math.log(p1 / p0) + (n - k) * math.log((1 - p1) / (1 - p0)))


def learn(articles: DataFrame) -> DataFrame:
    """(lang, kind, type): the significant types of each language from (lang, content).

    Kinds: abbr an abbreviation that sentences go on after, title one that a name follows, end an abbreviation
    that may close a sentence, never a language without periods at the end of sentences, number a word that follows ordinal numbers, start a sentence starter.
    """
    counts = articles.mapInPandas(_count, "lang string, kind string, type string, n long")
    by_type = staged(counts.groupBy("lang", "type").pivot("kind", ["w", "u", "l", "c", "e", "f", "a", "s"]).agg(F.sum("n")).fillna(0), "type-counts")
    wide = staged(by_type.where((F.col("w") >= MIN_SEEN) | (F.col("a") >= MIN_SEEN) | (F.col("s") >= MIN_SEEN)), "period-types")
    totals = staged(by_type.groupBy("lang").agg(F.sum("w").alias("all_w"), F.sum("u").alias("all_u"), F.sum("e").alias("all_e"), F.sum("a").alias("all_a"), F.sum("s").alias("all_s")), "period-totals")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, never = [], set()
            for r in pdf.itertuples(index=False):
                all_words = r.all_w + r.all_u + 1
                seen = r.w + r.u
                letters = [x for x in r.type if x.isalpha()]
                if r.w >= MIN_SEEN and r.type != "0" and letters:
                    bound = ratio(r.w, seen, (r.all_w + 1) / all_words, 0.99) >= SIGNIFICANT and r.w >= 0.8 * seen
                    inside = r.l / r.w
                    away = ratio(r.e, r.w, (r.all_e + 1) / (r.all_w + 2), 0.001) >= SIGNIFICANT
                    if bound and inside >= 0.1:
                        out.append((r.lang, "abbr", r.type))
                        if r.e > 0.005 * r.w:
                            out.append((r.lang, "end", r.type))
                        if r.c >= 0.05 * r.w:
                            out.append((r.lang, "goes", r.type))
                    elif bound and away and r.f >= 0.02 * r.w:
                        out.append((r.lang, "title", r.type))
                if r.all_e < 0.02 * r.all_w:
                    # One row says it of all types of a language whose sentences end with another mark than the period.
                    never.add((r.lang, "never", "*"))
                if r.a >= MIN_SEEN and ratio(r.a, max(seen, r.a), (r.all_a + 1) / all_words, r.a / max(seen, r.a)) >= SIGNIFICANT and r.a >= 0.3 * seen:
                    out.append((r.lang, "number", r.type))
                if r.s >= MIN_SEEN and ratio(r.s, max(seen, r.s), (r.all_s + 1) / all_words, r.s / max(seen, r.s)) >= SIGNIFICANT and r.s >= 0.3 * seen:
                    out.append((r.lang, "start", r.type))
            if out or never:
                yield pd.DataFrame(out + sorted(never), columns=["lang", "kind", "type"])

    return wide.join(totals, "lang").mapInPandas(decide, "lang string, kind string, type string").distinct()


STOP = re.compile(r"[.…]+|[!?！？؟]+|[。｡।॥]+")
CLOSER = re.compile(r"[\"»”’」』)\]）*_›]*")
PAIRS = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "‹": "›", '"': '"', "(": ")", "（": "）", "[": "]"}
QUOTE = re.compile("[«“„「『‹\"(（\\[]")
LEADING = re.compile(r"[\s«“\"„‹'‘(¿¡*_\[「『]*")


def quoted(line: str) -> list[tuple[int, int]]:
    """The spans of the closed quotations and brackets of a line, outermost only."""
    out, at = [], 0
    while m := QUOTE.search(line, at):
        close = line.find(PAIRS[m[0]], m.end())
        if close < 0 and m[0] == "„":
            close = line.find("”", m.end())
        if close < 0:
            at = m.end()
        else:
            out.append((m.start(), close))
            at = close + 1
    return out


def split_line(line: str, model: dict[str, set[str]]) -> list[str]:
    """The sentence units of a line, as they stand, without surrounding white space."""
    spans = quoted(line) if QUOTE.search(line) else []
    units, start, k = [], 0, 0
    for m in STOP.finditer(line):
        i, end = m.start(), m.end()
        if i < start:
            continue
        while k < len(spans) and spans[k][1] < i:
            k += 1
        if k < len(spans) and spans[k][0] < i:
            # Inside a quotation: only its end may end the sentence too, if it begins with the sentence.
            if end != spans[k][1] or LEADING.sub("", line[start : spans[k][0]]):
                continue
            end = spans[k][1] + 1
            if not line[end : end + 1].isspace():
                continue
        else:
            end = CLOSER.match(line, end).end()
        rest = line[end:]
        if not rest.strip():
            break
        mark, follow = m[0], LEADING.match(rest).end()
        nxt = rest[follow : follow + 1]
        if mark[0] in "。｡।॥！？؟":
            ends = rest[:1] not in "、，,"
        elif mark[0] in "!?":
            ends = rest[0].isspace() and not nxt.islower() or nxt.isupper() and not rest[0].isspace() and rest[0] not in ",;:"
        elif mark != ".":
            ends = rest[0].isspace() and not nxt.islower() and bool(nxt)
        else:
            ends = _period_ends(line, i, rest, nxt, follow, model)
        if ends:
            units.append(line[start:end].strip())
            start = end
    units.append(line[start:].strip())
    return [u for u in units if u]


WORD_BEFORE = re.compile(r"\S*$")
WORD_AFTER = re.compile(r"[^\W\d_]+")


def _period_ends(line: str, i: int, rest: str, nxt: str, follow: int, model: dict[str, set[str]]) -> bool:
    """Whether the single period at ``i`` ends a sentence."""
    token = WORD_BEFORE.search(line, max(0, i - 60), i)[0]
    if not rest[0].isspace():
        # A lost space: a whole word before, an upper-case or caseless letter after.
        before = line[max(0, i - 3) : i]
        if not nxt or rest[0] in ",;:.-/'’" or "www" in token.lower() or "@" in token:
            return False
        if nxt.isupper():
            return before.isalpha() and len(before) == 3 and not before.isupper() or before[-2:].isdigit() and follow == 0 or before[-1:] in "%»)"
        return nxt.isalpha() and not nxt.islower() and len(before) == 3 and before.isalpha() and not before.isascii() and not before[-1].islower()
    if not nxt or nxt.islower():
        return not nxt
    t = word_type(token, line[max(0, i - len(token) - 4) : i - len(token)])
    word = WORD_AFTER.match(rest, follow)
    word = word[0] if word else ""
    if t == "0":
        return word not in model["number"]
    if t in model["end"]:
        return not nxt.isdigit()
    if t in model["title"] or model["never"]:
        return False
    if t in model["abbr"]:
        return not nxt.isdigit() and word in model["start"] and t in model["goes"]
    bare = t.rpartition(" ")[2]
    return not (len(bare) == 1 and bare.isalpha())


KINDS = ("abbr", "goes", "title", "end", "number", "start", "never")


def units(articles: DataFrame, model: DataFrame) -> DataFrame:
    """(id, line_no, sentence) of every non-blank line of (id, lang, content)."""
    rows = model.limit(MAX_MODEL + 1).collect()
    if len(rows) > MAX_MODEL:
        raise ValueError(f"more than {MAX_MODEL} significant types: raise SIGNIFICANT or MAX_MODEL")
    shipped = articles.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict[str, dict[str, set[str]]] = defaultdict(lambda: {k: set() for k in KINDS})
        for lang, kind, t in shipped.value:
            models[lang][kind].add(t)
        for pdf in batches:
            ids, numbers, texts = [], [], []
            for key, lang, content in zip(pdf["id"].tolist(), pdf["lang"].tolist(), pdf["content"].tolist()):
                own = models[lang]
                for no, line in enumerate(content.split("\n"), 1):
                    if line and not line.isspace():
                        found = split_line(line, own)
                        ids += [key] * len(found)
                        numbers += [no] * len(found)
                        texts += found
            if texts:
                yield pd.DataFrame({"id": ids, "line_no": numbers, "sentence": texts}).astype({"id": "int64", "line_no": "int32"})

    return articles.mapInPandas(over, "id long, line_no int, sentence string")


def by_language(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, lang, content), one row an article with content; the language is that of the site's locale, ``und`` without one."""
    rows = one_row_each(articles.where(F.col("content").isNotNull()), "id").select("id", "source_id", "source_domain", "content")
    langs = sources.select(F.col("id").cast("string").alias("site"), F.coalesce(F.lower(F.substring("locale", 1, 2)), F.lit("und")).alias("lang"))
    return with_site(rows, sources).join(langs, "site", "left").select("id", F.coalesce("lang", F.lit("und")).alias("lang"), "content")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, line_no, sentence): the sentence units of every non-blank content line."""
    rows = by_language(load(spark, sf_dir, "articles"), load(spark, sf_dir, "sources"))
    return units(rows, staged(learn(rows), "sentence-model"))
