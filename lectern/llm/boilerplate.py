"""The story of a page without the furniture of its site.

Method: template deduction by equivalence classes over the pages of one site. Tokens of a page are parts of its lines,
told apart by their role (the kind of line, whether a sentence mark closes it): whole lines, their front and back
halves, the first one and two words of a line that stays open, and the end of such a line. Tokens of a site that stand on
exactly the same pages form an equivalence class. A class is template if it has ``MIN_TOKENS`` tokens or more, among them
one that begins a line and one that ends it, and is on a large enough part of the site's pages; a frequent token
without such company is not (an opening that many stories share has no end of its own). Classes nest: one
that is followed by list items wherever it stands owns the list after it. What no template class covers is the slots'
content: the story.

* A class with a whole line (white space apart, which pages lose at times) on ``MIN_SHARE`` of the pages is a fixed line.
* A class of a first word and an open end on ``SLOT_SHARE`` of the pages is a line with a slot between them (bylines,
  credits, tags, links); the story's own paragraphs end with a sentence mark.
* List items directly after a class that owns lists are furniture (links to other stories).

Null and empty contents give no lines. Rows of one id count once. A page's blank lines are never furniture.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.lines import BLANKS, CLOSED, LIST_ITEM, POINTER, once, one_row_each, with_site
from lectern.runtime import load, staged

MIN_PAGES = 3
MIN_SHARE = 0.2
SLOT_SHARE = 0.05
#: The part of a line's pages on which list items must follow it.
OWNS_LISTS = 0.7
#: The part of an opening's pages, against those where its line stays open, on which a mark in the slot may close it.
CLOSED_SHARE = 0.5
#: Tokens that a class needs.
MIN_TOKENS = 2
#: What the template of a site consists of: whole lines, first words of lines with a slot, first two words of lines that a slot may close, owners of lists.
PARTS = ("whole", "openings", "loose", "owners")
#: A word with the marks that belong to it, or one other sign.
WORD = "(?:(?:\\w|[\u0300-\u036f\u064b-\u065f\u0900-\u0903\u093a-\u094f])+|[^\\w\\s])"
OPENING = re.compile(f"({WORD})(?:\\s*{WORD})?")
MARKED = re.compile("[#]+\\s|>")
LISTED, POINTS, ENDED, NUMBERS = re.compile(LIST_ITEM), re.compile(POINTER), re.compile(CLOSED), re.compile(r"\d+")
#: Digits as bytes, and the bytes that digits of other scripts begin with in UTF-8.
DIGITS, DIGITAL = b"0123456789", b"\xd9\xdb\xdf\xe0\xe1\xea\xef\xf0"
KINDS = ("p", "l", "n", "m")
LINES = "array<struct<no:int,h:long,front:int,back:int,first:int,two:int,kind:string,open:boolean,fresh:int>>"


def squeezed(line: str) -> str:
    """A line in lower case without white space and digits, for lines that lose or gain some of these."""
    like = "".join(line.split()).lower()
    raw = like.encode("utf-8", "surrogatepass")
    bare = raw.translate(None, DIGITS)
    if len(bare.translate(None, DIGITAL)) < len(bare):
        return NUMBERS.sub("", like)
    return like if len(bare) == len(raw) else bare.decode("utf-8", "surrogatepass")


def line_kind(line: str) -> int:
    """The place in ``KINDS`` of p plain, l list item, n pointer to elsewhere, m heading or quotation."""
    if line[0].isalpha():
        return 0
    return 1 if LISTED.match(line) else 3 if MARKED.match(line) else 2 if POINTS.match(line) else 0


def _word_hash(word: str, sort: int, words: dict[tuple[str, int], int]) -> int:
    found = words.get((word, sort))
    if found is None:
        if len(words) >= KEPT:
            words.clear()
        found = words[word, sort] = xxhash.xxh32_intdigest(squeezed(word), sort)
    return found


def line_role(line: str, words: dict[tuple[str, int], int]) -> tuple[tuple, tuple]:
    """(role, tokens) of a line; ``words`` keeps the hashes of first words. The role is (h, front, back, first, two, kind, open): hashes of the line, its halves and its first one and two words, its kind, and whether it stays open. A pointer counts as open."""
    sort = line_kind(line)
    if sort == 1:
        return (0, 0, 0, 0, 0, 1, False), ()  # list items are no tokens
    like = squeezed(line)
    half = (len(like) + 1) // 2
    whole, front, back = xxhash.xxh3_64_intdigest(like), xxhash.xxh32_intdigest(like[:half]), xxhash.xxh32_intdigest(like[half:])
    begun = OPENING.match(line[:80]) if sort != 3 else None
    first, two = (_word_hash(begun[1], sort, words), _word_hash(begun[0], sort, words)) if begun else (0, 0)
    is_open = sort == 2 or sort == 0 and not ENDED.search(line[-12:])
    tokens = ((1, whole), (8, front), (16, back), (2, first, is_open), (4, two, is_open))
    return (whole, front, back, first, two, sort, is_open), tokens[:3] if sort == 3 else tokens


#: Lines of up to so many characters whose roles are kept for the next page, and how many of them (and of their first words).
SHORT, KEPT = 120, 100_000


def line_roles(contents: list[str | None], known: dict[str, tuple], words: dict[tuple[str, int], int]) -> pa.ListArray:
    """The non-blank lines of each content with their numbers, roles and what is fresh in them.

    ``fresh`` has a bit for each token that no line before has on the page: 1 the line, 2 its first word and 4 its first two words (open and
    closed lines apart), 8 its front half, 16 its back half, 32 the line as one that list items follow.
    """
    numbers, roles, fresh, ends = [], [], [], [0]
    for content in contents:
        seen: set[tuple] = set()
        for k, line in enumerate((content or "").split("\n"), 1):
            line = line.strip(BLANKS)
            if not line:
                continue
            role = known.get(line)
            if role is None:
                role = line_role(line, words)
                if len(line) <= SHORT:
                    if len(known) >= KEPT:
                        known.clear()
                    known[line] = role
            role, tokens = role
            if not tokens and len(fresh) > ends[-1] and roles[-1][5] != 1 and (32, roles[-1][0]) not in seen:
                seen.add((32, roles[-1][0]))
                fresh[-1] |= 32
            bits = 0
            for t in tokens:
                if t not in seen:
                    seen.add(t)
                    bits |= t[0]
            fresh.append(bits)
            numbers.append(k)
            roles.append(role)
        ends.append(len(numbers))
    h, *short, kind, opened = zip(*roles) if roles else ((),) * 7
    kinds = pa.DictionaryArray.from_arrays(pa.array(kind, pa.int8()), pa.array(KINDS)).cast(pa.string())
    fields = {"no": pa.array(numbers, pa.int32()), "h": pa.array(np.array(h, dtype=np.uint64).view(np.int64))}
    fields |= {c: pa.array(np.array(x, dtype=np.uint32).view(np.int32)) for c, x in zip(("front", "back", "first", "two"), short)}
    fields |= {"kind": kinds, "open": pa.array(opened, pa.bool_()), "fresh": pa.array(fresh, pa.int32())}
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def pages(articles: DataFrame, sources: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, site, told, *keep, lines) with the roles of the lines; ``told`` if there is a content, which may be kept too."""
    others = tuple(c for c in keep if c != "content")
    sited = with_site(articles.where(F.col("id").isNotNull()).select("id", "source_id", "source_domain", "content", *others), sources)
    rows = sited.select(F.col("id").cast("long"), "site", F.col("content").isNotNull().alias("told"), *(F.col(c).cast("string") for c in (*others, "content")))
    kept = ["id", "site", "told", *keep]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        words: dict[tuple[str, int], int] = {}
        for batch in batches:
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in kept}, "lines": line_roles(batch.column("content").to_pylist(), known, words)})

    return rows.mapInArrow(over, f"id long, site string, told boolean{''.join(f', {c} string' for c in keep)}, lines {LINES}")


def _tokens(of: DataFrame, *kinds: tuple[str, int | Column, Column, Column]) -> DataFrame:
    """(site, page, level, token, note, front, back): a row for each fresh token of a page; ``kinds`` are (level, bit, token, note)."""
    lines = of.select("site", (F.xxhash64("id") % F.lit(1 << 40)).alias("page"), F.explode("lines").alias("l")).where(F.col("l.fresh") > 0).select("site", "page", "l.*")
    made = [F.when(F.col("fresh").bitwiseAND(bit if isinstance(bit, Column) else F.lit(bit)) != 0, F.struct(F.lit(level).alias("level"), token.cast("long").alias("token"), note.alias("note"))) for level, bit, token, note in kinds]
    return lines.select("site", "page", "front", "back", F.explode(F.array(*made)).alias("t")).where(F.col("t").isNotNull()).select("site", "page", "t.*", "front", "back")


def _counted(tokens: DataFrame) -> DataFrame:
    """(site, level, token, pages, vector, notes, front, back): the tokens of each site; equal sets of pages have equal vectors.

    A note says of a whole line that a list follows it, of a first word that its line is closed; it leaves the token's pages as they are.
    """
    shown = ~F.col("note")
    return tokens.groupBy("site", "level", "token").agg(
        F.count_if(shown).alias("pages"), F.sum(F.when(shown, F.col("page"))).alias("vector"), F.count_if(~shown).alias("notes"), F.max("front").alias("front"), F.max("back").alias("back")
    )


def template(of: DataFrame) -> DataFrame:
    """(site, whole, openings, loose, owners): one row a site with the hashes of its template's lines, first words and owners of lists.

    Each array is bounded by the lines of an average page over the shares above, whatever the site's size.
    """
    sizes = of.groupBy("site").agg(F.count(F.lit(1)).alias("size"))
    no, yes, closed = F.lit(False), F.lit(True), ~F.col("open")
    share = F.when(F.col("level") == "whole", MIN_SHARE).otherwise(SLOT_SHARE)
    first = _tokens(of, ("whole", 1, F.col("h"), no), ("whole", 32, F.col("h"), yes), ("first", 2, F.col("first"), closed), ("two", 4, F.col("two"), closed))
    often = staged(_counted(first).where(F.col("pages") >= MIN_PAGES).join(sizes, "site").where(F.col("pages") >= share * F.col("size")).drop("size"), "frequent-tokens")
    # The other tokens are counted only where they may join a class of these: halves of frequent lines, ends of lines with frequent first words.
    asked = lambda level, token, of_level: often.where(F.col("level").isin(*of_level)).select("site", F.lit(level).alias("level"), F.col(token).cast("long").alias("token"))
    keys = asked("front", "front", ["whole"]).unionByName(asked("back", "back", ["whole"])).unionByName(asked("end", "token", ["first"])).unionByName(asked("end2", "token", ["two"])).distinct()
    ends = lambda bit: F.when(F.col("open"), F.lit(bit)).otherwise(F.lit(0))
    others = _tokens(of, ("front", 8, F.col("front"), no), ("back", 16, F.col("back"), no), ("end", ends(2), F.col("first"), no), ("end2", ends(4), F.col("two"), no))
    company = _counted(others.join(keys, ["site", "level", "token"]))
    level = lambda *names: F.col("level").isin(*names)
    begins, closes = F.max(level("whole", "front", "first", "two")), F.max(level("whole", "back", "end", "end2"))
    of_class = lambda c: F.collect_set(F.when(c, F.col("token")))
    classes = often.unionByName(company).groupBy("site", "vector", "pages").agg(
        F.count(F.lit(1)).alias("tokens"), begins.alias("begins"), closes.alias("closes"), of_class(level("whole")).alias("whole"), of_class(level("first")).alias("openings"),
        of_class(level("two") & (F.col("notes") <= F.lit(CLOSED_SHARE) * F.col("pages"))).alias("loose"), of_class(level("whole") & (F.col("notes") >= F.lit(OWNS_LISTS) * F.col("pages"))).alias("owners"),
    )
    valid = classes.where((F.col("tokens") >= MIN_TOKENS) & F.col("begins") & F.col("closes"))
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return valid.groupBy("site").agg(*map(flat, PARTS))


def _codes() -> Column:
    """One letter a line: F template, H template that owns a list, l list item, b story."""
    empty = F.array().cast("array<long>")
    has = lambda name, h: F.array_contains(F.coalesce(F.col(name), empty), h)

    def code(l: Column) -> Column:
        fixed = (l["kind"] != "l") & has("whole", l["h"])
        first = l["first"].cast("long")
        slot = l["open"] & has("openings", first) | (l["kind"] == "p") & has("loose", l["two"].cast("long"))
        return F.when(fixed & has("owners", l["h"]), "H").when(l["kind"] == "l", "l").when(fixed | slot, "F").otherwise("b")

    return F.array_join(F.transform("lines", code), "")


def furniture_codes(of: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds ``codes`` to rows with site and lines: the letter of each line, F H L for furniture and l b for the story."""
    owned = F.regexp_replace(_codes(), r"(?:(?<=H)|\G(?<!^))l", "L")
    return of.join(tokens, "site", "left").withColumn("codes", owned).drop(*PARTS)


def is_story(codes: Column, i: Column) -> Column:
    return F.substring(codes, i + 1, 1).isin("l", "b")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, line_no) of the content lines that are furniture."""
    of = staged(pages(one_row_each(load(spark, sf_dir, "articles"), "id"), load(spark, sf_dir, "sources")), "page-roles")
    marked = furniture_codes(of, staged(template(of), "site-templates"))
    gone = once(F.col("codes"), lambda codes: F.filter("lines", lambda l, i: ~is_story(codes, i)))
    return marked.select("id", F.explode(F.transform(gone, lambda l: l["no"])).alias("line_no"))


def marked_pages(articles: DataFrame, sources: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, content, codes) of each article with content. Texts stay in their rows: only the site templates travel to them. Repeated rows are not merged here."""
    of = staged(pages(articles, sources, (*keep, "content")), "page-lines")
    tokens = staged(template(one_row_each(of.select("id", "site", "lines"), "id")), "site-templates")
    return furniture_codes(of.where("told"), tokens).select("id", *keep, "content", "codes")


def story(content: str, codes: str) -> str:
    """The lines of a content that are no furniture, without surrounding blanks, joined by line feeds."""
    lines = filter(None, (line.strip(BLANKS) for line in content.split("\n")))
    return "\n".join(line for line, code in zip(lines, codes) if code in "lb")


def stories(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, body): the story of each article with content."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = [story(c, k) for c, k in zip(batch.column("content").to_pylist(), batch.column("codes").to_pylist())]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "body": pa.array(body, pa.string())})

    return marked_pages(articles, sources).mapInArrow(over, "id long, body string")


def p5_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, body): every article's story alone; an article without content has none and no row."""
    return stories(load(spark, sf_dir, "articles"), load(spark, sf_dir, "sources")).dropDuplicates(["id"])
