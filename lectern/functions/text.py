"""Text functions as Column expressions: tokens, shingles, initials, Markdown and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spanish stop words of the name tokenizer (fixed values).
STOPWORDS = (
    "el la los las un una unos unas de del al a en por para con sin y o u e ni que cual cuales quien quienes "
    "este esta estos estas ese esa esos esas aquel aquella aquellos aquellas"
).split()
#: Letters with marks and their plain forms (fixed values).
MARKED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"
#: Separators of a category from its subcategory, in the order they are tried (fixed values).
SEPARATORS = (" > ", " - ", " / ", ">", "-", "/")


def without_accents(x: Column) -> Column:
    return F.translate(x, MARKED, PLAIN)


def normalize_token(x: Column) -> Column:
    """Lower case, no accents, no periods."""
    return F.replace(without_accents(F.lower(x)), F.lit("."), F.lit(""))


def name_words(name: Column) -> Column:
    """The alphanumeric runs of a name; periods stay inside a run, and a run with one inside ends with one."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"([\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*)"), 1), lambda w: F.when(w.contains("."), F.concat(w, F.lit("."))).otherwise(w))


def normalize_name(x: Column) -> Column:
    """The matcher's form: lower case, no accents, words and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(x), "áéíóúñüàèìòù", "aeiounuaeiou"), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def is_plural_initials(x: Column) -> Column:
    """Doubled letters such as EE.UU.: at least two pairs of equal letters."""
    return F.upper(F.regexp_replace(x, r"[\s.]", "")).rlike(r"^(?:(\p{L})\1){2,}$")


def initials_variants(x: Column) -> Column:
    """[doubled, single] lower-case forms of plural initials."""
    flat = F.lower(F.regexp_replace(x, r"[\s.]", ""))
    return F.array(flat, F.regexp_replace(flat, r"(.)\1", "$1"))


def char_ngrams(x: Column, n: int = 2) -> Column:
    """The distinct n-grams of a text that are not blank; shorter texts have none."""
    grams = F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n)))
    return F.when(F.length(x) >= n, F.filter(F.array_distinct(grams), lambda g: F.trim(g) != "")).otherwise(F.array().cast("array<string>"))


def shingles(name: Column, n: int = 2) -> Column:
    """The matcher's shingles: those of the normalised name, or of both variants of plural initials with the variants."""
    v = initials_variants(name)
    special = F.array_distinct(F.concat(v, char_ngrams(F.get(v, F.lit(0)), n), char_ngrams(F.get(v, F.lit(1)), n)))
    return F.when(is_plural_initials(name), special).otherwise(char_ngrams(normalize_name(name), n))


#: White space in classes that Java and RE2 read alike (fixed values).
SPACES = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The rules that take Markdown's marks away and what they leave, in this order (fixed values). Inline code goes before fences, which it damages.
PLAIN_RULES = (
    (rf"(^|\n)#{{1,6}}[{SPACES}]+", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"\*\*([^*]+)\*\*", r"\1"), (r"__([^_]+)__", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"_([^_]+)_", r"\1"),
    (rf"(^|\n)>[{SPACES}]+", r"\1"), (r"`([^`]+)`", r"\1"), (r"```[\s\S]*?```", ""), (r" +", " "), (r"\n{3,}", "\n\n"), (rf"^[{SPACES}]+|[{SPACES}]+$", ""),
)


def plain_text(markdown: Column) -> Column:
    """Markdown without its marks, by ``PLAIN_RULES``; a null is an empty text."""
    x = F.coalesce(markdown, F.lit(""))
    for pattern, left in PLAIN_RULES:
        x = F.regexp_replace(x, pattern.replace("$", r"\z"), left.replace("\\1", "$1"))
    return x


def split_category(x: Column) -> Column:
    """(category, subcategory) at the first separator of the list that the text holds."""
    out = F.struct(F.trim(x).alias("category"), F.lit(None).cast("string").alias("subcategory"))
    for s in reversed(SEPARATORS):
        at = F.instr(x, s)
        out = F.when(at > 0, F.struct(F.trim(F.substring(x, F.lit(1), at - 1)).alias("category"), F.trim(F.substring(x, at + len(s), F.length(x))).alias("subcategory"))).otherwise(out)
    return out


def simple_sentences(markdown: Column) -> Column:
    """The clusterer's sentences: no headings or marks, split after . ! ?, at least five words."""
    x = F.regexp_replace(markdown, r"(?m)^#+\s+.*$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\*\*([^*]+)\*\*", "$1"), r"\*([^*]+)\*", "$1")
    x = F.regexp_replace(x, r"\[([^\]]+)\]\([^)]+\)", "$1")
    x = F.regexp_replace(x, r"(?m)^[ \t]*[-*+][ \t]+", "")
    units = F.transform(F.split(x, r"(?<=[.!?])\s+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(units, lambda s: (s != "") & (F.size(F.split(s, " ")) >= 5))


def ensure_period(x: Column) -> Column:
    """Appends a period unless the text ends with a closing mark."""
    return F.when(x.rlike("[.!?…:;)\\]\"'»]$") | (x == ""), x).otherwise(F.concat(x, F.lit(".")))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)


def size_text(n: Column) -> Column:
    """A number of bytes as B, KB or MB."""
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / (1024.0 * 1024.0)))


#: Words that the benchmark's form of a name leaves out (fixed values).
BENCH_STOPWORDS = ("el", "la", "los", "las", "de", "del", "y", "e", "en", "con", "por", "para")


def bench_normalized(name: Column) -> Column:
    """A name in the benchmark's form: lower case, no accents, no small words, and only then no punctuation."""
    plain = F.translate(F.lower(name), "áéíóúñüàèìòùâêîôûãõç", "aeiounuaeiouaeiouaoc")
    words = F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin(*BENCH_STOPWORDS))
    return F.trim(F.regexp_replace(F.array_join(words, " "), r"[^\p{L}\p{M}\p{N}_\s]", ""))


def bench_ngrams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text between two marks on either side."""
    padded = F.concat(F.lit("$$"), text, F.lit("$$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n))))


def bench_word_ngrams(text: Column) -> Column:
    """The distinct pairs of neighbouring words and the words themselves; a text of one word or none alone."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    return F.when(F.size(words) < 2, F.array(text)).otherwise(F.array_distinct(F.concat(pairs, words)))


def annotated(content: Column, sentences: Column, categories: Column) -> Column:
    """(text, notes): a content with its core sentences marked strong and its fillers as footnotes, numbered from the end; secondary ones stay.

    ``categories`` has core, secondary or filler by sentence; what it lacks is filler. A sentence that the content does not hold
    still takes its number. ``notes`` are (number, sentence) in the order of the text. Null if any part is null or empty.
    """
    pairs = F.reverse(F.transform(sentences, lambda x, i: F.struct(x.alias("s"), F.coalesce(F.get(categories, i), F.lit("filler")).alias("c"))))
    none = F.array().cast("array<struct<number:int,sentence:string>>")
    start = F.struct(content.alias("text"), F.lit(1).alias("next"), none.alias("notes"))

    def step(acc: Column, x: Column) -> Column:
        filler, at = ~x["c"].isin("core", "secondary"), F.instr(acc["text"], x["s"])
        new = F.when(x["c"] == "core", F.concat(F.lit("<strong>"), x["s"], F.lit("</strong>"))).otherwise(F.concat(F.lit("[^"), acc["next"].cast("string"), F.lit("]")))
        changed = F.concat(F.substring(acc["text"], F.lit(1), at - 1), new, F.substring(acc["text"], at + F.length(x["s"]), F.length(acc["text"])))
        note = F.array(F.struct(acc["next"].alias("number"), x["s"].alias("sentence")))
        return F.struct(
            F.when((at > 0) & (x["c"] != "secondary"), changed).otherwise(acc["text"]).alias("text"), (acc["next"] + filler.cast("int")).alias("next"), F.when(filler, F.concat(note, acc["notes"])).otherwise(acc["notes"]).alias("notes")
        )

    done = F.aggregate(pairs, start, step)
    return F.when((content != "") & (F.size(sentences) > 0) & (F.size(categories) > 0), F.struct(done["text"].alias("text"), done["notes"].alias("notes")))
