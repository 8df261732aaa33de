"""Variant spellings of one person, organisation or place.

Method: pairs of distinct spellings come from their words: equal ones and typings of one word (by deletion neighbourhoods),
with something else in common where the word is common. They are compared token by token with Jaro-Winkler, a nickname table and rules
for initials and abbreviations. Of what is alike, pairs count that meet: by the consonant codes of each two tokens of three or more letters,
whole and by halves, so one edit leaves a key intact, or of one such token and an initial where there is no second. They are clustered by
connected components. A spelling that fits several different full names (an initial, a lone surname) joins none
of them through that pair, and keeps its other pairs.

Null and blank texts take part in no pair; texts are compared as stored, so spellings that differ only in case,
accents or spaces are variants. A text of any length is one spelling.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.cooccurrence import basket_pairs
from lectern.runtime import load, staged, task_count

#: Similarity from which two tokens are typings of one.
ALIKE = 0.9
#: A token of more spellings is common: how pairs are looked for hangs on it, not which are found.
COMMON = 32
#: Tokens of up to so many letters are looked up by what is left without two of them, longer ones by segments.
WHOLE = 16
#: Hypocoristics by given name, without accents (fixed values).
NICKNAMES = {
    "francisco": "paco pancho fran curro kiko frank", "jose": "pepe chepe pepito joe", "hector": "tito", "patricia": "paty pati patty pat tricia", "domingo": "mingo",
    "nicolas": "nico nick", "gustavo": "tavo gus", "rafael": "rafa rafi", "teresa": "tere teresita", "yolanda": "yoli yola", "maria": "mari mary marita", "lorena": "lore",
    "beatriz": "bea betty", "ana": "ani anita ann anna", "isabel": "isa chabela bel", "carmen": "carmina mencha", "elena": "nena lena ele", "julian": "juli", "luisa": "lula lulu",
    "victor": "vic vito", "oscar": "osqui", "simon": "monchi", "wilfredo": "willy fredo wil", "ursula": "ursi", "xiomara": "xio", "kevin": "kev", "zoila": "zoi", "quintina": "quina tina",
    "jesus": "chucho chuy", "manuel": "manolo manu", "antonio": "tono toni tony", "guadalupe": "lupe", "dolores": "lola", "concepcion": "concha conchita", "rosario": "charo", "enrique": "quique",
    "eduardo": "edu lalo", "alejandro": "alex ale", "fernando": "fer nando", "roberto": "beto rob bob", "alberto": "beto", "ignacio": "nacho", "ramon": "moncho", "guillermo": "memo guille",
    "pedro": "perico", "juan": "juancho", "mercedes": "meche merche", "graciela": "chela", "william": "bill will", "robert": "bob rob", "elizabeth": "liz beth", "margaret": "maggie peggy",
    "michael": "mike", "james": "jim", "thomas": "tom", "richard": "dick rick", "katherine": "kate kathy", "joseph": "joe", "edward": "ted ed", "charles": "charlie chuck",
}
FORMAL = {n: {k for k, v in NICKNAMES.items() if n in v.split()} for v in NICKNAMES.values() for n in v.split()}
#: Words that stand beside a name without being part of it, without accents and dots (fixed values).
TITLES = set("dr dra ing lic sr sra srta sres don dona mr mrs ms miss sir prof profa gov gob sen dip min pres gral cnel cap tte fr mons mun municipio herr frau mme m lord".split()) - {"m"}
SMALL = set("de del la las los el y e p para the of and for da do dos das du des und".split())
LEGAL = set("sa srl sas sl sau ltd inc llc corp co cia gmbh ag plc ltda eirl".split()) - {"cia", "co"}
#: Heads of names of organisations and places, without accents (fixed values).
HEADS = set(
    "banco universidad instituto fundacion asociacion cooperativa compania transportes empresa grupo corporacion ministerio direccion consejo comision sindicato federacion partido tribunal hospital colegio escuela "
    "bank university institute foundation association company council commission ministry party court "
    "puerto monte santa santo san villa ciudad isla cabo rio valle sierra cerro playa lago bahia provincia republica estado nacional agricola electrica tecnica productores salud infancia hermanos".split()
)
QUOTED = re.compile(r"[«“\"„‘'(]\s*([^»”\"“’')]*)\s*[»”\"“’')]")
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
DOTTED = re.compile(r"\b(?:[^\W\d_]\.\s?){2,}(?![^\W_])")
VOWELS = re.compile(r"[aeiouy]+")
#: Spellings of one sound, in order (fixed values).
SOUNDS = [("ch", "1"), ("ll", "y"), ("qu", "k"), ("gu", "g"), ("ph", "f"), ("h", ""), ("v", "b"), ("w", "u"), ("x", "s"), ("z", "s"), ("ce", "se"), ("ci", "si"), ("c", "k"), ("q", "k"), ("ge", "je"), ("gi", "ji"), ("ñ", "n")]


def folded(text: str) -> str:
    """Lower case without accents; digits that stand for letters inside words are read as letters."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return re.sub(r"(?<=[a-z])[01](?=[a-z])|(?<=[a-z])0\b|\b0(?=[a-z]{2})", lambda m: "o" if m[0] == "0" else "l", text)


def sound(token: str) -> str:
    """The consonants of a token as they sound, double ones once, after its first letter's class."""
    for a, b in SOUNDS:
        token = token.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", VOWELS.sub("", token)) or token[:1]


def name_tokens(text: str) -> list[str]:
    """The tokens of a spelling in the order of a full name: without titles, nicknames in quotes, small words and legal forms."""
    bare = QUOTED.sub(lambda m: " " if m.start() or m.end() < len(text.strip()) else m[1], text.strip())
    bare = bare if bare.strip() else text
    shouted = bare.upper() == bare
    head, comma, tail = bare.partition(",")
    if comma and tail.strip() and not _legal(tail):
        rest, _, legal = tail.partition(",")
        bare = f"{rest if not legal or _legal(legal) else tail} {head}"
    # Letters with dots are a legal form unless the spelling begins with them.
    words = TOKEN.findall(DOTTED.sub(lambda m: " " if m.start() and _legal(m[0]) else m[0], bare.replace("&", " y ")))
    out = []
    for n, w in enumerate(words):
        low = folded(w).replace("'", "").replace("’", "")
        together = not shouted and w.isupper() and 2 <= len(w) <= 3 and w.isalpha()
        if low in SMALL and not (w.isupper() and not shouted and (together or len(low) == 1)) or low in LEGAL and not (together and n == 0) or low in TITLES:
            continue
        if together:
            out += list(low)  # initials written together
        else:
            out.append(low)
    while len(out) > 1 and out[0] == "a" and "sr" in folded(text)[:4]:
        out = out[1:]
    return out or [folded(w) for w in words]


def _legal(text: str) -> bool:
    letters = re.sub(r"[\W_]+", "", folded(text))
    return letters in LEGAL or letters in ("",)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    m = len(matched)
    other = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(matched, other)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def edits(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], last[j - 2] + 1)
    return row[-1]


#: The last measurements, since the same tokens meet in many pairs.
MEASURED: dict[tuple[str, str], tuple[int, float]] = {}


def same_token(a: str, b: str) -> bool:
    """Typings of one word: equal, or alike by Jaro-Winkler and few edits for their length."""
    if a == b:
        return True
    if min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > 2:
        return False
    if (a, b) not in MEASURED:
        if len(MEASURED) > 200_000:
            MEASURED.clear()
        MEASURED[a, b] = edits(a, b), jaro_winkler(a, b)
    n, near = MEASURED[a, b]
    return n == 1 and max(len(a), len(b)) >= 4 and near >= 0.85 or n == 2 and max(len(a), len(b)) >= 8 and near >= ALIKE


def short_for(a: str, b: str) -> bool:
    """Whether ``a`` abbreviates ``b``: a beginning, or its first letter and some later ones in order."""
    if len(a) == 1 and b in HEADS:
        return a == b[0]
    if not 2 <= len(a) < len(b) or a[0] != b[0] or len(a) > 6:
        return False
    if b.startswith(a):
        return True
    at = 0
    for c in a:
        at = b.find(c, at) + 1
        if not at:
            return False
    return len(a) <= 4


def given_match(a: str, b: str) -> int:
    """2 for one given name in full (typings, nicknames), 1 if one is the other's initial, else 0."""
    if same_token(a, b) or b in FORMAL.get(a, ()) or a in FORMAL.get(b, ()) or FORMAL.get(a, set()) & FORMAL.get(b, set()):
        return 2
    if min(len(a), len(b)) == 1:
        return int(a[0] == b[0])
    return 2 if (a.startswith(b) or b.startswith(a)) and (min(len(a), len(b)) >= 3 or abs(len(a) - len(b)) == 1) else 0


def kinds(tokens: list[str], person: bool) -> str:
    """Which kinds a spelling may be: o for organisations and places, p for persons. Types of mentions are noisy, so they only add one."""
    if any(t in HEADS for t in tokens):
        return "o"
    if any(2 <= len(t) <= 6 and t not in FORMAL and t not in NICKNAMES and any(short_for(t, h) for h in HEADS) for t in tokens[:2]):
        return "op"
    return "p" if person else "op"


Part = str | None


def persons(a: list[str], b: list[str]) -> tuple[int, Part, Part, Part, Part]:
    """(verdict, given a, given b, last a, last b): 2 for one person, 1 if only an initial speaks for it, 0 for different people.

    The family name is a pair of alike tokens; what stands before are given names, in order, and what stands
    after are further family names. Parts present on both sides must agree. The parts are names in their formal
    form, null where a side has an initial or nothing.
    """
    best = (0, None, None, None, None)
    for x, y in ((a, b), *([(a[1:] + a[:1], b)] if len(a) == 2 else []), *([(a, b[1:] + b[:1])] if len(b) == 2 else [])):
        for i in range(1, len(x)):
            for j in range(1, len(y)):
                if len(x[i]) >= 3 and same_token(x[i], y[j]) and (verdict := _around(x, i, y, j)) > best[0] and _gap(x, i, y, j) < 2 - (typed(x[i], y[j]) > 1):
                    best = (verdict, _heard(x[:1]), _heard(y[:1]), _heard(x[i + 1 :]), _heard(y[j + 1 :]))
    return best


def _heard(tokens: list[str]) -> Part:
    if not tokens or len(tokens[0]) == 1:
        return None
    return min(FORMAL.get(tokens[0], {tokens[0]}))


def one_part(parts: list[str]) -> bool:
    """Whether parts are spellings of one: there is one of them that all others sound like or are typings of."""
    alike = lambda a, b: sound(a)[:2] == sound(b)[:2] or same_token(a, b)
    return any(all(alike(a, b) for b in parts) for a in parts)


def typed(a: str, b: str) -> int:
    """How many edits lie between two tokens that count as the same."""
    return 0 if a == b else MEASURED[a, b][0] if (a, b) in MEASURED else edits(a, b)


def _gap(x: list[str], i: int, y: list[str], j: int) -> int:
    """How many more names in full stand before the family name on one side than on the other."""
    names = lambda tokens: sum(len(t) > 1 for t in tokens)
    return abs(names(x[1:i]) - names(y[1:j])) if min(len(x[1:i]), len(y[1:j])) == 0 else 0


def _around(x: list[str], i: int, y: list[str], j: int) -> int:
    first = given_match(x[0], y[0])
    if not first:
        return 0
    less, more = sorted((x[1:i], y[1:j]), key=len)
    at, skipped, hinted = 0, False, False
    for t in less:  # the given names of the shorter form, in their order among the longer's
        while at < len(more) and not given_match(t, more[at]):
            skipped |= len(more[at]) > 1
            at += 1
        if at == len(more):
            return 0
        hinted |= len(t) > 1 and len(more[at]) == 1
        at += 1
    if hinted and (skipped or any(len(u) > 1 for u in more[at:])):
        return 0  # a name that only an initial stands for, next to another name in full
    late_x, late_y = x[i + 1 :], y[j + 1 :]
    if late_x and late_y and not (same_token(late_x[0], late_y[0]) or min(len(late_x[0]), len(late_y[0])) == 1 and late_x[0][0] == late_y[0][0]):
        return 0
    return first


def bodies(a: list[str], b: list[str], rare: set[str]) -> int:
    """2 for one organisation or place, else 0: every token of the shorter spelling has its own in the longer, and the rarest ones agree."""
    if len(a) > len(b):
        a, b = b, a
    left, hits = list(b), 0
    for t in a:
        found = next((u for u in left if u == t), None) or next((u for u in left if same_token(t, u)), None) or next((u for u in left if u not in rare and short_for(t, u) or t not in rare and short_for(u, t)), None)
        if found is None:
            return 0
        left.remove(found)
        hits += (t in rare) and (found in rare)
    if not hits or len(a) < 2 and len(b) > 1:
        return 0
    return 2 if not any(u in rare for u in left) and len(left) <= 2 else 0


def spellings(records: DataFrame) -> DataFrame:
    """(key, text, person, tokens, rare, core): one row a distinct text with its two rarest tokens and all of three or more letters (all, if there is none); ``person`` by the majority of its types (ties count as person)."""
    rows = records.where(F.col("text").isNotNull() & (F.trim(F.regexp_replace("text", r"(?U)\s", " ")) != ""))
    votes = rows.groupBy("text").agg(F.avg((F.col("type") == "PERSON").cast("int")).alias("share")).select(F.xxhash64("text").alias("key"), "text", (F.coalesce("share", F.lit(0)) >= 0.5).alias("person"))

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(tokens=[name_tokens(t) for t in pdf["text"]])

    split = staged(votes.repartition(task_count(records.sparkSession), "key").mapInPandas(parsed, "key long, text string, person boolean, tokens array<string>"), "spellings")
    # The rarest tokens of a spelling: by the number of distinct spellings that hold them.
    each = split.select("key", F.explode(F.array_distinct(F.filter("tokens", lambda t: (F.length(t) >= 3) & ~t.isin(*sorted(HEADS))))).alias("token"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rare = each.join(counts, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("by"))
    name = lambda r: r["token"]
    return split.join(rare, "key", "left").select("key", "text", "person", "tokens", F.transform(F.slice("by", 1, 2), name).alias("rare"), F.coalesce(F.transform("by", name), F.filter(F.array_distinct("tokens"), lambda t: ~t.isin(*sorted(HEADS)))).alias("core"))


def code_keys(code: str) -> set[str]:
    """A code with its one-deletion neighbours, or the halves of a long one: one edit leaves two codes a common key."""
    if len(code) > 6:
        return {code, f"<{code[:4]}", f">{code[-4:]}"}
    return {code} | ({code[:i] + code[i + 1 :] for i in range(len(code))} if len(code) > 2 else set())


def token_keys(token: str) -> set[str]:
    """The keys of a token's sound; one edit inside "ch" changes two of its consonants, so it is also read as its first letter."""
    return code_keys(sound(token)) | (code_keys(sound(token.replace("ch", "c"))) if "ch" in token else set())


def pair_keys(token: str) -> set[str]:
    """``token_keys`` with those of the letters where the sound is too short for neighbours, so that one edit of any letter leaves a key."""
    letters = {f"^{token}"} | {f"^{token[:i]}{token[i + 1 :]}" for i in range(len(token))} if len(sound(token)) <= 2 else set()
    return token_keys(token) | letters


def initials(tokens: list[str]) -> set[str]:
    """The first letters of tokens and of their formal names, and the second ones, which an edit of the first leaves in place."""
    return {n[0] for t in tokens for n in (t, t[1:], *FORMAL.get(t, ())) if n} or {""}


def meeting(tokens: list[str], person: bool, core: list[str]) -> tuple[dict[str, bool], set[str]]:
    """(blocks, crossed): a spelling's blocks, with whether it is poor in them, and what it shares with spellings that have two tokens in common with it.

    A block is the sound of a token, however common, with neighbours one edit away, and an initial of another token. Nicknames count
    with their formal names. A spelling without a further token in full is ``poor`` in its blocks; ``crossed`` has the sounds of each two tokens.
    """
    full = {t: heard_keys(t) for t in tokens if len(t) >= 3 and t not in HEADS}
    heads = {t for t in full if len(t) <= 6 and t not in FORMAL and t not in NICKNAMES and any(short_for(t, h) for h in HEADS)}
    blocks, crossed = {}, set()
    for kind in kinds(tokens, person):
        # What abbreviates a head says as little about a body as the head itself.
        told = [t for t in full if not (kind == "o" and t in heads)]
        for t in core:
            poor = not any(u != t for u in told)
            first = initials([u for n, u in enumerate(tokens) if n != tokens.index(t)])
            blocks |= {f"{kind}{c}|{i}": poor for c in token_keys(t) for i in first}
            crossed |= {f"{kind}{min(c, d)}|{max(c, d)}" for u in told if u != t for c in full.get(t, ()) for d in full[u]}
    return blocks, crossed


def heard_keys(token: str) -> set[str]:
    """``pair_keys`` of a token and of its formal names."""
    return {k for n in (token, *FORMAL.get(token, ())) for k in pair_keys(n)}


def typing_keys(token: str) -> set[str]:
    """Keys of which two different tokens that are ``same_token`` have one in common: what is left without a letter, or without two
    from six letters on. A long token has five segments of each length within two, at each place within two; two edits leave one of them whole."""
    out = set()
    if 3 <= len(token) <= WHOLE:
        one = {token[:i] + token[i + 1 :] for i in range(len(token))}
        out |= {token} | one | ({u[:i] + u[i + 1 :] for u in one for i in range(len(u))} if len(token) >= 6 else set())
    if len(token) > WHOLE - 2:
        for size in range(len(token) - 2, len(token) + 3):
            cuts = [size * n // 5 for n in range(6)]
            out |= {f"{size}/{n}/{token[at : at + cuts[n + 1] - cuts[n]]}" for n in range(5) for at in range(max(0, cuts[n] - 2), cuts[n] + 3)}
    return out


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def typings(words: DataFrame) -> DataFrame:
    """(t, u, tn, un) with t < u: the pairs of different words (t, token, n) that are typings of one, with how many spellings hold each."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(hashed(k), t) for t, w in zip(pdf["t"].tolist(), pdf["token"].tolist()) for k in typing_keys(w)], columns=["basket", "item"])

    def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[same_token(x, y) for x, y in zip(pdf["x"].tolist(), pdf["y"].tolist())]][["t", "u", "tn", "un"]]

    groups = words.select("t", "token").repartition(task_count(words.sparkSession), "t").mapInPandas(keys, "basket long, item long").groupBy("basket").agg(F.collect_list("item").alias("items")).where(F.size("items") > 1)
    near = basket_pairs(groups.select("basket", F.explode("items").alias("item"), F.size("items").alias("size"))).select(F.col("a").alias("t"), F.col("b").alias("u"))
    side = lambda t, x: words.select(F.col("t").alias(t), F.col("token").alias(x), F.col("n").alias(f"{t}n"))
    return near.join(side("t", "x"), "t").join(side("u", "y"), "u").mapInPandas(same, "t long, u long, tn long, un long")


def like_keys(token: str, hosts: dict[str, list[int]]) -> dict[str, bool]:
    """Keys of which two tokens that are ``given_match`` share one that is true on one side at least, unless they are typings of a word that is not common."""
    start = token[:WHOLE]
    out = {f"d{start[:n]}": False for n in range(2 if len(token) == 3 else 3, len(start))} | {f"i{token[:1]}": len(token) == 1, f"d{start}": True}
    formal = {token, *FORMAL.get(token, ())} if token in FORMAL or token in NICKNAMES else ()
    return out | {f"f{n}": True for n in formal} | {f"h{h}": True for h in hosts.get(token, ())}


def common_keys(tokens: list[str], person: bool, core: list[str], hosts: dict[str, list[int]]) -> dict[str, tuple[bool, bool]]:
    """Keys, (active, near), for the common words of a spelling (``hosts`` by token): of two spellings that can be accepted and meet, and
    have no typings of a rarer word, one key is shared, active on one side at least and near on one side at least.

    A common word alone brings nobody together. Bodies share the sound of a further token; where one spelling is poor, an initial. Of persons the
    word is the family name (``persons``): the first names are like, and if names stand between on both sides, so are the first of the fewer and another.
    """
    kind, out = kinds(tokens, person), {}
    for word, of in hosts.items():
        keys: list[tuple[str, bool, bool]] = []
        # A further token that sounds like the word may be what meets.
        alike = any(heard_keys(t) & heard_keys(word) for t in core if t != word)
        poor = any(meeting(tokens, person, [word])[0].values())
        keys += [(f"|{i}", poor, True) for i in initials([t for n, t in enumerate(tokens) if alike or n != tokens.index(word)])]
        if "o" in kind:
            keys += [(f"o{k}", True, True) for t in tokens if (alike or t != word) and len(t) >= 3 and t not in HEADS for k in heard_keys(t)]
        if "p" in kind and len(tokens) > 1:
            for first, at in [(tokens[0], n) for n, t in enumerate(tokens) if n and t == word] + [(tokens[1], 1)] * (len(tokens) == 2 and tokens[0] == word):
                keys += [(f"g{k}", active, at == 1) for k, active in like_keys(first, hosts).items()]
                keys += [(f"m{k}", active, True) for m in tokens[1:at] for k, active in like_keys(m, hosts).items()]
        for k, active, near in keys:
            for h in of:
                before = out.get(f"{h} {k}", (False, False))
                out[f"{h} {k}"] = (before[0] or active, before[1] or near)
    return out


def met(found: DataFrame) -> DataFrame:
    """(a, b): every pair of spellings that ``verdict`` can accept and ``meeting`` brings together, and few others.

    Both verdicts need two tokens that are typings of one word, so pairs come from the words: those that hold a word or typings of it.
    With words of more than ``COMMON`` spellings something else must agree (``common_keys``); what is judged in the end is the same.
    """
    held = found.select(F.col("key").alias("item"), F.explode("core").alias("token")).withColumn("t", F.xxhash64("token"))
    words = staged(held.groupBy("t", "token").agg(F.count(F.lit(1)).alias("n")), "name-words")
    typed = staged(typings(words), "typings")
    rare = (F.col("tn") <= COMMON) & (F.col("un") <= COMMON)
    links = typed.where(rare).select("t", "u").unionByName(words.where(F.col("n").between(2, COMMON)).select("t", F.col("t").alias("u")))
    side = lambda item, t: held.select(F.col("item").alias(item), F.col("t").alias(t))
    pairs = links.join(side("a", "t"), "t").join(side("b", "u"), "u").where((F.col("a") < F.col("b")) | (F.col("t") != F.col("u")) & (F.col("a") != F.col("b")))
    # Common words: their own spellings and those of their typings, which come to the more frequent of the two.
    more = F.col("tn") >= F.col("un")
    hosts = words.where(F.col("n") > COMMON).select("t", F.col("t").alias("host")).unionByName(typed.where(~rare).select(F.when(more, F.col("u")).otherwise(F.col("t")).alias("t"), F.when(more, F.col("t")).otherwise(F.col("u")).alias("host")))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for item, hosted, person, tokens, core in zip(*(pdf[c].tolist() for c in ("item", "hosted", "person", "tokens", "core"))):
                by: dict[str, list[int]] = {}
                for x in hosted:
                    by.setdefault(x["token"], []).append(x["host"])
                out += [(item, hashed(k), *flags) for k, flags in common_keys(list(tokens), person, list(core), by).items()]
            yield pd.DataFrame(out, columns=["item", "basket", "active", "near"])

    hosted = held.join(hosts, "t").groupBy("item").agg(F.collect_list(F.struct("token", "host")).alias("hosted"))
    hosted = hosted.join(found.select(F.col("key").alias("item"), "person", "tokens", "core"), "item").mapInPandas(keys, "item long, basket long, active boolean, near boolean")
    rows = staged(hosted, "common-names")
    mine, theirs = (rows.select("basket", F.col("item").alias(v), F.col("active").alias(f"{v}_active"), F.col("near").alias(f"{v}_near")) for v in ("a", "b"))
    once = (F.col("a") < F.col("b")) | ~F.col("b_active") & (F.col("a") != F.col("b"))
    crossed = mine.where("a_active").join(theirs, "basket").where(once & (F.col("a_near") | F.col("b_near")))
    both = pairs.select("a", "b").unionByName(crossed.select("a", "b"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fed(accepted: DataFrame, clusters: DataFrame) -> DataFrame:
    """The accepted pairs (poor, item, ...) of the poor spellings whose partners are all of one cluster."""
    known = accepted.join(clusters.withColumnRenamed("v", "item"), "item", "left").withColumn("c", F.coalesce("c", "item"))
    one = known.groupBy("poor").agg(F.min("c").alias("c"), F.max("c").alias("d")).where(F.col("c") == F.col("d"))
    return accepted.join(one.select("poor"), "poor", "left_semi")


def verdict(x: list[str], p: bool, r: list[str] | None, y: list[str], q: bool, s: list[str] | None) -> tuple[Part, Part, Part, Part] | None:
    """The given and last parts of persons' sides, null where a side lacks one, if two spellings are of one person or body; else nothing."""
    k, m = kinds(x, p), kinds(y, q)
    body = "o" in k and "o" in m and (k == "o" or m == "o" or not (p or q))
    if body and bodies(x, y, (set(r if r is not None else x) | set(s if s is not None else y)) - HEADS):
        return (None,) * 4
    if "p" in k and "p" in m:
        found, *parts = persons(x, y)
        if found == 2 or found and (parts[0] or parts[1]):
            return tuple(parts)
    return None


def compared(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(lacks, a, b, ga, gb, la, lb): accepted pairs, with the parts of ``verdict``, that share two tokens, or a block in which both are poor;
    with ``lacks``, those (poor, item) that share a block in which only the first is poor.

    The rule is the same for blocks of any size: what a poor spelling lacks is what the others may differ in, so ``fed`` settles these pairs.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places: dict[int, tuple[dict[str, bool], set[str]]] = {}

        def place(key: int, *of) -> tuple[dict[str, bool], set[str]]:
            if key not in places:
                if len(places) > 20_000:
                    places.clear()
                places[key] = meeting(*of)
            return places[key]

        for pdf in batches:
            out = []
            for a, b, p, q, x, y, r, s, v, w in zip(*(pdf[c].tolist() for c in ("a", "b", "pa", "pb", "ta", "tb", "ra", "rb", "ca", "cb"))):
                x, y = list(x), list(y)
                one, other = verdict(x, p, r, y, q, s), verdict(y, q, s, x, p, r)
                if one is None and other is None:
                    continue
                (m, crossed), (n, also) = place(a, x, p, v), place(b, y, q, w)
                shared = {(m[k], n[k]) for k in m.keys() & n.keys()}
                if one is not None and (crossed & also or (True, True) in shared):
                    out.append((False, a, b, *one))
                if one is not None and (True, False) in shared:
                    out.append((True, a, b, *one))
                if other is not None and (False, True) in shared:
                    out.append((True, b, a, *other))
            if out:
                yield pd.DataFrame(out, columns=["lacks", "a", "b", "ga", "gb", "la", "lb"])

    side = lambda n: found.select(F.col("key").alias(n), F.col("person").alias(f"p{n}"), F.col("tokens").alias(f"t{n}"), F.col("rare").alias(f"r{n}"), F.col("core").alias(f"c{n}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInPandas(judge, "lacks boolean, a long, b long, ga string, gb string, la string, lb string")


def variants(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spellings, clusters): the distinct spellings, and (v, c) of those that have a variant."""
    found = staged(spellings(records), "names")
    judged = staged(compared(met(found), found), "name-pairs")
    accepted = judged.where(~F.col("lacks")).drop("lacks")
    clusters = staged(components(untorn(accepted)), "name-clusters")
    lacks = judged.where("lacks").drop("lacks")
    more = staged(fed(lacks.withColumnsRenamed({"a": "poor", "b": "item"}), clusters).withColumnsRenamed({"poor": "a", "item": "b"}), "fed-names")
    if not more.isEmpty():
        clusters = staged(components(untorn(accepted.unionByName(more))), "name-clusters")
    return found, clusters


def untorn(accepted: DataFrame) -> DataFrame:
    """(a, b) of accepted pairs without those of a partial spelling and several different full names, each of which has the part it lacks."""
    sides = (("a", "ga", "gb"), ("b", "gb", "ga"), ("a", "la", "lb"), ("b", "lb", "la"))
    lacks = lambda own, other: F.col(own).isNull() & F.col(other).isNotNull()
    seen = [accepted.where(lacks(own, other)).select(F.col(v).alias("v"), F.lit(own[0]).alias("part"), F.col(other).alias("heard")) for v, own, other in sides]

    def several(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[not one_part(sorted(h)) for h in pdf["heard"]]][["v", "part"]]

    parts = seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(seen[3]).groupBy("v", "part").agg(F.collect_set("heard").alias("heard"))
    torn = staged(parts.where(F.size("heard") > 1).mapInPandas(several, "v long, part string"), "torn-names")
    kept = accepted
    for v, own, other in sides:
        here = torn.where(F.col("part") == own[0]).select(F.col("v").alias(v), F.lit(True).alias("torn"))
        kept = kept.join(here, v, "left").where(F.col("torn").isNull() | ~lacks(own, other)).drop("torn")
    return kept.select("a", "b")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_a, text_b), smaller first: different stored spellings of one person, organisation or place."""
    found, clusters = variants(load(spark, sf_dir, "extracted_entities"))
    sizes = clusters.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    pairs = basket_pairs(clusters.join(sizes, "c").select(F.col("c").alias("basket"), F.col("v").alias("item"), "size"))
    texts = found.select("key", "text")
    named = pairs.select("a", "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("y")), "b")
    return named.select(F.least("x", "y").alias("text_a"), F.greatest("x", "y").alias("text_b"))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text, cluster_id): every distinct spelling with the key of its cluster; a spelling without variants is its own."""
    found, clusters = variants(load(spark, sf_dir, "extracted_entities"))
    return found.join(clusters.withColumnRenamed("v", "key"), "key", "left").select("text", F.coalesce("c", "key").alias("cluster_id"))
