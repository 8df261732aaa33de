"""Date texts of any site as one unambiguous instant.

A cascade of anchored patterns reads a text: each pattern is strict, the first that matches decides, and what
none matches (relative, incomplete or impossible dates) has no instant. A zone named in the text goes first,
then the site's zone. Policy for local times: one that occurs twice is the earlier instant unless the text
names the offset; one that a change skips is read with the offset valid before it.

Everything is a Column expression of built-in functions, so Catalyst keeps it on the JVM side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Month names by language, full and abbreviated, without final dots (fixed values).
MONTHS = {
    1: "enero ene january jan janvier janv janeiro januar jänner",
    2: "febrero feb february février févr fevereiro fev februar",
    3: "marzo mar march mars março märz mär mrz",
    4: "abril abr april apr avril avr",
    5: "mayo may mai maio",
    6: "junio jun june juin junho juni",
    7: "julio jul july juillet juil julho juli",
    8: "agosto ago august aug août aou",
    9: "septiembre setiembre sep sept set september septembre setembro",
    10: "octubre oct october octobre outubro out oktober okt",
    11: "noviembre nov november novembre novembro",
    12: "diciembre dic december dec décembre déc dezembro dez dezember",
}
#: Abbreviations whose offset is the same wherever they are used, in minutes (fixed values).
FIXED_ZONES = {
    "utc": 0, "gmt": 0, "z": 0, "wet": 0, "west": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "edt": -240, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "nst": -210, "ndt": -150,
    "art": -180, "brt": -180, "brst": -120, "clt": -240, "clst": -180, "cot": -300, "pet": -300, "vet": -240, "bot": -240, "uyt": -180, "pyt": -240,
    "jst": 540, "kst": 540, "hkt": 480, "sgt": 480, "pht": 480, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}
#: Abbreviations that several regions use: by the first part of the site's zone, then elsewhere (fixed values).
LOCAL_ZONES = {
    "est": [("Australia/", 600), ("", -300)],
    "cst": [("Asia/", 480), ("", -360)],
    "ast": [("Asia/", 180), ("", -240)],
    "bst": [("Asia/", 360), ("", 60)],
    "ist": [("Europe/", 60), ("Asia/Jerusalem", 120), ("", 330)],
    "gst": [("Atlantic/", -120), ("", 240)],
    "ect": [("Europe/", 60), ("", -300)],
    "amt": [("Asia/", 240), ("", -240)],
}
#: Generic names: the zone they stand for (fixed values).
NAMED_ZONES = {"et": "America/New_York", "ct": "America/Chicago", "mt": "America/Denver", "pt": "America/Los_Angeles"}

TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
HALF = r"(?: ?([ap])\.? ?m\b\.?)?"
ZONE = r"(?: ?\(?([+-]\d{2}(?::?\d{2})?|z|(?:utc|gmt)(?: ?[+-]\d{1,2}(?::?\d{2})?)?|[a-z]{2,5}|\[?[a-z]+(?:/[a-z_+-]+){1,2}\]?)\)?)?"
WEEKDAY = r"(?:\p{L}+\.?,? )?"
NAME = r"(\p{L}+)\.?"
#: The cascade: pattern and the groups of year, month, day, hour, minute, second, fraction, half, zone (0 for none).
CASCADE = [
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[t ]{TIME}{HALF}{ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    (r"^(\d{4})(\d{2})(\d{2})(?:t(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,9}))?)?" + ZONE + r")?$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}})(?:,? {TIME}{HALF}{ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? {TIME}{HALF}{ZONE})?$", (3, -1, -2, 4, 5, 6, 7, 8, 9)),
    (rf"^(\d{{1,2}})[.-](\d{{1,2}})[.-](\d{{4}})(?:,? {TIME}{HALF}{ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    (r"^(\d{4})年(\d{1,2})月(\d{1,2})日(?: ?(\d{1,2})[時时:](\d{1,2})分?(?:(\d{1,2})秒)?)?$", (1, 2, 3, 4, 5, 6, 0, 0, 0)),
    (rf"^{WEEKDAY}{NAME} (\d{{1,2}})(?:st|nd|rd|th)?, (\d{{4}})(?:(?: \||,| at)? {TIME}{HALF}{ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    (rf"^{WEEKDAY}(\d{{1,2}})\.?(?: de)? {NAME}(?: de| del)? (\d{{4}})(?:(?:,| a las| à| às| um| at)* {TIME}{HALF}(?: ?(?:h|uhr|hrs)\.?)?{ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    (rf"^{WEEKDAY}(\d{{1,2}})\.?(?: de)? {NAME}(?: de)? (\d{{4}})(?:,| a las| à| às)* (\d{{1,2}})h(\d{{2}})?{ZONE}$", (3, 2, 1, 4, 5, 0, 0, 0, 6)),
    (rf"^(\d{{1,2}})-{NAME}-(\d{{4}}|\d{{2}})(?: {TIME}{HALF}{ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
]


def clean(text: Column) -> Column:
    """Lower case, plain spaces and signs, no surrounding blanks."""
    spaced = F.regexp_replace(text, r"(?U)[\s\x{200b}\x{feff}]+", " ")
    return F.lower(F.trim(F.regexp_replace(spaced, "[−–]", "-")))


def _month_of(word: Column) -> Column:
    numbers = _table({name: number for number, words in MONTHS.items() for name in words.split()})
    return F.when(word.rlike(r"^\d+$"), word.try_cast("int")).otherwise(F.try_element_at(numbers, word).try_cast("int"))


def _table(values: dict) -> Column:
    """A constant map of texts, which the optimizer folds into one literal."""
    return F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in values.items())), F.lit(";"), F.lit("="))


def _zone(text: Column, site_zone: Column) -> Column:
    """(offset in minutes, zone name): what the zone text says, read at the site's place; both null if it is unknown."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[\[\]]", ""), r"^(utc|gmt) ?(?=[+-])", "")
    signed = F.regexp_extract(bare, r"^([+-])(\d{1,2}):?(\d{2})?$", 1)
    hours, minutes = (F.regexp_extract(bare, r"^([+-])(\d{1,2}):?(\d{2})?$", k).try_cast("int") for k in (2, 3))
    offset = F.when(signed != "", F.when(signed == "-", -1).otherwise(1) * (hours * 60 + F.coalesce(minutes, F.lit(0))))
    fixed = F.try_element_at(_table(FIXED_ZONES), bare).try_cast("int")
    local = F.lit(None).cast("int")
    for name, rules in LOCAL_ZONES.items():
        chain = F.lit(None).cast("int")
        for place, value in reversed(rules):
            chain = F.when(F.coalesce(site_zone, F.lit("")).startswith(place), value).otherwise(chain)
        local = F.when(bare == name, chain).otherwise(local)
    named = F.coalesce(F.try_element_at(_table(NAMED_ZONES), bare), F.try_element_at(zone_names(), bare))
    return F.struct(F.coalesce(offset, fixed, local).alias("offset"), named.alias("name"))


def zone_names() -> Column:
    """The region zones that the JVM knows, by their lower-case names."""
    jvm = SparkSession.active()._jvm
    names = [n for n in str(jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds())).split(",") if "/" in n or n == "UTC"]
    return _table({n.lower(): n for n in sorted(names)})


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parsed(text: Column, site_zone: Column, month_first: Column) -> Column:
    """The instant of a date text as TIMESTAMP, null if it denotes none.

    Null and blank texts, relative and incomplete dates, impossible days and times, unknown zones, and local
    times without any zone give null. Digits finer than microseconds are cut off.
    """
    digits = r"^(\d{10}|\d{13})$"
    read = lambda t: F.when(t.rlike(digits), _epoch(t)).otherwise(_let(_parts(t, month_first), lambda v: _instant(v, site_zone)))
    return _let(clean(text), read)


def _parts(t: Column, month_first: Column) -> Column:
    """The texts of the parts of a date by the first pattern of the cascade that matches, else null."""
    branches = None
    for pattern, groups in CASCADE:
        part = lambda g, p=pattern: F.lit("") if g == 0 else F.regexp_extract(t, p, g)
        year, month, day, *rest = groups
        if month < 0:
            named = F.when(month_first, part(1)).otherwise(part(2)), F.when(month_first, part(2)).otherwise(part(1))
        else:
            named = part(month), part(day)
        texts = [part(year), *named, *map(part, rest)]
        value = F.struct(*(c.alias(n) for c, n in zip(texts, ("y", "mo", "d", "h", "mi", "s", "f", "half", "zone"))))
        branches = F.when(t.rlike(pattern), value) if branches is None else branches.when(t.rlike(pattern), value)
    return branches


def _epoch(t: Column) -> Column:
    n = t.try_cast("long")
    return F.when(F.length(t) == 13, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))


def _instant(v: Column, site_zone: Column) -> Column:
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    year = F.when(F.length(v["y"]) == 2, v["y"].try_cast("int") + 2000).otherwise(v["y"].try_cast("int"))
    hour = F.when(v["half"] == "", number(v["h"])).when(number(v["h"]).between(1, 12), number(v["h"]) % 12 + F.when(v["half"] == "p", 12).otherwise(0))
    second = F.when(number(v["s"]) < 60, number(v["s"]))
    micros = F.coalesce(F.rpad(F.substring(v["f"], 1, 6), 6, "0").try_cast("int"), F.lit(0))
    # The wall time as if it were UTC: built in UTC by name, so the session's zone has no part in it.
    wall = F.when(year >= 1, F.try_make_timestamp(year, _month_of(v["mo"]), v["d"].try_cast("int"), hour, number(v["mi"]), second.cast("decimal(16,6)"), F.lit("UTC")))
    placed = lambda at, zone: F.when((v["zone"] != "") & zone["offset"].isNotNull(), F.timestamp_micros(F.unix_micros(at) - zone["offset"].cast("long") * F.lit(60_000_000))).otherwise(
        F.to_utc_timestamp(at, F.when(v["zone"] == "", F.try_element_at(zone_names(), F.lower(site_zone))).otherwise(zone["name"]))
    )
    base = _let(wall, lambda at: _let(_zone(v["zone"], site_zone), lambda zone: placed(at, zone)))
    return F.timestamp_micros(F.unix_micros(base) + micros.cast("long"))


def utc_text(instant: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.ffffffZ``, always in UTC whatever the session's zone."""
    micros = F.unix_micros(instant)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / F.lit(86_400_000_000)).cast("int"))
    rest = F.pmod(micros, F.lit(86_400_000_000))
    clock = F.format_string("%02d:%02d:%02d.%06d", (rest / 3_600_000_000).cast("int"), (rest / 60_000_000 % 60).cast("int"), (rest / 1_000_000 % 60).cast("int"), rest % 1_000_000)
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), clock, F.lit("Z"))


def site_zones(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``site_zone`` and ``month_first`` by source_id, else by the domain without case, blanks and ``www.``.

    Sources are joined by key; the optimizer broadcasts them where they are small.
    """
    blanks = F.lit(" \t\r\n\xa0")
    bare = lambda c: F.regexp_replace(F.lower(F.trim(c, blanks)), r"^www\.", "")
    facts = [F.col("timezone").alias("zone"), (F.col("locale") == "en_US").alias("first")]
    by_id = sources.where(F.col("id").isNotNull()).dropDuplicates(["id"]).select(F.col("id").alias("source_id"), *[f.alias(f"i{k}") for k, f in enumerate(facts)])
    by_name = sources.where(F.col("domain").isNotNull()).select(bare(F.col("domain")).alias("bare"), *[f.alias(f"n{k}") for k, f in enumerate(facts)]).dropDuplicates(["bare"])
    joined = articles.withColumn("bare", F.when(F.col("source_id").isNull(), bare(F.col("source_domain")))).join(by_id, "source_id", "left").join(by_name, "bare", "left")
    return joined.withColumn("site_zone", F.coalesce("i0", "n0")).withColumn("month_first", F.coalesce("i1", "n1", F.lit(False))).drop("bare", "i0", "i1", "n0", "n1")
