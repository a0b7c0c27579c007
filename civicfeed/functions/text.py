"""Text columns: normal forms, address and house keys, clean bodies, ids. All are built-in SQL expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The forms that users write, the words of addresses and of messages.
STREET_TYPES = ["улица", "проспект", "проезд", "переулок", "шоссе", "бульвар", "набережная", "площадь", "аллея", "тупик", "квартал", "микрорайон", "линия"]
ADDRESS_ALIASES = [("ул", "улица"), ("пр-т", "проспект"), ("просп", "проспект"), ("пр-д", "проезд"), ("пер", "переулок"), ("ш", "шоссе"), ("б-р", "бульвар"), ("наб", "набережная"), ("пл", "площадь")]
HOUSE_WORDS = [("д|дом", "дом"), ("к|корп|корпус", "корпус"), ("с|стр|строение", "строение")]
STREET_PREFIX = r"(?iu)^(ул\.?|улица|пр-?т\.?|проспект|пер\.?|переулок|б-?р\.?|бульвар|ш\.?|шоссе)\s+"
HOUSE_PART = r"(?iU)^(?:д\.?|дом)\s*(.+)$"
HOUSE_INLINE = r"(?iU)\b(?:д\.?|дом)\s+([0-9]+[а-яА-Яa-zA-Z]?(?:\s*[кк]\s*[0-9]+[а-яА-Я]?)?(?:\s*[сc]\s*[0-9]+[а-яА-Я]?)?)\s*$"
STEM_ENDINGS = ["ого", "ему", "ому", "ыми", "ими", "ых", "их", "ая", "яя", "ое", "ее", "ые", "ие", "ой", "ый", "ий", "ом", "ем", "ую", "юю", "ам", "ям", "ах", "ях"]
BOILERPLATE_ONLY = r"(?isu)^\s*(?:подробнее(?:\s+на\s+сайте)?|читать\s+далее|читайте\s+(?:также|далее)|материал\s+предоставлен|подписывайтесь|источник\s*:?\s*)\s*[.!]?\s*$"
BOILERPLATE_SUFFIX = r"(?isu)\s*(?:подробнее(?:\s+на\s+сайте)?|читать\s+далее|читайте\s+(?:также|далее))\s*[.!]?\s*$"
BULLET = r"^\s*(?:[-*•–—]|\d+[.)])\s*(.+?)\s*$"
POSTCODE = r"(?U)(?<!\w)[0-9]{6}(?!\w)"
HOUSE_IN_TEXT = r"(?iu)(?:д\.?|дом)\s*([0-9]+[а-яА-Яa-zA-Z]?(?:\s*[кс]\s*[0-9]+[а-яА-Яa-zA-Z]?)?)"
GREETINGS = ["привет", "здравствуйте", "здарова", "добрый день", "добрый вечер", "доброе утро", "привет всем", "всем привет", "ку", "хай", "+", "ок", "окей", "ладно"]
UPDATE_HINTS = [r"устран", r"восстанов", r"завершен", r"завершён", r"подали\s+воду", r"включили", r"локализован", r"продлен", r"продлён", r"перенес", r"обновлен", r"обновлён", r"актуализац", r"ликвидир"]
BOILERPLATE_LENGTH, BODY_LENGTH = 48, 20
TITLE_LIMIT, BODY_LIMIT = 120, 4000


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapse_ws(c: Column) -> Column:
    """Runs of Unicode white space to one space, none at the ends (K1)."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column) -> Column:
    """Lower case, ё as е, white space collapsed (K2)."""
    return collapse_ws(F.translate(F.lower(c), "ё", "е"))


def normalize_component(c: Column) -> Column:
    """K2 with null for an empty result (K3)."""
    return blank_to_null(normalize_text(c))


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def compatible(c: Column) -> Column:
    """The NFKC form. Only texts with characters outside those that are their own form go to Python."""
    return F.when(c.rlike(r"[^\x00-\x7F\xAB\xBB\u0401\u0410-\u044F\u0451\u2013\u2014]"), _composed(c)).otherwise(c)


def ui_text(c: Column) -> Column:
    """K2 of the NFKC form without zero-width and bidirectional marks; null as the empty text (K4)."""
    c = compatible(c)
    return normalize_text(F.coalesce(F.regexp_replace(c, "[​-‏‪-‮⁠﻿]", ""), F.lit("")))


def address_text(c: Column) -> Column:
    """Abbreviations spelled out, house words in full, punctuation gone but for the slash (K6)."""
    out = F.translate(F.lower(c), "ё", "е")
    for short, full in ADDRESS_ALIASES:
        out = F.regexp_replace(out, rf"(?U)\b{short}\b\.?", full + " ")
    for short, full in HOUSE_WORDS:
        out = F.regexp_replace(out, rf"(?U)\b(?:{short})\.?\s*(?=[0-9])", full + " ")
    return collapse_ws(F.regexp_replace(out, r"(?U)[^\w/]+", " "))


def search_text(c: Column) -> Column:
    """A search key: secondary house numbers written one way, then K6 and only letters and digits (K5)."""
    out = ui_text(c)
    out = F.regexp_replace(out, r"(?<=\d)\s*/\s*(?=\d)", " корпус ")
    out = F.regexp_replace(out, r"(?<=\d)к(?:орп(?:ус)?)?\.?\s*(?=\d)", " корпус ")
    out = F.regexp_replace(out, r"(?<=\d)с(?:тр(?:оение)?)?\.?\s*(?=\d)", " строение ")
    return collapse_ws(F.regexp_replace(address_text(out), r"[^0-9a-zа-я]+", " "))


def street_name(c: Column) -> Column:
    """A street without its type in front; null for nothing left (K7)."""
    return blank_to_null(F.trim(F.regexp_replace(normalize_text(c), STREET_PREFIX, "")))


def streets_match(a: Column, b: Column) -> Column:
    """Whether two streets are the same by K7; false if either is missing (K8)."""
    return F.coalesce(street_name(a) == street_name(b), F.lit(False))


def house(c: Column) -> Column:
    """A house number without spaces, with к and с for its parts (K9)."""
    out = F.regexp_replace(F.translate(F.lower(c), "ё", "е"), r"(?U)\s+", "")
    for long, short in (("корпус", "к"), ("корп", "к"), ("строение", "с"), ("стр", "с")):
        out = F.replace(out, F.lit(long), F.lit(short))
    return blank_to_null(out)


def house_search(c: Column) -> Column:
    """K9 with one mark for all kinds of parts."""
    return F.regexp_replace(house(c), r"(?<=\d)[кс/](?=\d)", "/")


def house_keys(c: Column) -> Column:
    """Lookup keys of a house, most exact first: itself, its number with letter, and what precedes its part."""
    h = house(c)
    base = blank_to_null(F.regexp_extract(h, r"(?i)^(\d+[а-яa-z]?)", 1))
    bare = blank_to_null(F.regexp_replace(h, r"[кс].*$", ""))
    return F.when(h.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(h, base, bare))))


def stem(c: Column) -> Column:
    """The word without the first listed ending that leaves four letters."""
    w = F.translate(F.lower(c), "ё", "е")
    out = F.when(F.length(w) < 5, w)
    for end in STEM_ENDINGS:
        out = out.when(F.endswith(w, F.lit(end)) & (F.length(w) - len(end) >= 4), F.left(w, F.length(w) - len(end)))
    return out.otherwise(w)


def alias_keys(c: Column) -> Column:
    """All keys under which a street is found: whole, without type, without ordinal, stemmed, and long words alone."""
    full = address_text(c)
    tokens = F.split(full, " ")
    bare = F.filter(tokens, lambda t: ~t.isin(STREET_TYPES))
    named = F.filter(bare, lambda t: ~t.rlike(r"(?iu)^\d+-?[йяе]$"))
    words = F.filter(named, lambda t: (F.length(t) >= 4) & ~t.rlike(r"^\d+$"))
    whole = F.array(full, F.array_join(bare, " "), F.array_join(named, " "), F.array_join(F.transform(bare, stem), " "), F.array_join(F.transform(named, stem), " "))
    keys = F.array_union(whole, F.array_union(words, F.transform(words, stem)))
    return F.array_sort(F.filter(keys, lambda k: k.isNotNull() & (k != "")))


def parse_address(c: Column) -> Column:
    """"city, [districts,] street, д. N" to its parts.

    After the city, a part that starts with the word for a house is the house, the last other one the street, those
    before it the district. A street's end may repeat the house, or name it if nothing else does.
    """
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    number = F.regexp_extract(F.try_element_at(F.filter(rest, lambda p: p.rlike(HOUSE_PART)), F.lit(-1)), HOUSE_PART, 1)
    names = F.filter(rest, lambda p: ~p.rlike(HOUSE_PART))
    last = F.try_element_at(names, F.lit(-1))
    inline = blank_to_null(F.trim(F.regexp_extract(last, HOUSE_INLINE, 1)))
    bare = F.when(inline.isNotNull(), F.btrim(F.regexp_replace(last, HOUSE_INLINE, ""), F.lit(" ,"))).otherwise(last)
    return F.struct(
        F.try_element_at(parts, F.lit(1)).alias("city"),
        F.when(F.size(names) > 1, F.array_join(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), ", ")).alias("district"),
        blank_to_null(F.when(number.isNotNull(), street_without_house(last, number)).otherwise(bare)).alias("street"),
        F.coalesce(blank_to_null(F.trim(number)), inline).alias("house"),
    )


def build_address(city: Column, district: Column, street: Column, number: Column) -> Column:
    """The address text of its parts, missing ones left out."""
    return F.concat_ws(", ", city, district, street, F.concat(F.lit("д. "), number))


def title_and_body(raw: Column, title: Column, body: Column) -> Column:
    """The given title and body, else the first line and the rest; a body equal to its title stays once."""
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    own_title = blank_to_null(F.trim(title))
    own_body = blank_to_null(F.trim(body))
    first = F.try_element_at(lines, F.lit(1))
    rest = blank_to_null(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n"))
    b = F.coalesce(own_body, F.when(own_title.isNotNull(), blank_to_null(F.array_join(lines, "\n"))).otherwise(F.coalesce(rest, first)), F.lit(""))
    t = F.coalesce(own_title, F.when(own_body.isNull() & rest.isNotNull(), first))
    t = F.when(F.lower(t) == F.lower(b), F.lit(None)).otherwise(t)
    return F.struct(F.left(t, F.lit(TITLE_LIMIT)).alias("title"), F.left(b, F.lit(BODY_LIMIT)).alias("body"))


def is_boilerplate(c: Column) -> Column:
    """Whether a body says nothing but where to read on."""
    text = collapse_ws(F.coalesce(c, F.lit("")))
    low = F.lower(text)
    hint = low.contains("подробнее") | low.contains("читать далее") | low.contains("читайте")
    return (text == "") | text.rlike(BOILERPLATE_ONLY) | ((F.length(text) < BOILERPLATE_LENGTH) & hint)


def clean_body(body: Column, title: Column) -> Column:
    """A body without boilerplate at its end and without its title in front; null if little is left."""
    text = F.btrim(F.regexp_replace(collapse_ws(body), BOILERPLATE_SUFFIX, ""), F.lit(" .-—–"))
    head = collapse_ws(F.coalesce(title, F.lit("")))
    led = (head != "") & F.startswith(F.lower(text), F.lower(head))
    rest = F.ltrim(F.substr(text, F.length(head) + 1), F.lit(" .:—–-"))
    out = F.when((text == "") | is_boilerplate(text), F.lit(None).cast("string"))
    out = out.when(led & ((rest == "") | is_boilerplate(rest)), F.lit(None).cast("string")).when(led, rest).otherwise(text)
    return F.when(F.length(out) >= BODY_LENGTH, out)


def outlet(msg_id: Column) -> Column:
    """What precedes the first colon of a message id (K20s)."""
    return F.when(msg_id.contains(":"), blank_to_null(F.trim(F.split_part(msg_id, F.lit(":"), F.lit(1)))))


def base_id(msg_id: Column) -> Column:
    """A message id without its fan-out suffix."""
    return F.regexp_replace(msg_id, r":addr:\d+$", "")


def sibling_key(source: Column, msg_id: Column) -> Column:
    return F.concat_ws("|", source, base_id(msg_id))


def postcodes(c: Column) -> Column:
    """Six-digit words in order, each once."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(POSTCODE), F.lit(0)))


def house_in_text(c: Column) -> Column:
    """The first house number after its word."""
    return F.regexp_replace(blank_to_null(F.regexp_extract(c, HOUSE_IN_TEXT, 1)), r"\s+", "")


def compact(c: Column, limit: int) -> Column:
    """One line of at most ``limit`` characters, with an ellipsis where it was cut."""
    line = collapse_ws(c)
    return F.when(F.length(line) > limit, F.concat(F.rtrim(F.left(line, F.lit(limit - 1))), F.lit("…"))).otherwise(line)


def bullets(c: Column, least: int = 3, most: int = 5) -> Column:
    """The bullet lines of a digest, ``most`` at most; null with fewer than ``least`` (K26). Other lines are left out."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\R"), lambda x: F.trim(x))
    items = F.transform(F.filter(lines, lambda x: x.rlike(BULLET)), lambda x: collapse_ws(F.regexp_extract(x, BULLET, 1)))
    found = F.slice(F.filter(items, lambda x: x != ""), 1, most)
    return F.when(F.size(found) >= least, F.concat(F.lit("• "), F.array_join(found, "\n• ")))


def decorated(c: Column, link: str | None) -> Column:
    """A digest under its tag, once, and above a link to the bot."""
    body = blank_to_null(F.regexp_replace(F.trim(c), r"(?U)^(?:#итого\s*)?", ""))
    return F.concat_ws("\n", F.lit("#итого"), F.concat(F.lit("\n"), body), F.lit(f"\n[Присоединиться к боту]({link})" if link else None))


def payload_id(c: Column, kind: str) -> Column:
    """The positive number of a payload "notify:kind:number", else null."""
    found = blank_to_null(F.regexp_extract(c, rf"^notify:{kind}:([0-9]+)$", 1)).try_cast("int")
    return F.when(found > 0, found)


def stable_id(*parts: Column) -> Column:
    """Sixteen hexadecimal digits of the SHA-1 of the parts joined by bars."""
    return F.left(F.sha1(F.concat_ws("|", *parts).cast("binary")), F.lit(16))


def significant_prefix(c: Column, size: int) -> Column:
    """The first letters and digits of a name."""
    return F.upper(F.left(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""), F.lit(size)))


def street_key(c: Column) -> Column:
    """The sorted words of an address, for matching in any order."""
    return F.array_join(F.array_sort(F.split(address_text(c), " ")), " ")


def natural_key(c: Column) -> Column:
    """A sort key in which runs of digits compare as numbers."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")


def greeting_only(c: Column) -> Column:
    """Whether a message only greets."""
    bare = collapse_ws(F.regexp_replace(normalize_text(c), r"(?U)[^\w\s+]+", " "))
    return bare.isin(GREETINGS)


def has_update_hint(c: Column, hints: list[str] | None = None) -> Column:
    """Whether a text says that something known has changed."""
    return F.coalesce(F.lower(c).rlike("(?u)" + "|".join(hints or UPDATE_HINTS)), F.lit(False))


# Words for kinds of streets in any case, and what a street's name looks like.
STREET_TYPE = r"(?:ул\.?|улиц[аеыу]|пр-?т\.?|проспект[аеу]?|пер\.?|переул(?:ок|ке|ка)|ш\.?|шоссе|б-?р\.?|бульвар[аеу]?|наб\.?|набережн(?:ая|ой|ую)|пл\.?|площад[ьи]|проезд[аеу]?|алле[яию])"
STREET_NAME = r"(?:\d+-?[йяе]\s+)?[А-ЯЁ][а-яё0-9\-]*(?:\s+[А-ЯЁ][а-яё0-9\-]*){0,2}"
NAKED_STREET = r"(?:^|[\s,.;:(])(?:на|по|у)\s+([А-ЯЁ][а-яё]{3,20})(?=\s|,|\.|$)"
HINT_STOPS = ["в", "на", "по", "у", "и", "или", "дом", "корпус", "строение", "д", "к", "стр", "года", "году", "москве", "москва", "районе", "район", "сегодня", "вечера", "утра"]


def street_hints(c: Column) -> Column:
    """Names that can be streets: after a word for a street, before one, and after "на", "по" or "у" (K24).

    In this order, each once; without stop words and shorter than three letters not at all.
    """
    word = r"(?U)(?<![\w])"
    after = F.regexp_extract_all(c, F.lit(rf"{word}{STREET_TYPE}\s+({STREET_NAME})"), F.lit(1))
    before = F.regexp_extract_all(c, F.lit(rf"({STREET_NAME})\s+{STREET_TYPE}(?![\w])"), F.lit(1))
    naked = F.regexp_extract_all(c, F.lit(NAKED_STREET), F.lit(1))
    stops = F.array(*[F.lit(w) for w in HINT_STOPS])
    clean = F.transform(F.concat(after, before, naked), lambda h: F.array_join(F.filter(F.split(h, r"\s+"), lambda w: ~F.array_contains(stops, F.lower(w))), " "))
    return F.array_distinct(F.filter(clean, lambda h: F.length(h) >= 3))


# Names of no city or district, other spellings of the city, what precedes a district's name, and what no district is called.
CITY_ALIASES = {"moscow": "Москва", "москва": "Москва", "город москва": "Москва", "москва город": "Москва"}
INVALID_LOCALITIES = ["город не указан", "район не указан", "не указан", "unknown"]
DISTRICT_PREFIXES = ["вн.тер.г. муниципальный округ ", "внутригородская территория города федерального значения ", "внутригородское муниципальное образование ", "муниципальный округ ", "район "]
NO_DISTRICT = ["жилой комплекс", "снт ", "дск ", "мкад", "московская железная дорога", "мжд ", "километр"]
HOUSE_SUFFIX = r"(?iU)(?:\s+|,\s*)(?:д(?:ом)?\.?\s*)?\d+[а-яА-Яa-zA-Z]?\s*(?:/\s*\d+[а-яА-Яa-zA-Z]?|(?:к(?:орп(?:ус)?)?|[сc](?:тр(?:оение)?)?|стр(?:оение)?|строение)\.?\s*\d+[а-яА-Яa-zA-Z]?)\s*$"
LOGO_MARKS = ["logo", "favicon", "sprite", "icon", "apple-touch", "brand", "default_share", "default-share", "og_image_default", "social-default", "placeholder", "/static/i/", "cover-default"]


def _folded(c: Column) -> Column:
    return F.translate(F.lower(c), "ё", "е")


def city_label(c: Column) -> Column:
    """A city's name in its usual spelling; null for none."""
    name = collapse_ws(c)
    out = F.when((name == "") | _folded(name).isin(INVALID_LOCALITIES), F.lit(None).cast("string"))
    for other, usual in CITY_ALIASES.items():
        out = out.when(_folded(name) == other, usual)
    return out.otherwise(name)


def _bare_district(c: Column) -> Column:
    """A district's name without what precedes it."""
    out = None
    for prefix in DISTRICT_PREFIXES:
        rest = F.btrim(F.substr(c, F.lit(len(prefix) + 1)), F.lit(" -—"))
        out = F.when(F.startswith(_folded(c), F.lit(prefix)), rest) if out is None else out.when(F.startswith(_folded(c), F.lit(prefix)), rest)
    return out.otherwise(c)


def district_label(c: Column, city: Column) -> Column:
    """A district's name; null for names of the city, of no district, and of estates, roads and the like."""
    name = F.btrim(collapse_ws(c), F.lit(" ,"))
    none = lambda x: (x == "") | _folded(x).isin(INVALID_LOCALITIES + list(CITY_ALIASES))
    same = F.coalesce(_folded(name) == _folded(city_label(city)), F.lit(False))
    bare = _bare_district(name)
    noisy = F.lit(False)
    for mark in NO_DISTRICT:
        noisy = noisy | F.contains(_folded(bare), F.lit(mark))
    return F.when(~(none(name) | same | none(bare) | noisy), bare)


def district_name(c: Column) -> Column:
    """The name of an administrative boundary's district; null for the city itself."""
    bare = _bare_district(collapse_ws(c))
    return F.when((bare != "") & ~_folded(bare).isin(list(CITY_ALIASES)), bare)


def street_without_house(street: Column, number: Column) -> Column:
    """A street without the house that its field repeats at its end.

    The last one to four words go if they are the house; else a compound number ("4 к1", "4/1") at the end goes,
    but no plain number, which may be the street's name.
    """
    own = F.trim(street)
    parts = F.split(own, r"(?U)\s+")
    starts = F.sequence(F.greatest(F.lit(1), F.size(parts) - 4), F.greatest(F.size(parts) - 1, F.lit(1)))
    tail = lambda i: house(F.array_join(F.slice(parts, i + 1, F.greatest(F.size(parts) - i, F.lit(0))), " "))
    head = lambda i: F.btrim(F.array_join(F.slice(parts, 1, i), " "), F.lit(" ,"))
    fits = F.filter(starts, lambda i: (i < F.size(parts)) & (tail(i) == house(number)) & (head(i) != ""))
    by_house = F.when(F.size(fits) > 0, head(F.get(fits, 0)))
    cut = F.btrim(F.regexp_replace(own, HOUSE_SUFFIX, ""), F.lit(" ,"))
    return F.when(own == "", own).otherwise(F.coalesce(by_house, blank_to_null(cut), own))


def is_logo(url: Column) -> Column:
    """Whether a picture's URL is one of a site's own marks (F23): by its path and host."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))))
    return F.coalesce(hay.rlike("|".join(LOGO_MARKS)), F.lit(False))


def date_in_path(url: Column) -> Column:
    """The date that a news site has in its articles' paths, /text/rubric/year/month/day/number/."""
    got = [F.nullif(F.regexp_extract(url, r"/text/[^/]+/(\d{4})/(\d{2})/(\d{2})/(\d+)/?", i), F.lit("")).cast("int") for i in (1, 2, 3)]
    return F.try_make_timestamp_ntz(*got, F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))


def has_location(geo_by: Column, lat: Column, lon: Column) -> Column:
    """Whether an event can be pinned on a map (F35): a street or a house, at a place on earth."""
    fine = lambda x, most: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= most)
    return F.coalesce(geo_by.isin("street", "home"), F.lit(False)) & F.coalesce(fine(lat, 90.0) & fine(lon, 180.0), F.lit(False))


def first_field(json: Column, *paths: str) -> Column:
    """The first field of a JSON text that is there and not blank, by paths in order."""
    return F.coalesce(*[blank_to_null(F.trim(F.get_json_object(json, p))) for p in paths])


def shared_keys(a: Column, b: Column) -> Column:
    """How many alias keys two streets have in common (U4)."""
    return F.size(F.array_intersect(alias_keys(a), alias_keys(b)))
