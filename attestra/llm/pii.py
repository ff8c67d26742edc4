"""Personal data with surrogates (operator 9).

Entities of a text (e-mail addresses, phone numbers, card numbers, IPv4 addresses, secrets, named persons) are replaced by
keyed surrogates of the same kind and format. Strings are enciphered in place: a keyed permutation of all strings with the
same shape (letters of the same alphabet and case, digits), so different entities get different surrogates and the same
entity the same one everywhere. Names are drawn from lists of the same gender and script, then composed of its syllables.

Two passes: the first lists the distinct entities, and a Spark job checks their surrogates (two entities with one surrogate,
a surrogate that is itself an entity of the corpus, or the entity unchanged) and keys the offenders anew until none is left;
the second replaces. Where a shape has too few strings, later attempts draw from a larger space of generated values of the kind.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name

#: From the at sign on; labels and the top domain have the lengths that domain names allow.
_AT_DOMAIN = re.compile(r"@(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,63}")
_CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])")
_PHONE = re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w+(.])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")
_SECRET = re.compile(
    r"(?<!\w)(?:AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36})(?!\w)"
    r"|(?i:(?<![^\W_])(?:token|password|passwd|pass|secret|api[_-]?key|access[_-]?key|key)(?!\w))[\"']?\s?[=:]\s?[\"']?(?P<value>(?=[A-Za-z_/+-]*\d)[\w/+=.-]{8,})"
)
#: Titles that announce a person, by gender and script.
TITLES = {
    ("f", "latin"): "Mrs Ms Miss Madam Frau Mme Madame Mlle Señora Sra Señorita Signora",
    ("m", "latin"): "Mr Sir Herr Monsieur Señor Sr Signor",
    ("f", "cyrillic"): "Госпожа госпожа",
    ("m", "cyrillic"): "Господин господин",
    ("u", "latin"): "Dr Prof Doctor Doktor Professor",
    ("u", "cyrillic"): "Доктор доктор Профессор профессор",
}
#: Given names and family names for surrogates, by gender and script.
GIVEN = {
    ("f", "latin"): "Ada Alma Anna Bella Carla Clara Diana Edith Elena Emma Flora Greta Hanna Ida Irene Julia Karen Laura Lena Maria Marta Nina Nora Olga Paula Rita Rosa Sara Sofia Tina Vera Viola",
    ("m", "latin"): "Adam Albert Anton Bruno Carl Daniel David Emil Erik Felix Frank Georg Hugo Ivan Jakob Julian Karl Leo Lukas Marco Martin Max Noah Oscar Otto Paul Peter Robert Simon Thomas Victor Walter",
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Лидия Мария Нина Ольга Раиса Софья Тамара Юлия",
    ("m", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Степан",
}
FAMILY = {
    "latin": "Abbot Adler Barton Becker Benson Bishop Brandt Carter Castell Conrad Dalton Decker Duran Eaton Ellis Farrow Fischer Fuller Gardner Grant Hale Harper Hartmann Hobbs Irving Jansen Keller Kramer Lambert Lopez Mercer Moreau Nolan Norton Ortega Palmer Porter Quinn Ramos Reuter Sander Sawyer Thorne Turner Ulrich Vance Vogel Weber Wells Winter York Ziegler",
    "cyrillic": "Белов Волков Громов Дроздов Ежов Жуков Зимин Климов Лебедев Морозов Орлов Павлов Рыбин Соколов Туманов Фролов",
}
_TITLED = {t: gender_script for gender_script, titles in TITLES.items() for t in titles.split()}
#: Gender and script of the listed given names; one of these before a capitalised word is a person without a title.
_LISTED = {n: gender_script for gender_script, names in GIVEN.items() for n in names.split()}
GIVEN |= {("u", script): f"{GIVEN['f', script]} {GIVEN['m', script]}" for script in FAMILY}
#: Every title contains one of these.
_TITLE_HINTS = ["Dr", "Prof", "Doctor", "Doktor", "октор", "рофессор", "Mr", "Ms", "Mme", "Mlle", "Mad", "Miss", "Mons", "Frau", "Herr", "Sir", "Señ", "Sr", "Sig", "оспо"]
_WORD = r"[^\W\d_]{2,}"
_TITLE = "|".join(sorted(_TITLED, key=len, reverse=True))
_NAME = rf"{_WORD}(?:-{_WORD})?"
#: A name that does not begin with a small letter.
_CAPITAL = rf"(?=[^\W\d_a-zß-öø-ÿа-яё]){_NAME}"
#: After titles: one word and any number of capitalised ones, or one of any kind.
_PERSON = re.compile(rf"(?<!\w)(?P<titles>(?:(?:{_TITLE})\.?[ \xa0])+)(?P<names>{_NAME}(?:(?: {_CAPITAL})+| {_NAME})?)(?!\w)")
#: No look-behind, so that the scan goes by first letters.
_UNTITLED = re.compile(rf"(?P<names>(?:{'|'.join(sorted(_LISTED, key=len, reverse=True))})(?:-{_WORD})? {_NAME})(?!\w)")
_NEXT_NAME = re.compile(rf" ({_NAME})(?!\w)")
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåçèéêëìíîïñòóôõöùúûüýÿœæøß", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
_ALPHABETS += [a.upper() for a in (_ALPHABETS[1], _ALPHABETS[2].replace("ß", "").replace("ÿ", ""), _ALPHABETS[3], _ALPHABETS[4])]
#: Country calling codes of one and two digits; all others have three, and none begins another.
_SHORT_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_PLACE = {c: (k, i) for k, a in enumerate(_ALPHABETS) for i, c in enumerate(a)}


#: Attempts that take a name from the lists, and what names are composed of beyond: heads and hearts of syllables, and ends.
_LISTED_NAMES = 2
_SYLLABLES = {
    "latin": ("b br c d f g gr h j k l m n p r s st t tr v w".split(), "a e i o u ai ei".split(), "n r l s t ner man berg son ton".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х".split(), "а е и о у я".split(), "в н р ев ов ин ский ко".split()),
}
#: Attempts that keep an entity's format; those beyond generate a value of its kind, so that every entity gets one.
_FORMATTED = 16
#: Classes of other characters: CJK and Hangul whole, else blocks of the first width, merged to the next where small.
_WHOLE = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x20000, 0x323AF))
_WIDTHS = (7, 10, 13, 16, 21)


def _group(c: str) -> tuple[str, int, int]:
    """(category, width, place) of a letter or digit of no alphabet above; characters that change with case apart."""
    kind, x = unicodedata.category(c), ord(c)
    if kind == "Nd":
        return kind, 0, x - unicodedata.decimal(c)
    kind += "" if kind != "Ll" or c.upper().lower() == c and len(c.upper()) == 1 else "*"
    return kind, *next(((0, lo) for lo, hi in _WHOLE if lo <= x <= hi), (7, x >> 7))


@lru_cache(maxsize=1)
def _other_alphabets() -> dict[tuple[str, int, int], str]:
    """Every letter and digit of Unicode beyond the alphabets above in one class; blocks with few of a category are merged."""
    groups: dict[tuple[str, int, int], list[str]] = defaultdict(list)
    for c in map(chr, range(128, 0x110000)):
        if c.isalnum() and c not in _PLACE:
            groups[_group(c)].append(c)
    out = {}
    for narrow, wide in zip(_WIDTHS, [*_WIDTHS[1:], None], strict=True):
        for g in [g for g in groups if g[1] == narrow]:
            if len(groups[g]) < 20 and wide is not None:
                groups[g[0], wide, ord(groups[g][0]) >> wide] += groups.pop(g)
    for g, members in groups.items():
        out[g] = "".join(sorted(members))
    return out


@lru_cache(maxsize=10_000)
def _place(c: str) -> tuple[str, int] | None:
    """The alphabet of a character and its place there; None for separators."""
    if (p := _PLACE.get(c)) is not None:
        return _ALPHABETS[p[0]], p[1]
    if not c.isalnum():
        return None
    kind, width, at = _group(c)
    options = [(kind, width, at)] if width == 0 else [(kind, w, ord(c) >> w) for w in _WIDTHS]
    for alphabet in (a for g in options if (a := _other_alphabets().get(g))):
        if (i := alphabet.find(c)) >= 0:
            return alphabet, i
    return None


def _ascii_digits(text: str) -> str:
    """The digits of a text, of any script, as 0 to 9."""
    return "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def _like(c: str, digit: str) -> str:
    """A digit in the script of the digit ``c``."""
    return chr(ord(c) - unicodedata.decimal(c) + int(digit))


def luhn_sum(digits: str) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _round(key: bytes, tweak: str, i: int, x: int, bits: int) -> int:
    h = hashlib.blake2b(f"{tweak}|{i}|{x}".encode(), key=key).digest()
    if bits > 512:
        h = hashlib.shake_256(h).digest(bits // 8 + 1)
    return int.from_bytes(h, "big") & ((1 << bits) - 1)


def permuted(key: bytes, tweak: str, x: int, size: int) -> int:
    """A keyed permutation of range(size): a Feistel network on enough bits, walked until it is back in the range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for i in range(8):
            left, right = right, left ^ _round(key, tweak, i, right, half)
        x = (left << half) | right
        if x < size:
            return x


def enciphered(key: bytes, tweak: str, text: str) -> str:
    """Permutes the strings of this text's shape: letters and digits within their alphabets, separators stay."""
    known = [_place(c) for c in text]
    shape = ",".join(c if p is None else f"#{k[0]}" if (k := _PLACE.get(c)) else f"#{p[0][0]}" for c, p in zip(text, known, strict=True))
    value, size = 0, 1
    for p in known:
        if p is not None:
            value, size = value * len(p[0]) + p[1], size * len(p[0])
    value = permuted(key, f"{tweak}|{shape}", value, size) if size > 1 else value
    out = list(text)
    for at in range(len(out) - 1, -1, -1):
        if (p := known[at]) is not None:
            value, digit = divmod(value, len(p[0]))
            out[at] = p[0][digit]
    return "".join(out)


def _in_place(pattern: str, digits: str, skip: int = 0) -> str:
    """``pattern`` with its digits after the first ``skip`` replaced by ``digits``, in order and in its script."""
    new, seen = iter(digits), 0
    out = []
    for c in pattern:
        if c.isdecimal():
            seen += 1
            out.append(c if seen <= skip else _like(c, next(new)))
        else:
            out.append(c)
    return "".join(out)


def _code_length(digits: str) -> int:
    """Length of the country calling code that a full number begins with, however it is written."""
    return next((n for n in (1, 2) if digits[:n] in _SHORT_CODES), 3)


def _class_of_ip(x: int) -> str:
    first = x >> 24
    return "private" if first == 10 or x >> 20 == 0xAC1 or x >> 16 == 0xC0A8 else "special" if first in (0, 127) or first >= 224 else "public"


def _generated(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """A keyed value of the kind from a space of at least 2**64, for entities whose shape has too few strings."""
    x = int.from_bytes(hashlib.blake2b(f"{kind}|{attempt}|{entity}".encode(), key=key).digest(), "big")
    if kind == "phone":
        d = f"{x % 10**20:020d}"
        return f"+{entity[: _code_length(entity)]} {d[:4]} {' '.join(d[i : i + 4] for i in range(4, 20, 4))}"
    if kind == "card":
        body = f"{1 + x % 9}{x // 9 % 10**17:017d}"
        return body + str((10 - luhn_sum(body + "0")) % 10)
    if kind == "ip":  # an address of the documentation range of IPv6
        return "2001:db8:" + ":".join(f"{x >> 16 * i & 0xFFFF:x}" for i in range(6))
    if kind == "email":
        return f"{x % 16**24:024x}@{entity.rpartition('@')[2]}"
    if kind == "secret":
        return f"{x % 16**40:040x}"
    letters = _ALPHABETS[3] if kind.endswith("cyrillic") else _ALPHABETS[1]
    return "".join(letters[x // len(letters) ** i % len(letters)] for i in range(16)).title()


def _composed(x: int, script: str, syllables: int) -> str:
    """A name of syllables of the script, for more names than the lists have."""
    heads, hearts, tails = _SYLLABLES[script]
    out = ""
    for _ in range(syllables):
        x, h = divmod(x, len(heads))
        x, v = divmod(x, len(hearts))
        out += heads[h] + hearts[v]
    return (out + tails[x % len(tails)]).title()


@lru_cache(maxsize=100_000)
def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The surrogate of a canonical entity; ``attempt`` keys it anew."""
    tweak = f"{kind}|{attempt}"
    if kind == "card":  # the check digit stays right
        body = enciphered(key, tweak, entity[:-1])
        return body + str((10 - luhn_sum(body + "0")) % 10)
    if kind == "ip":
        x = int.from_bytes(bytes(map(int, entity.split("."))), "big")
        own = _class_of_ip(x)
        while True:
            x = permuted(key, tweak, x, 1 << 32)
            if _class_of_ip(x) == own:
                return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "email":
        name, _, domain = entity.rpartition("@")
        labels, _, top = domain.rpartition(".")
        return f"{enciphered(key, tweak + top, name + '@' + labels)}.{top}"
    if kind.startswith("given-") or kind.startswith("family-"):
        what, *rest = kind.split("-")
        names = (GIVEN[tuple(rest)] if what == "given" else FAMILY[rest[0]]).split()
        x = int.from_bytes(hashlib.blake2b(f"{tweak}|{entity}".encode(), key=key, digest_size=16).digest(), "big")
        return names[x % len(names)] if attempt < _LISTED_NAMES else _composed(x, rest[-1], 3 + attempt // 8)
    if kind == "secret" and entity.startswith(("AKIA", "ghp_")):
        return entity[:4] + enciphered(key, tweak, entity[4:])
    return enciphered(key, tweak, entity)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the e-mail addresses. A local part is read backwards from its at sign, so it may have any length."""
    last = 0
    for m in _AT_DOMAIN.finditer(text):
        start = m.start()
        while start > last and (text[start - 1].isalnum() or text[start - 1] in "_.+%-"):
            start -= 1
        while start < m.start() and not text[start].isalnum():
            start += 1
        if start < m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            yield start, m.end()
            last = m.end()


def _valid_card(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return 13 <= len(digits) <= 19 and luhn_sum(digits) == 0 and len(set(digits)) > 1


def _named(text: str, at: int, names: list[str], gender: str, script: str) -> Iterator[tuple[str, str]]:
    """(kind, word) of the names at a place: given names and, last, the family name."""
    while names and (not names[-1][0].isupper() or names[-1] in _TITLED):
        names.pop()
    end = at + len(" ".join(names))
    # a listed given name in last place is a middle name if another name follows
    while names and names[-1] in _LISTED and (m := _NEXT_NAME.match(text, end)) and m[1][0].isupper() and m[1] not in _TITLED:
        names.append(m[1])
        end = m.end()
    for i, name in enumerate(names):
        if name[0].isupper():
            known, own = _LISTED.get(name.title(), ("u", script))
            by = gender if gender != "u" else known if own == script else "u"
            yield f"family-{script}" if i == len(names) - 1 else f"given-{by}-{script}", name


def _persons(text: str) -> list[tuple[int, int, str, str]]:
    """Mentions of the persons of a text: named after a title or by a listed given name, then by any of their names alone."""
    kinds: dict[str, str] = {}
    sure: dict[int, tuple[int, int, str, str]] = {}
    hits = []
    for m in _PERSON.finditer(text) if any(x in text for x in _TITLE_HINTS) else ():
        titles = [_TITLED[t.rstrip(".")] for t in m["titles"].split()]
        hits.append((m, *next((t for t in titles if t[0] != "u"), titles[0])))
    for m in _UNTITLED.finditer(text):
        if (m.start() == 0 or not (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")) and m["names"].split(" ")[1][0].isupper():
            hits.append((m, "u", _LISTED[re.match(_WORD, m["names"])[0]][1]))
    for m, gender, script in sorted(hits, key=lambda h: h[1] == "u"):  # a person's gender is that of a gendered title, if any
        at = m.start("names")
        for kind, name in _named(text, at, m["names"].split(" "), gender, script):
            if kind.startswith("given-u-"):
                kind = next((k for k in (kinds.get(f"given {name.title()}"),) if k), kind)
            start = text.index(name, at)
            at = start + len(name)
            sure.setdefault(start, (start, at, kind, name.title()))
            kinds.setdefault(name.title(), kind)
            if kind.startswith("given"):
                kinds.setdefault(f"given {name.title()}", kind)
    if not sure:
        return []
    words = {w: n for n in kinds if " " not in n for w in (n, n.upper())} | {text[s:e]: n for s, e, _, n in sure.values()}
    bare = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(words, key=len, reverse=True)))})(?!\w)")
    return [*sure.values(), *((*m.span(), kinds[words[m[0]]], words[m[0]]) for m in bare.finditer(text))]


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical entity) of each entity, in order and without overlap; earlier rules win."""
    found: list[tuple[int, int, str, str]] = []

    def add(start: int, end: int, kind: str, entity: str) -> None:
        at = bisect_left(found, (start,))
        if (at == 0 or found[at - 1][1] <= start) and (at == len(found) or end <= found[at][0]):
            found.insert(at, (start, end, kind, entity))

    for start, end in _emails(text) if "@" in text else ():
        add(start, end, "email", text[start:end].lower())
    if "=" in text or ":" in text or "AKIA" in text or "ghp_" in text:
        for m in _SECRET.finditer(text):
            at = m.span("value") if m["value"] else m.span()
            add(*at, "secret", text[at[0] : at[1]])
    if _DIGIT_RUN.search(text):
        for m in _PHONE.finditer(text):
            digits = _ascii_digits(m[0])  # the form without country code, (ddd) ddd-dddd, is that of code 1
            add(*m.span(), "phone", digits if m[0][0] == "+" else "1" + digits)
        for m in _CARD.finditer(text):
            if _valid_card(m[0]):
                add(*m.span(), "card", _ascii_digits(m[0]))
        for m in _IP.finditer(text):
            add(*m.span(), "ip", ".".join(str(int(x)) for x in m[0].split(".")))
    for start, end, kind, entity in _persons(text):
        add(start, end, kind, entity)
    return found


_DIGIT_RUN = re.compile(r"\d[\d .()-]{5}")


def rendered(key: bytes, original: str, kind: str, entity: str, attempt: int = 0) -> str:
    """The surrogate in the format of the mention: separators and letter case of the original."""
    if attempt >= _FORMATTED:
        new = _generated(key, kind, entity, attempt)
        return new.upper() if kind[:5] in ("given", "famil") and original.isupper() else new
    if kind == "phone":
        skip = _code_length(entity)
        return _in_place(original, surrogate(key, f"phone{skip}", entity[skip:], attempt), skip if original[0] == "+" else 0)
    new = surrogate(key, kind, entity, attempt)
    if kind == "card":
        return _in_place(original, new)
    if kind == "ip":
        return "".join(_like(original[0], c) if c.isdecimal() else c for c in new)
    if kind == "email":
        return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for o, n in zip(original, new, strict=True)) if len(original) == len(new) else new
    if kind[:5] in ("given", "famil") and original.isupper():
        return new.upper()
    return new


def _checked(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """What the collision check compares: the surrogate in its plainest format."""
    return rendered(key, f"+{entity}" if kind == "phone" else entity, kind, entity, attempt)


def _collisions(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt) of the entities that need another attempt than 0, from the distinct (kind, entity).

    The rounds end: at the latest from attempt ``_FORMATTED`` on, surrogates come from a space far larger than any corpus.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = [_checked(key, k, e, a) for k, e, a in zip(b["kind"], b["entity"], b["attempt"], strict=True)]
            own = [f"+{e}" if k == "phone" else e for k, e in zip(b["kind"], b["entity"], strict=True)]
            yield b.assign(new=new, own=own)

    state = found.withColumn("attempt", F.lit(0))
    while True:
        named = checkpointed(state.mapInPandas(run, "kind string, entity string, attempt int, new string, own string"))
        # of several entities with one surrogate the first attempts win, then the least entity
        first = named.groupBy("kind", "new").agg(F.min(F.struct("attempt", "entity")).alias("first"))
        real = named.select("kind", F.col("own").alias("new")).distinct().withColumn("real", F.lit(True))
        judged = named.join(first, ["kind", "new"]).join(real, ["kind", "new"], "left")
        bad = (F.col("first.entity") != F.col("entity")) | F.coalesce("real", F.lit(False))
        # a list of names is short and its names occur in texts; there only distinct surrogates are asked for, up to its end
        bad = F.when(F.col("kind").rlike("^(given|family)") & (F.col("attempt") < _LISTED_NAMES), (F.col("first.entity") != F.col("entity")) | (F.col("new") == F.col("own"))).otherwise(bad)
        judged = checkpointed(judged.select("kind", "entity", "attempt", bad.alias("bad")))
        if judged.filter("bad").isEmpty():
            return judged.filter("attempt > 0").select("kind", "entity", "attempt")
        state = judged.select("kind", "entity", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"))


def pseudonymised(df: DataFrame, key: bytes, text_col: str = "text", id_col: str = "doc_id", most_listed: int = 10_000) -> DataFrame:
    """``df`` with the entities of ``text_col`` replaced, and two more columns: n_entities and spans (kind, start, end of the original).

    ``key`` is the secret of the surrogates (at most 64 bytes); equal keys and corpora give equal results. All other columns
    pass through; where the table has a column n_entities or spans of its own, that one stays and the new one is left out. Null texts stay null and empty ones empty, without entities; texts without entities stay as they are;
    repeated rows are treated alike; an empty table gives no rows. Entities whose first surrogate collides are few; up to
    ``most_listed`` of them are sent to the tasks as a list, beyond that they are joined to the documents by entity.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = {(kind, e) for t in b["t"] if isinstance(t, str) for _, _, kind, e in entities(t)}
            yield pd.DataFrame(sorted(seen), columns=["kind", "entity"])

    found = df.select(F.col(text_col).alias("t")).mapInPandas(listed, "kind string, entity string").distinct()
    again = checkpointed(_collisions(checkpointed(found), key))
    many = again.count()
    spans = "array<struct<kind:string,start:int,end:int>>"
    result = f"text string, n_entities int, spans {spans}"

    def replaced(text: object, attempts: dict[tuple[str, str], int]) -> tuple:
        if not isinstance(text, str) or not (hits := entities(text)):
            return (text if isinstance(text, str) else None, 0, [])
        out, last = [], 0
        for start, end, kind, entity in hits:
            out += [text[last:start], rendered(key, text[start:end], kind, entity, attempts.get((kind, entity), 0))]
            last = end
        public = [{"kind": k.split("-")[0], "start": s, "end": e} for s, e, k, _ in hits]
        return ("".join(out) + text[last:], len(hits), public)

    if many <= most_listed:
        attempts = {(r["kind"], r["entity"]): r["attempt"] for r in again.collect()}

        @F.pandas_udf(result)
        def replace(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([replaced(t, attempts) for t in texts], columns=["text", "n_entities", "spans"])

        new, own = replace(F.col(text_col)), df
    else:

        @F.pandas_udf("array<struct<kind:string,entity:string>>")
        def mentions(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [{"kind": k, "entity": e} for _, _, k, e in entities(t)] if isinstance(t, str) else [])

        @F.pandas_udf(result)
        def replace_with(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
            rows = [replaced(t, {(x["kind"], x["entity"]): x["attempt"] for x in (a if a is not None else [])}) for t, a in zip(texts, lists, strict=True)]
            return pd.DataFrame(rows, columns=["text", "n_entities", "spans"])

        th_name, again_name = free_name(df, "text_hash"), free_name(df, "again")
        pairs = df.select(F.xxhash64(F.col(text_col)).alias("th"), F.explode(mentions(F.col(text_col))).alias("m")).select("th", "m.*").distinct()
        by_text = pairs.join(again, ["kind", "entity"]).groupBy("th").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias(again_name))
        own = df.withColumn(th_name, F.xxhash64(F.col(text_col))).join(by_text.withColumnRenamed("th", th_name), th_name, "left").drop(th_name)
        new = replace_with(F.col(text_col), F.col(again_name))
    taken = {c.lower() for c in df.columns}
    s_name = free_name(own, "replaced")
    out = own.withColumn(s_name, new)
    kept = [F.col(f"{s_name}.text").alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in df.columns]
    more = [F.col(f"{s_name}.{c}").alias(c) for c in ("n_entities", "spans") if c not in taken]
    return out.select(*kept, *more)
