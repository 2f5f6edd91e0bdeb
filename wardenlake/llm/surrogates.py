"""Surrogates of personal entities: keyed exchanges of one writing for another of the same form.

Every run of letters or digits of an entity goes through a keyed permutation of *all* runs of its form: as many letters, vowels for vowels, in the
same alphabet, or as many digits. A permutation gives two runs one image never, so different entities have different surrogates *as they are written*, whatever their
number: nothing is drawn from a list that could run out, and no look at other texts is needed. Each permutation is a shift by one seen through a keyed
Feistel network, and so leaves nothing in its place. Where an image isn't allowed (a kind of street for a street's name) the walk goes on along the cycle until it
is, which keeps the map one-to-one: this is the collision check.

Coreference follows from what a run's image depends on. A family name's depends on the family name, so title, initial and full name agree; a
given name's first letter is exchanged by a permutation of letters that is the family's own, so 'A. X' and 'Anna X' agree, and its ending tells the gender; a
phone number's depends on the number without country code and trunk prefix. Accents don't count, as they are often left out in typing.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache
from math import isqrt

#: Rounds of the Feistel network; four make it a strong pseudorandom permutation.
ROUNDS = 6
#: Hexadecimal digits of a placeholder's tag: 80 bits.
TAG_DIGITS = 20
# Letters by sound, in two alphabets.
SOUNDS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ")
# Endings that tell the gender of an invented given name, in Latin and Cyrillic letters; other scripts have none.
GENDER_END = {"f": "a", "m": "o", "": "e"}
CYRILLIC_END = {"f": "а", "m": "о", "": "е"}
# Country codes of one and of two digits; all others have three.
_CODES_1 = set("17")
_CODES_2 = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
PARTICLES = set("von van de del della da di ten ter der den la le du des dos das do af av zu zum zur y".split())


@lru_cache(maxsize=4096)
def _class_of(c: str) -> Sequence[str]:
    """The letters that may stand for a letter in lower case and without accents; itself alone where there is no other."""
    for sounds in SOUNDS:
        if c in sounds:
            return sounds
    if "一" <= c <= "鿿":
        return _Range(0x4E00, 0xA000)
    if "가" <= c <= "힣":
        return _Range(0xAC00, 0xD7A4)
    kind, block = unicodedata.category(c), ord(c) & ~0x7F
    alike = [x for x in map(chr, range(block, block + 128)) if unicodedata.category(x) == kind and unicodedata.normalize("NFKD", x) == x]
    return "".join(alike) if c in alike else c


class _Range(Sequence[str]):
    """The characters of a block as a sequence."""

    def __init__(self, first: int, end: int) -> None:
        self.first, self.end = first, end

    def __len__(self) -> int:
        return self.end - self.first

    def __getitem__(self, i: int) -> str:  # type: ignore[override]
        return chr(self.first + i)

    def index(self, c: str, *_: int) -> int:
        return ord(c) - self.first


def base(c: str) -> str:
    """A letter in lower case, a Latin or Greek one without accents; in other scripts marks tell letters apart."""
    low = c.lower()[:1]
    return unicodedata.normalize("NFD", low)[0] if "\x80" <= low < "\u0400" or "\u1e00" <= low < "\u2000" else low


def fold(text: str) -> str:
    """In lower case, without accents and with single blanks: names and streets that differ in these only are the same."""
    text = text.lower() if text.isascii() else "".join(base(c) for c in text if not "\u0300" <= c < "\u0370")
    return " ".join(text.split())


class Surrogates:
    """The exchanges under one key. The key stays in the worker's memory and is part of no plan."""

    def __init__(self, key: bytes) -> None:
        self._key = hashlib.blake2b(key, digest_size=32).digest()
        self.word = lru_cache(maxsize=100_000)(self._word)
        self.digits = lru_cache(maxsize=20_000)(self._digits)
        self.tag = lru_cache(maxsize=100_000)(self._tag)

    def _moved(self, x: int, n: int, tweak: str) -> int:
        """The image of x under the permutation of range(n) that the tweak names; nothing is its own image."""
        if n < 2:
            return x
        side = isqrt(n - 1) + 1
        seed = f"{tweak}\x1f{n}\x1f".encode()

        def mix(k: int, v: int) -> int:
            return int.from_bytes(hashlib.blake2b(seed + k.to_bytes(1, "big") + v.to_bytes(32, "big"), key=self._key, digest_size=24).digest(), "big") % side

        def forth(v: int) -> int:
            while True:
                a, b = divmod(v, side)
                for k in range(ROUNDS):
                    a, b = b, (a + mix(k, b)) % side
                v = a * side + b
                if v < n:
                    return v

        def back(v: int) -> int:
            while True:
                a, b = divmod(v, side)
                for k in reversed(range(ROUNDS)):
                    a, b = (b - mix(k, a)) % side, a
                v = a * side + b
                if v < n:
                    return v

        return back((forth(x) + 1) % n)

    def _mapped(self, letters: str, tweak: str, barred: Callable[[str], bool] | None = None) -> str:
        """The image of a run of letters in lower case and without accents, letter for letter in the same class."""
        classes = [_class_of(c) for c in letters]
        n, x = 1, 0
        for c, among in zip(letters, classes, strict=True):
            n *= len(among)
            x = x * len(among) + among.index(c)
        form = tweak + "\x1f" + "".join(among[0] for among in classes)
        while True:
            y = x = self._moved(x, n, form)
            out = []
            for among in reversed(classes):
                y, k = divmod(y, len(among))
                out.append(among[k])
            image = "".join(reversed(out))
            if n < 2 or barred is None or not barred(image):
                return image

    def _word(self, letters: str, tweak: str, barred: Callable[[str], bool] | None = None) -> str:
        return self._mapped(letters, tweak, barred)

    def _digits(self, digits: str, tweak: str) -> str:
        """As many digits; zeros at the front stay and none is added, so that prefixes keep their meaning."""
        zeros = len(digits) - len(digits.lstrip("0"))
        if zeros == len(digits):
            return digits
        low = 10 ** (len(digits) - zeros - 1)
        return "0" * zeros + str(low + self._moved(int(digits) - low, 9 * low, f"{tweak}\x1f{len(digits)}"))

    def _tag(self, kind: str, entity: str) -> str:
        return hmac.new(self._key, f"{kind}\x1f{entity}".encode("utf-8", "replace"), hashlib.sha256).hexdigest()[:TAG_DIGITS]

    def initial(self, letter: str, family: str) -> str:
        return self.word(letter, f"initial\x1f{family}")

    def given(self, name: str, family: str, gender: str) -> str:
        """The given name that stands for one (folded): its initial's exchange, an invented rest, and the gender's ending."""
        first, rest = name[0], name[1:]
        end = GENDER_END[gender] if first < "\u0370" else CYRILLIC_END[gender] if "\u0400" <= first < "\u0530" else ""
        return self.initial(first, family) + (self.word(rest, f"given\x1f{family}\x1f{first}\x1f{gender}") if rest else "") + end


def carried(original: str, plain: str, new: str) -> str:
    """A new letter or digit in the case and width of the one it stands for."""
    if new.isdigit():
        return chr(ord(original) - unicodedata.decimal(original) + int(new)) if len(original) == 1 and unicodedata.decimal(original, -1) >= 0 else new
    out = new.upper() if plain.isupper() and len(new.upper()) == 1 else new
    return chr(ord(out) + 0xFEE0) if "！" <= original <= "～" and "!" <= out <= "~" else out


_RUN = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*|\d+")


def _spelt(plain: str, original: str, images: dict[int, str]) -> str:
    """``plain`` with the characters at the given places exchanged, each written as its original; an image may be longer than one character.

    Combining accents of exchanged letters go, as accents don't count.
    """
    out = []
    for i, (p, o) in enumerate(zip(plain, original, strict=True)):
        new = images.get(i)
        if new is None:
            out.append(o)
        elif new:
            out += [carried(o, p, c) for c in new]
    return "".join(out)


def _into(images: dict[int, str], start: int, run: str, image: str) -> None:
    """Places the image of a run whose accents may be characters of their own."""
    at = [start + i for i, c in enumerate(run) if not "\u0300" <= c < "\u0370"]
    for n, i in enumerate(at):
        images[i] = image[n] if n < len(at) - 1 else image[n:]
    for i, c in enumerate(run):
        if "\u0300" <= c < "\u0370":
            images[start + i] = ""


def _letters(run: str) -> str:
    return "".join(base(c) for c in run if not "\u0300" <= c < "\u0370")


_NAME_RUN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")


@lru_cache(maxsize=4096)
def name_parts(plain: str) -> list[tuple[int, int, str]]:
    """(start, end, role) of the words of a written name; role is given, second, initial, middle, family or particle."""
    comma = plain.find(",")
    words = [(m.start(), m.end()) for m in _NAME_RUN.finditer(plain)]
    front = [w for w in words if comma < 0 or w[0] > comma]
    out = [(a, b, "family") for a, b in words if comma >= 0 and b <= comma]
    groups: list[list[tuple[int, int]]] = []
    for a, b in front:  # words that hyphens or apostrophes join are one
        if groups and a - groups[-1][-1][1] == 1 and plain[a - 1] in "-'’":
            groups[-1].append((a, b))
        else:
            groups.append([(a, b)])
    last = len(groups) if comma >= 0 else len(groups) - 1
    for n, g in enumerate(groups):
        word = plain[g[0][0] : g[-1][1]]
        single = len(word) == 1
        if n >= last:
            role = "family"
        elif n == 0:
            role = "initial" if single else "given"
        else:
            role = "middle" if single else "particle" if word.lower() in PARTICLES else "second"
        for k, (a, b) in enumerate(g):
            out.append((a, b, "second" if role == "given" and k else role))
    return sorted((a, b, "particle" if r == "family" and plain[a:b].lower() in PARTICLES and b < len(plain) and len([x for x in out if x[2] == "family"]) > 1 else r) for a, b, r in out)


@lru_cache(maxsize=4096)
def name_key(plain: str) -> tuple[str, str]:
    """The folded given name (one letter for an initial, nothing where there is none) and family name."""
    parts = name_parts(plain)
    family = " ".join(fold(plain[a:b]) for a, b, r in parts if r == "family")
    given = "-".join(fold(plain[a:b]) for a, b, r in parts if r in ("given", "initial"))
    second = [fold(plain[a:b]) for a, b, r in parts if r == "second"]
    return (" ".join([given, *second]) if second else given), family


def name_surrogate(s: Surrogates, plain: str, original: str, gender: str) -> str:
    images: dict[int, str] = {}
    family = name_key(plain)[1]
    for a, b, role in name_parts(plain):
        run = plain[a:b]
        low = _letters(run)
        if role == "family":
            image = s.word(low, "family")
        elif role == "initial":
            image = s.initial(low, family)
        elif role == "given":
            image = s.given(low, family, gender)
        elif role in ("middle", "second"):
            image = s.word(low, f"second\x1f{family}")
        else:
            continue
        _into(images, a, run, image)
    return _spelt(plain, original, images)


def national(plain: str) -> tuple[str, str, int]:
    """Country code ('' if none is written), the number without code and trunk prefix, and how many digits stand before it."""
    text = plain.replace("(0)", "")
    digits = "".join(re.findall(r"\d", text))
    dropped = plain.count("(0)")
    abroad = text.lstrip(" (").startswith("+")
    if abroad or (digits.startswith("00") and len(digits) > 10):
        lead = 0 if abroad else 2
        rest = digits[lead:]
        size = 1 if rest[:1] in _CODES_1 else 2 if rest[:2] in _CODES_2 else 3
        return rest[:size], rest[size:], lead + size + dropped
    if digits.startswith("0"):
        return "", digits[1:], 1
    if len(digits) == 11 and digits.startswith("1"):
        return "", digits[1:], 1
    return "", digits, 0


def phone_surrogate(s: Surrogates, plain: str, original: str) -> str:
    _, number, before = national(plain)
    image = s.digits(number, "phone") if number else ""
    at = [i for i, c in enumerate(plain) if unicodedata.decimal(c, -1) >= 0][before:]
    return _spelt(plain, original, dict(zip(at, image, strict=False)))


def id_surrogate(s: Surrogates, plain: str, original: str) -> str:
    """Letters for letters and digits for digits, all at once."""
    images: dict[int, str] = {}
    at = [i for i, c in enumerate(plain) if c.isalnum()]
    at = [i for i in at if plain[i].isascii()]
    radix = [10 if plain[i].isdigit() else 26 for i in at]
    n, x = 1, 0
    for i, r in zip(at, radix, strict=True):
        n *= r
        x = x * r + (int(plain[i]) if r == 10 else ord(plain[i].lower()) - 97)
    y = s._moved(x, n, "id\x1f" + "".join("d" if r == 10 else "l" for r in radix))
    for i, r in zip(reversed(at), reversed(radix), strict=True):
        y, k = divmod(y, r)
        images[i] = str(k) if r == 10 else chr(97 + k)
    return _spelt(plain, original, images)


def words_surrogate(s: Surrogates, plain: str, original: str, tweak: str, kept: Callable[[str], bool], tail: Callable[[str], int] = lambda _: 0, spared: Sequence[tuple[int, int]] = ()) -> str:
    """Every word and number exchanged but those ``kept`` and those in ``spared`` places; of a word its last ``tail`` letters stay (a kind of street in a compound)."""
    images: dict[int, str] = {}
    for m in _RUN.finditer(plain):
        a, run = m.start(), m[0]
        if any(x <= a < y for x, y in spared):
            continue
        if run.isdigit():
            for i, c in enumerate(s.digits("".join(str(unicodedata.decimal(c)) for c in run), tweak)):
                images[a + i] = c
            continue
        low = _letters(run)
        if kept(low):
            continue
        n = tail(low)
        head = low[: len(low) - n]
        image = s.word(head, tweak, kept if not n else None) if head else ""
        if not n and tail(image):  # it must not read like a compound: walk on
            while tail(image):
                image = s.word(image, tweak, kept)
        if head:
            _into(images, a, run[: len(run) - n] if n else run, image)
    return _spelt(plain, original, images)
