"""The language of texts and of the stretches in them, by prediction by partial matching.

For each language a tree of byte contexts of up to ``order`` bytes is counted once and then frozen. A byte's exact code length under a
language is the one of PPM with escape method D: -log2((2n-1)/2N) where the byte was seen n times among N in the longest
known context, and -log2(d/2N) for escaping from a context with d successors to the next shorter one, down to 8 bits for a byte never seen. As the statistics
are frozen, the code length of every counted n-gram under *all* languages, escapes included, is one row of a matrix; scoring is
looking up the longest known n-gram at every position and adding the rows, for whole batches at once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenlake.llm import confusables
from wardenlake.plans.lineage import cut

ORDER = 5
#: About so many labelled rows are fitted, at one rate for all labels; the rest of the corpus is scored, not fitted.
FIT_ROWS = 20_000
#: Labelled rows longer than this many characters are not used for fitting.
FIT_CHARS = 20_000
#: Rounds of correcting labels.
LABEL_ROUNDS = 3
#: Share of capitalised words from which on a piece is a heading, whose capitals show no names.
HEADING_SHARE = 0.7
#: Pieces that a worker keeps in plain form; only speed depends on it.
KNOWN_PIECES = 100_000
#: Pieces that a worker keeps with their code lengths; only speed depends on it.
KNOWN_BITS = 20_000
#: Bits that a change of language between two pieces costs.
SWITCH_BITS = 24.0
#: Bytes scored at once.
CHUNK = 200_000
#: Characters of the pieces in one row of ``read_windows``, and rows that a reader holds at once.
READ_CHUNK, READ_ROWS = 1_000_000, 8
#: Distinct pieces or windows that a task holds before it hands them on; only speed depends on it.
HELD = 2_000_000
#: In a window, the bytes before its piece; UTF-8 has no such byte.
BEFORE = 255

# ISO 639 codes of two and three letters, and names in use for the languages.
LANGUAGES = """
en eng english anglais englisch inglés inglese
de deu ger german deutsch allemand alemán tedesco
fr fra fre french français francais französisch francés
es spa spanish español espanol castellano spanisch espagnol
it ita italian italiano italienisch
pt por portuguese português portugues
nl nld dut dutch nederlands
pl pol polish polski
ru rus russian русский
ja jpn japanese 日本語
sv swe swedish svenska
da dan danish dansk
no nor norwegian norsk
nb nob bokmål
fi fin finnish suomi
cs ces cze czech čeština
sk slk slo slovak slovenčina
hu hun hungarian magyar
ro ron rum romanian română
tr tur turkish türkçe
el ell gre greek ελληνικά
uk ukr ukrainian українська
bg bul bulgarian български
ar ara arabic العربية
he heb hebrew עברית
hi hin hindi हिन्दी
zh zho chi chinese 中文
ko kor korean 한국어
vi vie vietnamese
id ind indonesian
ca cat catalan català
"""
NAMES = {name: line.split()[0] for line in LANGUAGES.strip().splitlines() for name in line.split()}

#: What ends a piece. It begins with one set of characters, which a search finds much faster than alternatives.
_END = re.compile(r"[.!?…。！？\n](?:(?<=[.!?…])[.!?…]*[\"'”»)\]]*(?=\s)|(?<=[。！？])[。！？]*|(?<=\n))")
#: Numbers, which are in no plain form and tell no code; pieces that differ in them only are read once.
FIGURES = re.compile("[0-9]+")
_SPELT_AT = re.compile(r"[\[(] ?(?:at|arroba|arobase) ?[\])]")
_SPELT_ADDRESS = re.compile(r"\S+ ?[\[(] ?(?:at|arroba|arobase) ?[\])] ?\S+(?: ?[\[(](?:dot|punto|point|punkt)[\])] ?\S+)*")
#: Runs with a mark are looked for where a run or, behind a tag, the rest of one begins, and read once.
_NOT_WORDS = re.compile(r"https?://\S+|www\.\S+|<[^<>\s]*/?>|(?<![^\s、-ヿ一-鿿>])[^\s、-ヿ一-鿿\d_@#\\|=<>{}\[\]^~`]*+[\d_@#\\|=<>{}\[\]^~`][^\s、-ヿ一-鿿]*+|[•*→]+")
# Abbreviations before names and numbers.
_SHORT = re.compile(r"(?:^|[\s(¿])(?:[A-ZÀ-Þ]|Mr|Mrs|Ms|Mme|Mlle|Dr|Dra|Sr|Sra|Prof|Hr|Fr|St|Str|Apt|Tel|tel|Tél|tél|No|no|Nr|nr|n|ca|z\. ?B|bzw)\.$")
_WORD = re.compile(r"[^\W\d_ぁ-ヿ一-鿿]{2,}|[ぁ-ヿ一-鿿]{2}")
#: Capitalised words that don't begin the piece: names in most languages; German does without its nouns, in fitting and scoring alike.
_NAMES = re.compile(r"[^\W\d_a-zà-öø-ÿа-яё](?<=[\w,;:)»”\"'’.-] .)[^\W\d_]*(?:[-'’][^\W\d_]+)*\.?")
_INVISIBLE = frozenset(chr(c) for c in range(0x80, 0xE0080) if unicodedata.category(chr(c)) == "Cf")
_NO_INVISIBLE = {ord(c): None for c in _INVISIBLE}
_OTHER_ALPHABET = re.compile("[Ͱ-֏]")
_LATIN_LETTER = re.compile("[A-Za-z]")
#: A line of names only, below a greeting.
_SIGNATURE = re.compile(r"\s*[A-ZÀ-Þ][^\s\d]*(?:,? [A-ZÀ-Þ][^\s\d]*)+\s*")
_CODE = re.compile(r"\bSELECT\b.*\bFROM\b|\b(?:INSERT INTO|DELETE FROM|UPDATE \w+ SET|CREATE TABLE)\b|^\s*[\[{].*[\]}]\s*$|^\s*(?:for|while|if|def|class|import|from|return)\b.*[:(=]\s*\S*$|^\s*\w+\(.*\)\s*;?\s*$|[{}]\s*$|\);\s*$|=>|::|\+=|&&|\|\|", re.S)
#: A piece without any of these, and without "www.", has nothing for ``_NOT_WORDS`` and ``_SPELT_AT``, and isn't code but for the words of SQL.
_ANY_MARK = re.compile(r"[\d_@#\\|=<>{}\[\]^~`•*→/()+&%$\";:]")
#: Of these, what tells code, and what ASCII text needs more for than leaving out words with figures.
_ANY_CODE = re.compile(r"[{}\[\]()<>=;_/\\|+*&^%$#@\"`~:]")
_ANY_BUT_FIGURES = re.compile(r"[_@#\\|=<>{}\[\]^~`*/(]")
_ANY_SQL = re.compile("SELECT|INSERT|DELETE|UPDATE|CREATE")
_CODE_MARKS = re.compile(r"[{}\[\]()<>=;_/\\|+*&^%$#@\"`~]")


def code_column(label: Column) -> Column:
    """The two-letter code that a label names in any usual spelling, else NULL."""
    plain = F.lower(F.trim(label))
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.coalesce(names[plain], names[F.regexp_extract(plain, r"^([a-z]{2,3})[-_].*$", 1)])


def reverse_cyrillic(table: dict[int, str]) -> dict[int, str]:
    """Latin letters back to the Cyrillic ones that look like them."""
    basic = [*range(0x410, 0x450), 0x401, 0x451]
    return {ord(table[c]): chr(c) for c in reversed(basic) if len(table.get(c, "")) == 1 and table[c].isascii()}


@dataclass
class Script:
    """Undoing letters borrowed from another alphabet."""

    table: dict[int, str]
    cyrillic: dict[int, str]

    def __post_init__(self) -> None:
        """Letters that show their alphabet, as no other has one that looks like them."""
        self.only_latin = {c for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B)]) if ord(c) not in self.cyrillic}
        self.only_other = {c for c in map(chr, range(0x370, 0x590)) if c.isalpha() and not self.table.get(ord(unicodedata.normalize("NFD", c)[0]), "-")[0].isascii() or chr(ord(c)) in "дйжцщшчъыэюбзлДЖЦЩШЧЪЫЭЮБЗЛ"}

    def alphabet(self, text: str) -> str:
        """The text composed, in one width and one alphabet, without invisible characters."""
        if text.isascii():
            return text
        text = unicodedata.normalize("NFKC", text)
        if not text.isprintable() and not _INVISIBLE.isdisjoint(text):
            text = text.translate(_NO_INVISIBLE)
        if _OTHER_ALPHABET.search(text):
            latin, other = sum(map(self.only_latin.__contains__, text)), sum(map(self.only_other.__contains__, text))
            if latin >= other:
                text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(self.table))
            elif _LATIN_LETTER.search(text):
                text = re.sub(r"\w*[A-Za-z]\w*", lambda m: m[0].translate(self.cyrillic) if any(c >= "Ѐ" for c in m[0]) else m[0], text)
        return text

    def plain(self, given: str, clean: bool = False) -> str:
        """The piece in lower case and one alphabet, without names, figures and code words. A clean one has no sign of ``_ANY_MARK``."""
        text = self.alphabet(given)
        if clean and text is given:
            pass
        elif text.isascii() and text.isprintable() and not _ANY_BUT_FIGURES.search(text) and "www." not in text:
            text = " ".join([" " if "0" in w else w for w in FIGURES.sub("0", text).split(" ")])
        else:
            if _SPELT_AT.search(text):
                text = _SPELT_ADDRESS.sub(" ", text)
            text = _NOT_WORDS.sub(" ", text)
        if not text.isupper():
            without, names = _NAMES.subn(" ", text)
            if names and ((words := len(text.split())) < 4 or len(without.split()) > (1 - HEADING_SHARE) * words):
                text = without
        return " ".join(text.lower().split())

    def words_of(self, piece: str) -> str:
        """The plain form of a piece, empty for code and where no word of a language is left."""
        return self.words_without_figures(FIGURES.sub("0", piece))

    def words_without_figures(self, piece: str) -> str:
        """The same for a piece with 0 for each of its numbers."""
        known = self.__dict__.setdefault("_known", {})
        got = known.get(piece)
        if got is None:
            clean = not _ANY_MARK.search(piece) and "www." not in piece
            got = "" if is_code(piece, clean) else self.plain(piece, clean)
            got = got if _WORD.search(got) else ""
            if len(known) >= KNOWN_PIECES:
                known.clear()
            if len(piece) < 500:
                known[piece] = got
        return got

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_known"}


def is_code(piece: str, clean: bool = False) -> bool:
    """Whether a piece is code or a payload rather than a sentence. A clean one has no sign of ``_ANY_MARK``."""
    if (clean or not _ANY_CODE.search(piece)) and not _ANY_SQL.search(piece):
        return False
    if _CODE.search(piece):
        return True
    letters = sum(map(str.isalpha, piece))
    return len(_CODE_MARKS.findall(piece)) > 0.3 * letters


def pieces_of(text: str) -> list[tuple[int, int]]:
    """Start and end of the sentences and lines of a text; an abbreviation ends no sentence."""
    out: list[tuple[int, int]] = []
    at, size, search = 0, len(text), _END.search
    while at < size:
        if text[at] == "\n":
            at += 1
            continue
        m = search(text, at + 1)
        end = m.end() if m else size
        if m and text[end - 1] == "\n":
            end -= 1
        if out and out[-1][1] == at and text[at - 1] == "." and _SHORT.search(text, max(out[-1][0], at - 8), at):
            out[-1] = (out[-1][0], end)
        elif not text[at:end].isspace():
            out.append((at, end))
        at = end
    return out


def _grams(data: np.ndarray, begins: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order k: the numbers of the k+1 bytes that end at each position, and whether they lie within one piece."""
    at = np.arange(len(data))
    depth = at - begins
    key = data.astype(np.uint64)
    for k in range(order + 1):
        if k:
            moved = np.zeros_like(key)
            moved[k:] = data[:-k] if k < len(data) else 0
            key = key | (moved.astype(np.uint64) << np.uint64(8 * k))
        yield key.copy(), depth >= max(k, 1)


def _packed(pieces: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all pieces, each after one blank that is context only; where each byte's piece begins; and where pieces begin."""
    blobs = [b" " + p.encode("utf-8", "replace") for p in pieces]
    sizes = np.array([len(b) for b in blobs], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    return np.frombuffer(b"".join(blobs), dtype=np.uint8), np.repeat(starts, sizes), starts


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys are in the sorted table, and whether they are there."""
    where = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return where, (table[where] == keys) if len(table) else np.zeros(len(keys), bool)


def _low(keys: np.ndarray, k: int) -> np.ndarray:
    """The last k+1 bytes of windows."""
    return keys & np.uint64((1 << (8 * k + 8)) - 1)


def windows(pieces: Iterable[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of pieces that aren't empty, the number of it and the ``order`` bytes before it; and where pieces begin."""
    data, begins, starts = _packed(pieces)
    depth = np.arange(len(data)) - begins
    key = data.astype(np.uint64)
    for k in range(1, order + 1):
        moved = np.full(len(data), BEFORE, np.uint64)
        moved[k:] = data[:-k]
        moved[depth < k] = BEFORE
        key |= moved << np.uint64(8 * k)
    return key[depth > 0], starts - np.arange(len(starts))


def distinct_windows(pieces: Iterable[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows of pieces, sorted; which of them each byte has; and where pieces begin."""
    keys, starts = windows(pieces, order)
    return *np.unique(keys, return_inverse=True), starts


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of each one's numbers."""
    if not len(keys):
        return keys, n
    at = np.argsort(keys)
    keys = keys[at]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[at], first)


def of_all_orders(keys: np.ndarray, n: np.ndarray, order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """How often the n-grams of every order are there, from counts of windows of the highest."""
    out = []
    for k in range(order + 1):
        low = _low(keys, k)
        within = low >> np.uint64(8 * k) != BEFORE
        out.append(summed(low[within], n[within]))
    return out


class Model:
    """Frozen context trees of several languages."""

    def __init__(self, languages: list[str], grams: list, contexts: list) -> None:
        self.languages, self.grams, self.contexts = languages, grams, contexts

    @classmethod
    def votes(cls, labelled: list[tuple[str, str]], order: int = ORDER) -> Model:
        """A model whose "code length" is -log2 of the label's share of an n-gram, for correcting labels: a wrong label is outvoted
        wherever its n-grams mostly carry another one."""
        return cls.votes_of(*cls._counted(labelled, order), order)

    @classmethod
    def votes_of(cls, languages: list[str], counted: list, order: int = ORDER) -> Model:
        """The same from counts: for each language and order the n-grams, sorted, and how often they are there."""
        grams, contexts = [], []
        for k in range(order + 1):
            keys = np.unique(np.concatenate([c[k][0] for c in counted]))
            n = np.full((len(keys), len(languages)), 0.5)
            for i, c in enumerate(counted):
                n[np.searchsorted(keys, c[k][0]), i] += c[k][1]
            n /= n.sum(axis=1, keepdims=True)
            grams.append((keys, -np.log2(n, out=n).astype(np.float32)))
            contexts.append((np.zeros(0, np.uint64), np.zeros((0, len(languages)), np.float32)))
        return cls(languages, grams, contexts)

    @staticmethod
    def _counted(labelled: list[tuple[str, str]], order: int) -> tuple[list[str], list]:
        languages = sorted({lang for _, lang in labelled})
        counted = []
        for lang in languages:
            data, begins, _ = _packed(p for p, x in labelled if x == lang)
            counted.append([np.unique(key[ok], return_counts=True) for key, ok in _grams(data, begins, order)])
        return languages, counted

    @classmethod
    def fit(cls, labelled: list[tuple[str, str]], order: int = ORDER) -> Model:
        return cls.of_counts(*cls._counted(labelled, order), order)

    @classmethod
    def of_counts(cls, languages: list[str], counted: list, order: int = ORDER) -> Model:
        """The trees of n-grams that are counted already, as ``votes_of`` takes them."""
        grams, contexts, below = [], [], None
        for k in range(order + 1):
            keys = np.unique(np.concatenate([c[k][0] for c in counted])) if counted else np.zeros(0, np.uint64)
            ctx = np.unique(keys >> np.uint64(8))
            cost = np.zeros((len(keys), len(languages)), np.float32)
            escape = np.zeros((len(ctx), len(languages)), np.float32)
            if below is None:
                lower = np.full((len(keys), len(languages)), 8, np.float32)
            else:
                lower = below[1][_at(below[0], keys & np.uint64((1 << (8 * k)) - 1))[0]] if len(keys) else cost
            for i, c in enumerate(counted):
                own, n = c[k]
                own_ctx, first = np.unique(own >> np.uint64(8), return_index=True)
                total = np.add.reduceat(n, first) if len(own) else np.zeros(0)
                kinds = np.diff(np.append(first, len(own)))
                where, there = _at(own_ctx, ctx)
                if len(own):
                    escape[:, i] = np.where(there, np.log2(2 * total[where] / kinds[where]), 0)
                in_ctx = np.searchsorted(ctx, keys >> np.uint64(8))
                cost[:, i] = lower[:, i] + escape[in_ctx, i]
                seen = np.searchsorted(keys, own)
                all_of = total[np.searchsorted(own_ctx, own >> np.uint64(8))] if len(own) else total
                cost[seen, i] = np.log2(2 * all_of / (2 * n - 1)) if len(own) else 0
            grams.append((keys, cost))
            contexts.append((ctx, escape))
            below = (keys, cost)
        return cls(languages, grams, contexts)

    def bits(self, pieces: list[str]) -> np.ndarray:
        """The code length of each piece under each language."""
        out = np.zeros((len(pieces), len(self.languages)), np.float64)
        group: list[int] = []
        size = 0
        for i, p in enumerate(pieces):
            group.append(i)
            size += len(p)
            if size > CHUNK or i == len(pieces) - 1:
                out[group] = self._bits([pieces[j] for j in group])
                group, size = [], 0
        return out

    def known_bits(self, pieces: list[str]) -> tuple[np.ndarray, list[int]]:
        """``bits``, and the numbers of words, of distinct pieces, each looked up once as long as the worker keeps it."""
        known = self.__dict__.setdefault("_known", {})
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > KNOWN_BITS:
            known.clear()
            new = pieces
        known.update(zip(new, zip(self.bits(new), (len(_WORD.findall(p)) for p in new), strict=True), strict=True))
        got = [known[p] for p in pieces]
        return np.array([b for b, _ in got]).reshape(len(pieces), len(self.languages)), [n for _, n in got]

    def __getstate__(self) -> dict:
        """Without what a worker keeps."""
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def bits_of_windows(self, distinct: np.ndarray, where: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The code length of pieces read as ``distinct_windows``, each distinct window looked up once."""
        cost = np.zeros((len(distinct), len(self.languages)), np.float32)
        todo = np.arange(len(distinct))
        for k in range(len(self.grams) - 1, -1, -1):
            key = _low(distinct[todo], k)
            within = key >> np.uint64(8 * k) != BEFORE
            at, hit = _at(self.grams[k][0], key)
            hit &= within
            cost[todo[hit]] += self.grams[k][1][at[hit]]
            missed = within & ~hit
            if k:
                ctx_at, ctx_hit = _at(self.contexts[k][0], key >> np.uint64(8))
                ctx_hit &= missed
                cost[todo[ctx_hit]] += self.contexts[k][1][ctx_at[ctx_hit]]
            else:
                cost[todo[missed]] += 8 + (self.contexts[0][1][0] if len(self.contexts[0][1]) else 0)
            todo = todo[~hit]
        out = np.zeros((len(starts), len(self.languages)))
        if len(starts):
            each = np.empty(len(where))
            for i, own in enumerate(np.ascontiguousarray(cost.T, dtype=np.float64)):  # one language at a time stays in the processor's cache
                out[:, i] = np.add.reduceat(np.take(own, where, out=each, mode="clip"), starts)
        return out

    def _bits(self, pieces: list[str]) -> np.ndarray:
        data, begins, starts = _packed(pieces)
        cost = np.zeros((len(data), len(self.languages)), np.float32)
        by_order = list(_grams(data, begins, len(self.grams) - 1))
        todo = np.flatnonzero(by_order[0][1])
        for k in range(len(self.grams) - 1, -1, -1):
            key, ok = by_order[k]
            usable = todo[ok[todo]]
            where, hit = _at(self.grams[k][0], key[usable])
            cost[usable[hit]] += self.grams[k][1][where[hit]]
            missed = usable[~hit]
            if k and len(missed):
                ctx_at, ctx_hit = _at(self.contexts[k][0], key[missed] >> np.uint64(8))
                cost[missed[ctx_hit]] += self.contexts[k][1][ctx_at[ctx_hit]]
            elif len(missed):
                cost[missed] += 8 + (self.contexts[0][1][0] if len(self.contexts[0][1]) else 0)
            done = np.zeros(len(data), bool)
            done[usable[hit]] = True
            todo = todo[~done[todo]]
        return np.add.reduceat(cost.astype(np.float64), starts, axis=0) if len(pieces) else np.zeros((0, len(self.languages)))


def script_of(spark: SparkSession) -> Script:
    table = confusables.prototypes(spark)
    return Script({k: v for k, v in table.items() if v}, reverse_cyrillic(table))


def sample_labelled(df: DataFrame, id_col: str, text_col: str, label: Column, rows: int = FIT_ROWS) -> list[tuple[str, str]]:
    """About ``rows`` (text, label), taken by the hash of the id, with repeats.

    All labels are taken at the same rate: taking more of rare labels would take more of the rows that carry them by
    mistake. The count costs a scan of the label only; the sample is bounded by ``rows`` and is what reaches the driver.
    """
    n = df.filter(label.isNotNull()).count()
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    kept = df.select(F.col(text_col).alias("_text"), label.alias("_label"), chance.alias("_chance")).filter("_label IS NOT NULL AND _text IS NOT NULL")
    picked = kept.filter((F.col("_chance") < rows / max(n, 1)) & (F.length("_text") <= FIT_CHARS))
    # more than twice as many come only where ids repeat; then those of the smallest hashes stay
    return sorted((r["_text"], r["_label"]) for r in picked.orderBy("_chance", "_text", "_label").limit(2 * rows).select("_text", "_label").collect())


Halves = tuple[list[tuple[str, str]], list[tuple[str, str]]]


def labelled_pieces(script: Script, labelled: list[tuple[str, str]], order: int = ORDER) -> Halves:
    """Two halves of (plain piece, language) from labels that may be wrong and from texts that may mix languages.

    Pieces first take their text's label, which ``corrected`` then corrects. Labels without a piece of their own vanish.
    """
    halves: Halves = ([], [])
    for n, (text, lang) in enumerate(labelled):
        for a, b in pieces_of(text):
            if plain := script.words_of(text[a:b]):
                halves[(n * 2654435761 >> 7) % 2].append((plain, lang))
    return corrected(halves, order)


def corrected(halves: Halves, order: int = ORDER) -> Halves:
    """The halves, each labelled by the votes of the other one's n-grams, so that no piece votes for itself, until no label changes or for ``LABEL_ROUNDS`` rounds."""
    for _ in range(LABEL_ROUNDS):
        if not all(halves):
            break
        models = [Model.votes(h, order) for h in halves]
        before, halves = halves, tuple([*_relabelled(h, m)] for h, m in zip(halves, reversed(models), strict=True))
        if before == halves:
            break
    return halves


def count_pieces(texts: DataFrame, script: Script) -> DataFrame:
    """(half, piece, lang, n): how often the plain pieces of all (id, text, lang) are there, a row's pieces all in the half of its hash.

    Tasks count before anything is shuffled. The result is written as a table, as every round of correcting reads it.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(script)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = shared.value
        held: dict[tuple, int] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*k, n) for k, n in held.items()], columns=["half", "piece", "lang", "n"])

        for batch in batches:
            for text, lang, half in zip(batch["text"].tolist(), batch["lang"].tolist(), batch["half"].tolist(), strict=True):
                text = FIGURES.sub("0", text)  # no piece begins or ends by a number
                for a, b in pieces_of(text):
                    if piece := plain.words_without_figures(text[a:b]):
                        key = (half, piece, lang)
                        held[key] = held.get(key, 0) + 1
            if len(held) > HELD // 10:
                yield out()
                held.clear()
        yield out()

    rows = texts.select("text", "lang", F.pmod(F.xxhash64("id", "text"), F.lit(2)).cast("int").alias("half")).filter("text IS NOT NULL")
    counted = rows.mapInPandas(run, "half int, piece string, lang string, n bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = cut(counted.repartition(parts, "piece").groupBy("half", "piece", "lang").agg(F.sum("n").alias("n")))
    shared.destroy()
    return out


def sum_windows(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of (key, n), sorted, and their sums. What reaches the driver grows with the different windows, not with the rows."""
    got = counted.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return summed(got["key"].to_numpy().view(np.uint64), got["n"].to_numpy())


def hold_windows(counted: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    """Counts of windows as rows (key, n), brought together in the task as far as it can hold them."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

    for keys, n in counted:
        held.append((keys, n))
        size += len(keys)
        if size > HELD:
            held = [out()]
            size = len(held[0][0])
            if size > HELD // 2:
                yield pd.DataFrame({"key": held[0][0].view(np.int64), "n": held[0][1]})
                held, size = [], 0
    if held:
        keys, n = out()
        yield pd.DataFrame({"key": keys.view(np.int64), "n": n})


@dataclass
class Chunk:
    """Pieces of one half: the numbers of their languages, less than 0 for none; how often each is there; their distinct windows, which of them each byte has, and where pieces begin."""

    half: int
    lang: np.ndarray
    n: np.ndarray
    distinct: np.ndarray
    where: np.ndarray
    starts: np.ndarray


#: The labels of a chunk's pieces as numbers of languages, less than 0 for none.
Labels = Callable[[Chunk], np.ndarray]
Counts = list[list[tuple[np.ndarray, np.ndarray]]]
_WINDOW_BITS = np.uint64(8 * ORDER + 8)
#: The columns of a chunk that is a row, and the numbers that their bytes are.
_CHUNK_TYPES = {"lang": np.int16, "n": np.int64, "distinct": np.uint64, "sizes": np.uint32}


def _place(distinct: np.ndarray) -> type:
    return np.uint16 if len(distinct) <= 1 << 16 else np.uint32


def _chunks(batches: Iterator[pd.DataFrame], languages: list[str], size: int = CHUNK) -> Iterator[Chunk]:
    """Rows of ``read_windows``, or of pieces: then about ``size`` characters of one half at once."""
    number = {lang: i for i, lang in enumerate(languages)}
    for batch in batches:
        if "piece" not in batch:
            for half, where, *parts in zip(batch["half"].tolist(), batch["at"], *(batch[c] for c in _CHUNK_TYPES), strict=True):
                lang, n, distinct, sizes = (np.frombuffer(x, t) for x, t in zip(parts, _CHUNK_TYPES.values(), strict=True))
                yield Chunk(half, lang, n, distinct, np.frombuffer(where, _place(distinct)).astype(np.intp), np.cumsum(sizes, dtype=np.intp) - sizes)
            continue
        for half, of_half in batch.groupby("half"):
            part = of_half["piece"].str.len().cumsum().to_numpy() // size
            ends = [0, *(np.flatnonzero(np.diff(part)) + 1), len(of_half)]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                rows = of_half.iloc[a:b]
                lang = np.array([number.get(x, -1) for x in rows["lang"].tolist()], np.int16)
                yield Chunk(int(half), lang, rows["n"].to_numpy(), *distinct_windows(rows["piece"]))


def read_windows(pieces: DataFrame, languages: list[str]) -> DataFrame:
    """The chunks of pieces as rows of a table, so that the rounds of correcting don't read the texts again."""
    size = READ_CHUNK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in _chunks(batches, languages, size):
            parts = (c.lang, c.n, c.distinct, np.diff(np.append(c.starts, len(c.where))))
            yield pd.DataFrame({"half": [c.half], "at": [c.where.astype(_place(c.distinct)).tobytes()]} | {k: [x.astype(t).tobytes()] for (k, t), x in zip(_CHUNK_TYPES.items(), parts, strict=True)})

    return cut(pieces.mapInPandas(run, "half int, at binary, " + ", ".join(f"{c} binary" for c in _CHUNK_TYPES)), READ_ROWS)


def count_windows(pieces: DataFrame, languages: list[str], labels: Labels) -> Counts:
    """For each half and language the windows and how often they are there, with each piece, of ``count_pieces`` or ``read_windows``, labelled by ``labels``."""
    shared = pieces.sparkSession.sparkContext.broadcast(labels)
    width = len(languages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def counted() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for c in _chunks(batches, languages):
                label = shared.value(c).astype(np.intp)
                size, sizes = len(c.distinct), np.diff(np.append(c.starts, len(c.where)))
                # what has no label goes to a language behind the last one
                cells = np.repeat(np.where(label < 0, width, label) * size, sizes) + c.where
                n = np.bincount(cells, np.repeat(c.n.astype(np.float64), sizes), (width + 1) * size)[: width * size].reshape(width, size)
                for i in np.unique(label[label >= 0]):
                    there = np.flatnonzero(n[i])
                    yield c.distinct[there] | np.uint64(c.half * width + i) << _WINDOW_BITS, n[i][there].astype(np.int64)

        return hold_windows(counted())

    keys, n = sum_windows(pieces.mapInPandas(run, "key bigint, n bigint"))
    shared.destroy()
    ends = np.searchsorted(keys >> _WINDOW_BITS, np.arange(2 * width + 1))
    each = [(_low(keys[a:b], ORDER), n[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [each[:width], each[width:]]


@dataclass
class AsLabelled:
    languages: list[str]

    def __call__(self, chunk: Chunk) -> np.ndarray:
        return chunk.lang


@dataclass
class AsVoted:
    """By the votes of the other half."""

    votes: list[Model]

    def __call__(self, chunk: Chunk) -> np.ndarray:
        return self.votes[1 - chunk.half].bits_of_windows(chunk.distinct, chunk.where, chunk.starts).argmin(axis=1)


def corrected_counts(pieces: DataFrame, languages: list[str], counts: Counts) -> Counts:
    """What ``corrected`` does, for pieces that are rows. ``counts`` are those of their labels so far.

    Votes depend on the counts alone, and so do the next labels: where a round leaves the counts as they were, no further one changes a label.
    """
    for _ in range(LABEL_ROUNDS):
        if not all(any(len(keys) for keys, _ in half) for half in counts):
            break
        votes = [Model.votes_of(languages, [of_all_orders(*c) for c in half]) for half in counts]
        before, counts = counts, count_windows(pieces, languages, AsVoted(votes))
        if all(np.array_equal(a, b) for old, new in zip(before, counts, strict=True) for x, y in zip(old, new, strict=True) for a, b in zip(x, y, strict=True)):
            break
    return counts


def model_of(languages: list[str], counts: Counts) -> Model:
    """The trees of both halves; a language without a piece vanishes."""
    both = [summed(*map(np.concatenate, zip(*c, strict=True))) for c in zip(*counts, strict=True)]
    used = [i for i, (keys, _) in enumerate(both) if len(keys)]
    return Model.of_counts([languages[i] for i in used], [of_all_orders(*both[i]) for i in used])


def fit(spark: SparkSession, labelled: list[tuple[str, str]], order: int = ORDER) -> tuple[Model, Script]:
    """A model from labels that may be wrong and from texts that may mix languages."""
    script = script_of(spark)
    one, other = labelled_pieces(script, labelled, order)
    return Model.fit(one + other, order), script


@dataclass
class AsAdapted:
    """The languages that a model gives the pieces of texts of another kind.

    A language in use may win any piece; any other has only the pieces that it wins surely itself. Fitting once more with these labels takes a model to the
    wording of texts that nobody labelled.
    """

    model: Model
    number: np.ndarray
    used: np.ndarray
    sure_bits: float

    def scored(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' code lengths, and which are won surely."""
        bits = self.model.bits_of_windows(chunk.distinct, chunk.where, chunk.starts)
        if bits.shape[1] < 2:
            return bits, np.ones(len(bits), bool)
        ranked = np.partition(bits, 1, axis=1)
        return bits, ranked[:, 1] - ranked[:, 0] >= self.sure_bits

    def __call__(self, chunk: Chunk) -> np.ndarray:
        if not self.used.any():
            return np.full(len(chunk.n), -1)
        bits, sure = self.scored(chunk)
        return self.number[np.where(self.used | sure[:, None], bits, np.inf).argmin(axis=1)]


def as_adapted(model: Model, languages: list[str], pieces: DataFrame, least_share: float = 0.02, sure_bits: float = 40.0) -> AsAdapted:
    """A language is in use if it wins at least ``least_share`` of all the pieces that are won by ``sure_bits``."""
    number = np.array([languages.index(x) for x in model.languages], np.int64)
    won = np.zeros(len(number))
    out = AsAdapted(model, number, won > 0, sure_bits)
    if len(number):
        shared = pieces.sparkSession.sparkContext.broadcast(out)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for c in _chunks(batches, languages):
                bits, sure = shared.value.scored(c)
                yield pd.DataFrame({"lang": bits.argmin(axis=1)[sure], "n": c.n[sure]})

        for r in pieces.mapInPandas(run, "lang int, n bigint").groupBy("lang").agg(F.sum("n").alias("n")).collect():
            won[r["lang"]] = r["n"]
        shared.destroy()
    out.used = (won > 0) & (won >= least_share * won.sum())
    return out


def _relabelled(pieces: list[tuple[str, str]], model: Model) -> Iterator[tuple[str, str]]:
    """The pieces with the language that the votes of pieces which aren't among them give them."""
    texts, langs = sorted({p for p, _ in pieces}), model.languages
    best = {t: langs[j] for t, j in zip(texts, model.bits(texts).argmin(axis=1), strict=True)}
    return ((p, best[p]) for p, _ in pieces)


def _path(bits: np.ndarray) -> np.ndarray:
    """The cheapest languages of consecutive pieces, with a price for each change."""
    best = bits.argmin(axis=1)
    if (best == best[0]).all():
        return best
    total, back = bits[0].copy(), []
    for row in bits[1:]:
        low = int(total.argmin())
        change = total[low] + SWITCH_BITS < total
        back.append(np.where(change, low, np.arange(len(row))))
        total = np.where(change, total[low] + SWITCH_BITS, total) + row
    path = [int(total.argmin())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1])


SEGMENT = "struct<start_pos:bigint,length:bigint,lang:string,confidence:double,words:int,margin:double>"


def segments_of(texts: list[str | None], model: Model, script: Script) -> list[list[dict] | None]:
    """For each text its stretches in one language, in order; pieces without words join their neighbours."""
    spans = [pieces_of(t) if t else [] for t in texts]
    plains: dict[str, int] = {}
    index: list[list[int]] = []
    for text, found in zip(texts, spans, strict=True):
        row = []
        for n, (a, b) in enumerate(found):
            piece = text[a:b]
            plain = script.words_of(piece)
            if plain and n and text[found[n - 1][1] - 1] == "," and _SIGNATURE.fullmatch(piece):
                plain = ""
            row.append(plains.setdefault(plain, len(plains)) if plain else -1)
        index.append(row)
    known = list(plains)
    bits, words = model.known_bits(known)
    best = bits.argmin(axis=1) if len(known) and model.languages else np.zeros(0, int)
    out: list[list[dict] | None] = []
    every: list[dict] = []
    for text, found, row in zip(texts, spans, index, strict=True):
        if text is None:
            out.append(None)
            continue
        real = [i for i, j in enumerate(row) if j >= 0]
        if not real or not model.languages:
            out.append([])
            continue
        own = [row[i] for i in real]
        path = [int(best[own[0]])] * len(own) if len({int(best[j]) for j in own}) == 1 else _path(bits[own])
        segments: list[dict] = []
        last = None
        for i, j, lang in zip(real, own, path, strict=True):
            if lang == last:
                segments[-1]["_end"] = found[i][1]
                segments[-1]["words"] += words[j]
                segments[-1]["_pieces"].append(j)
            else:
                segments.append({"_start": found[i][0], "_end": found[i][1], "words": words[j], "_pieces": [j], "_lang": lang})
            last = lang
        out.append(segments)
        every += segments
    if every:
        total = np.array([bits[s["_pieces"]].sum(axis=0) if len(s["_pieces"]) > 1 else bits[s["_pieces"][0]] for s in every])
        at = np.arange(len(every))
        won = np.array([s["_lang"] for s in every])
        own_bits = total[at, won]
        others = total.copy()
        others[at, won] = np.inf
        margin = np.minimum(others.min(axis=1) - own_bits, 1e6) if total.shape[1] > 1 else np.full(len(every), 99.0)
        confidence = 1 / np.exp2(np.clip(own_bits[:, None] - total, -60, 60) / 2).sum(axis=1)
        for n, s in enumerate(every):
            start, end = s.pop("_start"), s.pop("_end")
            del s["_pieces"], s["_lang"]
            s.update(start_pos=start + 1, length=end - start, lang=model.languages[won[n]], confidence=float(confidence[n]), margin=float(margin[n]))
    return out


def segments_column(text: Column, spark: SparkSession, fitted: tuple[Model, Script]) -> Column:
    """The stretches of a text column: NULL for NULL, empty for texts without words of a language."""
    shared = spark.sparkContext.broadcast(fitted)

    @F.pandas_udf(f"array<{SEGMENT}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, script = shared.value
        for texts in batches:
            values = [t if isinstance(t, str) else None for t in texts]
            got: list = []
            for i in range(0, len(values), 1000):
                got += segments_of(values[i : i + 1000], model, script)
            yield pd.Series(got, dtype=object)

    # not to be run again, or before a repartition, for a filter on its result
    return run.asNondeterministic()(text)


def identify(df: DataFrame, id_col: str, text_col: str, label_col: str, fitted: tuple[Model, Script]) -> DataFrame:
    """(id, label, segments): each text's stretches, their language and its confidence, and the language its label names.

    ``confidence`` is the posterior of the language under equal priors at half the code length, as neighbouring bytes are not independent. NULL texts have NULL segments; empty, blank
    and code-only texts an empty array. Every row is kept, with any other columns ignored.
    """
    return df.select(
        F.col(id_col).alias("id"),
        code_column(F.col(label_col)).alias("label"),
        segments_column(F.col(text_col), df.sparkSession, fitted).alias("segments"),
    )


def wrong_or_mixed(identified: DataFrame, min_words: int = 2, min_margin: float = SWITCH_BITS) -> DataFrame:
    """(id, lang): the language of a text whose label is missing or names another, and every language of a mixed one.

    A stretch counts as sentences of its language from ``min_words`` words and ``min_margin`` bits before the next language on; a text's
    longest stretch counts from 8 bits on, so that short messages have a language too.
    """
    counted = F.filter("segments", lambda s: (s["words"] >= min_words) & (s["margin"] >= min_margin))
    longest = F.slice(F.array_sort(F.filter("segments", lambda s: s["margin"] >= 8), lambda a, b: b["words"] - a["words"]), 1, 1)
    langs = F.array_distinct(F.transform(F.when(F.size(counted) > 0, counted).otherwise(longest), lambda s: s["lang"]))
    kept = identified.select("id", "label", langs.alias("langs")).filter("size(langs) > 1 OR (size(langs) = 1 AND NOT (label <=> langs[0]))")
    return kept.select("id", F.explode("langs").alias("lang"))
