"""Defects of prompt and response pairs.

* empty: nothing is left of the response without markup, punctuation, invisible characters, placeholders and mere announcements;
* copy: with the prompt as its zstandard dictionary the response compresses to next to nothing, and so does the prompt with the response as
  dictionary, so the one holds no more than the other. An answer that repeats a part of the prompt, as asked, leaves the rest of the prompt
  uncovered; a question with an answer behind it leaves the answer uncovered;
* refusal: sentences of the refusal dictionaries make up most of the response;
* truncated: a context tree with an end symbol, counted over references and finished responses, gives the end a long code in this place; a full stop at
  the end, of which no mark of omission is left, is an end;
* language: the response's language is neither one of the prompt nor one that the prompt names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenlake.llm import language
from wardenlake.plans.lineage import cut, drop

DEFECTS = ("empty", "copy", "refusal", "truncated", "language")
#: Bytes of compressed response, beyond a frame's own, up to which it holds nothing new; what words before a repeated prompt may take; and up to
#: which the prompt leaves nothing out, but a word.
COPY_BYTES, ANNOUNCED_BYTES, LEFT_BYTES = 14, 28, 21
#: Share of a response that refusing and courteous sentences make up at least.
REFUSAL_SHARE = 0.6
#: Bits of the end symbol from which on a response without a full stop breaks off; for a list, which ends in any item, it takes more.
END_BITS, LISTED_BITS = 6.5, 15.0
END_ORDER = 7
#: Bits by which another language must win.
LANGUAGE_BITS = 16.0

# Placeholders that say nothing.
PLACEHOLDERS = set("null none nil nan n/a na tbd todo undefined empty blank placeholder answer response output text leer vide vacío".split())
PLACEHOLDERS |= {"lorem ipsum", "no answer", "no response", "no data", "to be completed", "n.a", "keine angabe", "keine antwort", "k.a", "sans objet", "sans réponse", "s.o", "sin respuesta", "sin datos"}
#: A note in brackets in place of an answer.
_NOTE = re.compile(r"^[\[(<{][^\d\])>}]*\b(?:answer|response|text|insert|here|antwort|einfügen|hier|réponse|insérer|ici|respuesta|insertar|aquí)\b[^\d\])>}]*[\])>}]$", re.I)
#: Words before an answer that doesn't come.
_ANNOUNCED = re.compile(
    r"^(?:(?:sure|okay|ok|of course|certainly|klar|gerne|natürlich|bien sûr|d'accord|claro|por supuesto)(?: thing)?[ ,:!.-]*)?(?:(?:here(?:'s| is)|hier (?:ist|kommt)|voici|aquí (?:está|tiene|tienes|va)) (?:the |my |your |an? |die |meine |eine |ma |la |votre |une |mi |su |tu )?(?:short |kurze |courte )?(?:answer|response|reply|antwort|réponse|respuesta)"
    r"|let me (?:explain|think|check|see)|let's see|lass mich (?:nachdenken|erklären)|laissez-moi (?:réfléchir|expliquer)|déjame (?:pensar|explicar))?$"
)
# Sentences that announce an answer and hold none.
ANNOUNCEMENTS = set(
    """short answer first|here is what i found|here is the answer|here you go|good question|great question|in short|sure|of course|certainly|sure, here is the answer|let me see|okay|ok
kurz gesagt|das habe ich gefunden|gute frage|hier ist die antwort|natürlich|gerne|klar
en bref|voici ce que j'ai trouvé|bonne question|voici la réponse|bien sûr|d'accord
en resumen|esto es lo que encontré|buena pregunta|aquí está la respuesta|claro|por supuesto|desde luego""".replace("\n", "|").split("|")
)
# The refusal dictionaries, in English, German, French and Spanish.
_REFUSALS = [
    r"\b(?:i|we) (?:can(?:not|'t| not)|could not|couldn't|won't|will not|am (?:not able|unable)|'m (?:not able|unable)|am not (?:allowed|permitted|in a position)|'m not (?:allowed|permitted|in a position)|must|have to|would rather not|do not wish|don't want|may not)(?: be able)?(?: to)? (?:\w+ )?(?:answer|help|assist|share|comply|discuss|provide|comment|do that|do this|respond|reply|decline|refuse|say|talk|go into|fulfil+|complete (?:this|that|your)|pass on)\b",
    r"\bi (?:am|'m) (?:un|not )able to (?:comply|share|help|answer|assist|do that|discuss)",
    r"\b(?:i|we) (?:won't|will not) be able to do (?:that|this|it)",
    r"\b(?:i|we) (?:must|have to) (?:decline|refuse|pass on this)",
    r"\b(?:i|we) (?:decline|refuse) to\b|\bi must decline\b",
    r"\bi(?:'d| would) rather (?:not|leave this)",
    r"\bnot something (?:i|we) can (?:assist|help|answer|discuss|do)",
    r"\bdo(?:n't| not) feel comfortable\b",
    r"\b(?:beyond|outside)(?: of)? what (?:i|we)(?:'m| am| are)? (?:may|can|allowed)",
    r"\b(?:instructions|guidelines|rules|polic(?:y|ies)) (?:keep|prevent|forbid|prohibit|do(?:n't| not) (?:permit|allow))",
    r"\bbreak (?:the|my) rules\b|\bagainst (?:my|the|our) (?:rules|guidelines|policy|policies)",
    r"\byou(?:'ll| will) need to ask (?:someone|somebody) else",
    r"\bas an? (?:ai|assistant|language model)\b.*\b(?:not|can't|cannot|unable)\b",
    r"\bich (?:muss|möchte|kann|darf|werde|will) .*\b(?:ablehnen|nicht (?:äußern|helfen|beantworten|sagen|antworten|nachkommen))",
    r"\b(?:darauf|dazu|dabei|damit|hierzu|das|diese \w+|dies) (?:kann|darf|möchte|will|werde) ich (?:mich |leider )?(?:nicht|nichts|keine)\b",
    r"\bkann ich (?:leider )?nicht (?:helfen|beantworten|antworten)|\b(?:bin|ist es mir) (?:ich )?(?:leider )?nicht (?:befugt|berechtigt|in der lage|gestattet|erlaubt|möglich)",
    r"\bnicht in (?:meinen|meinem) (?:aufgabenbereich|zuständigkeit)|\bwenden sie sich (?:bitte )?an (?:eine|die|jemand)|\bmuss (?:ich )?(?:diese \w+ )?ablehnen|\bverweiger\w* ich",
    r"\bje (?:ne )?(?:peux|puis|suis|dois|préfère|refuse|m'abstien)\w*\b.*\b(?:pas|décliner|refuser|ne pas)\b.*\b(?:répondre|aider|autorisé|demande|prononcer|partager|commenter|mesure|requête)|\bje dois (?:décliner|refuser)|\bje préfère ne pas",
    r"\bje ne (?:peux|puis) pas (?:vous|t'|y |répondre|aider|donner|partager)|\bje ne suis pas (?:autorisé|en mesure|habilité)",
    r"\bdépasse ce que j|\bmieux vaut vous adresser|\badressez-vous à (?:quelqu|une autre)",
    r"\bno (?:puedo|podemos|me es posible|tengo permiso|estoy autorizad\w|me está permitido|debo)\b.*\b(?:responder|ayudar|compartir|contestar|comentar|decir|eso|hacer|respond)",
    r"\bno tengo permiso|\bdebo (?:rechazar|declinar)|\bprefiero no (?:pronunciarme|responder|contestar|comentar)|\bfuera de lo que (?:me|se me) está permitido|\bmejor que consulte a otra",
]
# Refusals put together from who, what one can't, won't or mustn't do, and acts of answering.
_ACTS = {
    "en": "answer|help|assist|share|discuss|comment|provide|disclose|reveal|comply|respond|reply|fulfil+|talk|speak|go into",
    "de": "helfen|geben|sagen|beantworten|antworten|teilen|nennen|verraten|äußern|mitteilen|sprechen|herausgeben|erfüllen|nachkommen|weitergeben",
    "fr": "répondre|aider|dire|donner|partager|parler|commenter|fournir|communiquer|révéler|accéder",
    "es": "responder|contestar|ayudar|decir|compartir|hablar|comentar|facilitar|proporcionar|dar|revelar",
}
_RULES = {"en": "polic(?:y|ies)|guidelines|rules|instructions|principles", "de": "richtlinien|regeln|vorgaben|anweisungen", "fr": "consignes|règles|directives|instructions", "es": "reglas|normas|instrucciones|directrices|políticas"}
_REFUSALS += [
    rf"\b(?:i|we) (?:can(?:not|'t| not)|won't|will not|would(?:n't| not)|should(?:n't| not)|may not|must not|do(?:n't| not) (?:think|believe|wish|want)(?: (?:i|we|that|to|can|should|may))*)\b[^,;]{{0,25}}?\b(?:{_ACTS['en']})\b",
    r"\b(?:i|we)(?:'m| am|'re| are) (?:not|un) ?(?:permitted|allowed|authori[sz]ed|able|willing|in a position) to (?:\w+ )?(?:that|this|it|share|answer|say|discuss|help|provide|comment|disclose|speak)\b|\b(?:something|anything|that) (?:i|we)(?:'m| am|'re| are) not (?:permitted|allowed|authori[sz]ed|able|willing) to\b",
    r"\b(?:i|we)(?:'d| would) (?:rather|prefer) not(?: to)?\b",
    r"\b(?:not|n't) (?:a question|a topic|a request|something|anything) (?:that )?(?:i|we) (?:can|may|will|am able to|are able to)\b",
    r"\b(?:i|we) (?:have to|must|need to|will have to) (?:\w+ly )?(?:decline|refuse|pass on|reject|turn (?:this|that|it|your \w+) down)",
    rf"\b(?:against|violates?|contrary to) (?:my|our) (?:{_RULES['en']})|\b(?:my|our) (?:{_RULES['en']})\b.{{0,30}}\b(?:not (?:allow|permit)|forbid|prohibit|prevent|keep)",
    r"^no comment\b",
    rf"\b(?:ich|wir) (?:kann|darf|möchte|will|werde|können|dürfen|möchten|werden)\b[^,;]{{0,60}}\b(?:nicht|keine\w*)\b[^,;]{{0,40}}\b(?:{_ACTS['de']})\b|\b(?:kann|darf|möchte|will|werde) ich\b[^,;]{{0,40}}\b(?:nicht|nichts|keine\w*)\b[^,;]{{0,30}}\b(?:{_ACTS['de']})\b",
    r"\bmuss ich\b[^,;]{0,30}\b(?:ablehnen|zurückweisen|verweigern)|\b(?:das|dies|hier|diese \w+) (?:lehne|verweigere) ich\b|\bich (?:lehne|verweigere) (?:das|dies|es|diese|die)\b",
    rf"\b(?:meine|unsere) (?:{_RULES['de']})\b.{{0,40}}\b(?:nicht|verbieten|untersagen)",
    r"\bil (?:m'est|nous est) (?:impossible|interdit)\b|\bil ne (?:m'est|nous est) pas (?:possible|permis)\b|\bje (?:refuse de|décline)\b|\bje n'ai pas le droit\b|\bje préfère ne (?:pas|rien)\b",
    rf"\bje ne (?:saurais|peux|puis|souhaite|veux|vais)(?: pas)? (?:vous |t'|y |en |rien )?(?:{_ACTS['fr']})\b|\b(?:à l'encontre de|contraire à) (?:mes|nos) (?:{_RULES['fr']})|\b(?:mes|nos) (?:{_RULES['fr']})\b.{{0,30}}\b(?:ne me|ne nous|m'interdisent|interdisent)",
    rf"\bme niego a\b|\bnos negamos a\b|\b(?:tengo que|he de|tenemos que) (?:rechazar|declinar)|\bprefiero no (?:{_ACTS['es']})|\bno (?:voy|vamos) a (?:{_ACTS['es']})|\bno (?:puedo|podemos) (?:{_ACTS['es']})",
    rf"\ben contra de (?:mis|nuestras) (?:{_RULES['es']})|\b(?:mis|nuestras) (?:{_RULES['es']})\b.{{0,30}}\b(?:no me|no nos|prohíben|impiden)",
]
REFUSAL = re.compile("|".join(f"(?:{r})" for r in _REFUSALS), re.I)
COURTESY = re.compile(
    r"^(?:(?:i(?:'m| am) )?(?:very |so )?sorry|i apologi[sz]e|unfortunately|thanks(?: for asking)?|thank you.*|i hope (?:you|that) .*|is there anything else.*|please contact your .*|let me know if .*|(?:es )?tut mir leid|leider|ich bitte um .*|danke.*"
    r"|(?:je suis )?désolé\w*|malheureusement|merci (?:de|pour) .*|lo (?:siento|lamento)|por desgracia|lamentablemente|gracias (?:por .*)?)[\s,.!:?]*$",
    re.I,
)
# Names of the languages in the languages, for prompts that ask for one.
LANGUAGE_WORDS = {
    "en": "english englisch englische englischen anglais anglaise inglés inglesa ingles inglese",
    "de": "german deutsch deutsche deutschen deutscher allemand allemande alemán alemana aleman tedesco",
    "fr": "french französisch französische französischen franzosisch français française francais francés francesa frances francese",
    "es": "spanish spanisch spanische spanischen espagnol espagnole español española espanol castellano spagnolo",
    "it": "italian italienisch italienische italien italiano italiana italienne",
    "pt": "portuguese portugiesisch portugiesische portugais portugués português",
    "nl": "dutch niederländisch niederländische néerlandais holandés neerlandés nederlands",
    "pl": "polish polnisch polnische polonais polaco polski",
    "ru": "russian russisch russische russe ruso русский русском",
    "ja": "japanese japanisch japanische japonais japonés 日本語",
}
_NAMED = {w: code for code, words in LANGUAGE_WORDS.items() for w in words.split()}
# One-word answers of one language or several.
ONE_WORD = {"yes": {"en"}, "no": {"en", "es", "it"}, "ja": {"de", "nl"}, "nein": {"de"}, "oui": {"fr"}, "non": {"fr"}, "sí": {"es"}, "si": {"es", "it"}, "nee": {"nl"}, "não": {"pt"}, "sim": {"pt"}}

_MARKUP = re.compile(r"```\w*|<[^<>]*>|&nbsp;|[*_#>`]")
_CUT = re.compile(r"(?:\s*(?:\.{3,}|…|\[(?:cut|truncated|\.\.\.|…)\]|\((?:cut|truncated)\)))+\s*$", re.I)
#: What ends a sentence of a text in one line.
_SENTENCE_END = re.compile(r"[.!?…][.!?…]*[\"'”»)\]]*(?=\s|$)")
_SPLIT = re.compile(r"(?<=[.!?:])\s+|\n+")
_LETTERS = re.compile(r"\w+")
_DIGIT = re.compile("[1-9]")
#: Sentences that a worker keeps with what they are, and texts with their languages; only speed depends on it.
KNOWN_SENTENCES, KNOWN_TEXTS = 50_000, 20_000
_STOPPED = re.compile(r"[.!?。！？][\"'”»)\]]*\s*$")


class _Kept(dict):
    """A table for ``str.translate`` that asks for each character once and removes those that aren't wanted."""

    def __init__(self, wanted: Callable[[str], bool]) -> None:
        self.wanted = wanted

    def __missing__(self, code: int) -> int | None:
        self[code] = code if self.wanted(chr(code)) else None
        return self[code]


_SEEN = _Kept(lambda c: c.isprintable() or c in "\n\t " or unicodedata.category(c) not in ("Cf", "Cc"))
_BARE = _Kept(lambda c: not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def content(text: str | None) -> str:
    """What a response says: without markup, invisible characters and outer punctuation."""
    plain = text or ""
    if not plain.isascii() or not plain.isprintable():
        plain = unicodedata.normalize("NFKC", plain)
        if not plain.isprintable():
            plain = plain.translate(_SEEN)
    return _MARKUP.sub(" ", plain).strip(" \t\n\r\"'“”«»()[]{}-–—.,;:!?…|/\\")


def is_empty(text: str | None) -> bool:
    return _says_nothing(text, content(text).casefold())


def _says_nothing(text: str | None, plain: str) -> bool:
    if not any(map(str.isalnum, plain)) or plain in PLACEHOLDERS:
        return True
    if _NOTE.match((text or "").strip()):
        return True
    sentences = (s.strip(" .!?:…") for s in _SPLIT.split(plain))
    return all(not s or s in ANNOUNCEMENTS or _ANNOUNCED.match(s) for s in sentences)


def _squeezed(text: str) -> bytes:
    plain = text.casefold()
    if not plain.isascii():
        plain = unicodedata.normalize("NFKD", plain).translate(_BARE)
    return " ".join(_LETTERS.findall(plain)).encode("utf-8", "replace")


def novelty(text: bytes, known: bytes) -> int:
    """Bytes that the text takes when compressed with the known one as dictionary, without the frame's own bytes."""
    if not text:
        return 0
    dictionary = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(known) >= 8 else None
    params = zstandard.ZstdCompressionParameters.from_level(19, source_size=len(text), dict_size=len(known), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=max(10, min(27, (len(text) + len(known)).bit_length())))
    packer = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params) if dictionary else zstandard.ZstdCompressor(compression_params=params)
    return max(0, len(packer.compress(text)) - 5)


def is_copy(prompt: str | None, response: str) -> bool:
    """Whether the response gives the prompt back and nothing else, or a part of it that leaves nothing out but some words."""
    asked, given = _squeezed(prompt or ""), _squeezed(response)
    if len(asked) < 8 or len(given) < 0.5 * len(asked):
        return False
    ends_alike = given.endswith(asked[-12:])
    if not ends_alike and len(given) > len(asked):  # more follows behind the question
        return False
    return novelty(given, asked) <= COPY_BYTES + (ANNOUNCED_BYTES if ends_alike and len(given) > len(asked) else 0) and novelty(asked, given) <= LEFT_BYTES


_known_sentences: dict[str, int] = {}


def _judged(sentence: str) -> int:
    """1 for a refusing sentence, 0 for a courteous one or none, -1 for any other."""
    got = _known_sentences.get(sentence)
    if got is None:
        got = 1 if REFUSAL.search(sentence) else -1 if sentence and not COURTESY.match(sentence) else 0
        if len(_known_sentences) >= KNOWN_SENTENCES:
            _known_sentences.clear()
        if len(sentence) < 500:
            _known_sentences[sentence] = got
    return got


def is_refusal(response: str) -> bool:
    plain = " ".join(unicodedata.normalize("NFKC", response).replace("’", "'").split())
    plain = _DIGIT.sub("0", plain)  # the dictionaries name no digit, so sentences that differ in them only are judged once
    at = refusing = other = 0
    while at < len(plain):
        m = _SENTENCE_END.search(plain, at + 1)
        end = m.end() if m else len(plain)
        s = plain[at:end].strip()
        kind = _judged(s)
        if kind > 0:
            refusing += len(s)
        elif kind < 0:
            other += len(s)
        at = end
    return refusing > 0 and refusing >= REFUSAL_SHARE * (refusing + other)


_NUMBERED = re.compile(r"\b[^\W\d_]++-\d+\b")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")


def _shape(text: str) -> str:
    """The text as the model of endings reads it: in lower case, any number as 9, any numbered name as one."""
    text = _NUMBERED.sub("agent-9", " ".join(text.split()))
    return _NUMBER.sub("9", text).casefold()


def _ending(text: str) -> str:
    return _STOPPED.sub("", _shape(text)).rstrip()


class Endings:
    """A context tree over bytes with an end symbol, which is the byte 0."""

    def __init__(self, texts: list[str]) -> None:
        self.model = language.Model.fit([(_ending(t) + "\0", "any") for t in texts], END_ORDER)

    @classmethod
    def of_counts(cls, keys: np.ndarray, n: np.ndarray) -> Endings:
        """From counts of windows. N-grams that don't end a text are left out, as only the end's code length is asked for."""
        out = cls.__new__(cls)
        out.model = language.Model.of_counts(["any"], [language.of_all_orders(keys, n, END_ORDER)], END_ORDER)
        ends = [grams & np.uint64(255) == 0 for grams, _ in out.model.grams]
        out.model.grams = [(grams[end], cost[end]) for (grams, cost), end in zip(out.model.grams, ends, strict=True)]
        return out

    def bits(self, texts: list[str]) -> np.ndarray:
        """The code length of the end after each text."""
        ended = [_ending(t)[-4 * END_ORDER :] for t in texts]
        return (self.model.bits([e + "\0" for e in ended]) - self.model.bits(ended))[:, 0]


def all_pairs(df: DataFrame, prompt_col: str, response_col: str, reference_col: str) -> DataFrame:
    """The prompts, responses and references of all rows as p, o and e."""
    return df.select(F.col(prompt_col).alias("p"), F.col(response_col).alias("o"), F.col(reference_col).alias("e"))


def sample_pairs(df: DataFrame, id_col: str, prompt_col: str, response_col: str, reference_col: str) -> DataFrame:
    """``all_pairs`` under the name that it had while the models were fitted on a sample."""
    return all_pairs(df, prompt_col, response_col, reference_col)


def fit_endings(known: DataFrame) -> Endings:
    """Endings of all pairs: all references, and the responses that end with a full stop. Tasks count the endings' bytes; only the counts of different ones reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def counted() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                # texts that differ in their numbers only have one shape, and are read once
                whole = Counter(language.FIGURES.sub("0", t) for t in batch["e"] if t)
                given = Counter(language.FIGURES.sub("0", t) for t in batch["o"] if t)
                whole.update({t: n for t, n in given.items() if _STOPPED.search(t) and not _CUT.search(t)})
                finished = [(_ending(t) + "\0", n) for t, n in whole.items() if content(t)]
                size = 0
                group: list[tuple[str, int]] = []
                for i, (t, n) in enumerate(finished):
                    group.append((t, n))
                    size += len(t)
                    if size > language.CHUNK or i == len(finished) - 1:
                        keys, starts = language.windows([t for t, _ in group], END_ORDER)
                        yield language.summed(keys, np.repeat([n for _, n in group], np.diff(np.append(starts, len(keys)))))
                        group, size = [], 0

        return language.hold_windows(counted())

    keys, n = language.sum_windows(known.select("o", "e").mapInPandas(run, "key bigint, n bigint"))
    return Endings.of_counts(keys, n) if len(keys) else Endings(["."])


def adapted(spark: SparkSession, labelled: DataFrame | list[tuple[str, str]], known: DataFrame) -> tuple:
    """A language model of the pairs' own wording: fitted on all labelled (id, text, lang), or a list without ids, then once more with the pieces of all prompts and references as that model labels them.

    Every labelled language stays, as responses may be in one that no prompt is in.
    """
    script = language.script_of(spark)
    if not isinstance(labelled, DataFrame):
        labelled = spark.createDataFrame([(i, *x) for i, x in enumerate(labelled)], "id int, text string, lang string")
    pieces = language.count_pieces(labelled.filter("lang IS NOT NULL"), script)
    languages = sorted(r["lang"] for r in pieces.select("lang").distinct().collect())
    read = language.read_windows(pieces, languages)
    drop(pieces)
    counts = language.count_windows(read, languages, language.AsLabelled(languages))
    counts = language.corrected_counts(read, languages, counts)
    texts = known.select(F.lit(0).alias("id"), F.explode(F.array("p", "e")).alias("text"), F.lit(None).cast("string").alias("lang"))
    raw = language.count_pieces(texts, script)
    found = raw.groupBy("piece").agg(F.sum("n").alias("n"))
    # repeats of a piece are in both halves by turns, an odd one where its hash says
    odd = F.when(F.pmod(F.xxhash64("piece"), F.lit(2)) == F.col("half"), F.col("n") % 2).otherwise(0)
    split = found.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("n", F.floor(F.col("n") / 2) + odd)
    own = language.read_windows(split.filter("n > 0").select("half", "piece", F.lit(None).cast("string").alias("lang"), "n"), languages)
    drop(raw)
    added = language.count_windows(own, languages, language.as_adapted(language.model_of(languages, counts), languages, own))
    if any(len(keys) for half in added for keys, _ in half):
        counts = [[language.summed(*map(np.concatenate, zip(*c, strict=True))) for c in zip(*halves, strict=True)] for halves in zip(counts, added, strict=True)]
        counts = language.corrected_counts(read.unionByName(own), languages, counts)
    else:
        counts = language.corrected_counts(read, languages, counts)
    drop(read)
    drop(own)
    return language.model_of(languages, counts), script


def _broken_code(text: str) -> bool | None:
    """For JSON: whether it breaks off; None for other text."""
    plain = text.strip()
    if plain[:1] not in ("{", "[", "`"):
        return None
    plain = re.sub(r"^```\w*\s*|\s*```$", "", plain)
    if plain[:1] in ("{", "[") and (plain[1:2] in ('"', "{", "[", "'") or len(plain) < 3 or plain[1:2].isdigit() or plain[1:2].isspace()):
        try:
            json.loads(plain)
        except ValueError:
            return plain.count("{") > plain.count("}") or plain.count("[") > plain.count("]") or plain[-1] not in "}]"
        return False
    return None


def _languages(segments: list[dict] | None) -> dict[str, float]:
    """Bits by which each language wins its stretches."""
    out: dict[str, float] = {}
    for s in segments or []:
        out[s["lang"]] = out.get(s["lang"], 0.0) + s["margin"]
    return out


def _won(texts: list[str | None], model: language.Model, script: language.Script) -> list[dict[str, float]]:
    """``_languages`` of each text. As no stretch depends on a number, texts that differ in their numbers only are read once."""
    known = model.__dict__.setdefault("_won", {})
    plain = [language.FIGURES.sub("0", t or "") for t in texts]
    new = list(dict.fromkeys(t for t in plain if t not in known))
    if len(known) + len(new) > KNOWN_TEXTS:
        known.clear()
        new = list(dict.fromkeys(plain))
    known.update(zip(new, map(_languages, language.segments_of(new, model, script)), strict=True))
    return [known[t] for t in plain]


def named_languages(prompt: str) -> set[str]:
    return {_NAMED[w] for w in re.findall(r"[^\W\d_]+", prompt.casefold()) if w in _NAMED}


def defects_of(prompts: list, responses: list, fitted: tuple, endings: Endings) -> list[list[str]]:
    """The defects of each pair. An empty response has no other defect; a copy is neither cut nor in a wrong language."""
    model, script = fitted
    out: list[list[str]] = [[] for _ in prompts]
    rest = []
    words: dict[int, str] = {}
    unended = []
    for i, (p, r) in enumerate(zip(prompts, responses, strict=True)):
        word = content(r).casefold()
        if _says_nothing(r, word):
            out[i].append("empty")
        elif is_copy(p, r):
            out[i].append("copy")
        else:
            rest.append(i)
            words[i] = word
            if is_refusal(r):
                out[i].append("refusal")
            broken = _broken_code(r)
            if broken or (broken is None and _CUT.search(r)):
                out[i].append("truncated")
            elif broken is None and not _STOPPED.search(r):
                unended.append(i)
    # only where neither code nor a mark nor a full stop tells, the model of endings does
    for i, end in zip(unended, endings.bits([responses[i] for i in unended]), strict=True):
        text = responses[i]
        listed = "\n" in text.strip() and all(len(line.split()) <= 3 for line in text.splitlines())
        if end >= (LISTED_BITS if listed else END_BITS):
            out[i].append("truncated")
    asked = _won([prompts[i] for i in rest], model, script)
    given = _won([responses[i] for i in rest], model, script)
    for i, a, g in zip(rest, asked, given, strict=True):
        if not prompts[i]:
            continue
        allowed = set(a)
        if words[i] in ONE_WORD:
            allowed |= named_languages(prompts[i])
            if allowed and not ONE_WORD[words[i]] & allowed:
                out[i].append("language")
            continue
        if g:
            best = max(g, key=g.get)
            if best not in allowed and g[best] >= LANGUAGE_BITS:
                allowed |= named_languages(prompts[i])
                if allowed and best not in allowed:
                    out[i].append("language")
    return out


def defects_column(prompt: Column, response: Column, spark: SparkSession, fitted: tuple, endings: Endings) -> Column:
    shared = spark.sparkContext.broadcast((fitted, endings))

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known, ends = shared.value
        for prompts, responses in batches:
            p, r = ([x if isinstance(x, str) else None for x in s] for s in (prompts, responses))
            got: list = []
            for k in range(0, len(p), 1000):
                got += defects_of(p[k : k + 1000], r[k : k + 1000], known, ends)
            yield pd.Series(got, dtype=object)

    return run(prompt, response)


def find_defects(df: DataFrame, id_col: str, prompt_col: str, response_col: str, fitted: tuple, endings: Endings) -> DataFrame:
    """(id, defect): one row for each defect of each pair.

    A NULL response is empty; with a NULL or blank prompt nothing counts as a copy or as a wrong language. Repeated rows have their rows
    each; other columns are ignored; an empty table gives none.
    """
    return df.select(F.col(id_col), F.explode(defects_column(F.col(prompt_col), F.col(response_col), df.sparkSession, fitted, endings)).alias("defect"))
