"""Personal information in free text: found, and replaced by keyed, type-consistent surrogates.

Each text is read in one width and alphabet, with a map back to its own positions. E-mail addresses, street addresses, identity
numbers, phone numbers and names are found in that order, each leaving out what was found before. What is found in a text depends on this text alone. In the same
pass every occurrence gets its surrogate and a typed placeholder (``surrogates``), so texts are rewritten where the scan puts them and nothing is shuffled.
Within a text, an initial, a title or a family name alone takes the identity of the one full name it can stand for, and a national number that of
the one international number with the same digits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.llm import confusables, surrogates
from wardenlake.llm.surrogates import Surrogates, fold

#: Short texts whose marks a worker keeps, as messages are often repeated; only speed depends on it.
KNOWN_TEXTS = 50_000
KINDS = ("email", "phone", "id_number", "address", "name")

# Usual given names, by the gender they are mostly given to. They add to what a text itself shows, for names without capitals above all.
FEMALE = """
Alice Amélie Ana Andrea Anja Anne Anna Antonia Astrid Aurélie Barbara Beatriz Bianca Birgit Camille Carla Carmen Carolina Caroline Catherine Cécile Charlotte
Chiara Chloé Christina Claire Claudia Clara Cristina Elena Elif Elisabeth Elizabeth Emily Emma Eva Fatima Francesca Frida Gabriela Giulia Greta Hanna Hannah
Helena Ingrid Inès Irene Isabel Jana Jennifer Jessica Johanna Julia Karin Katarzyna Katharina Kateryna Laura Lena Lucía Lucie Luise Magdalena Margaret Maria María Marie Marta
Mary Mathilde Monika Nadia Natalia Nina Nora Nuria Olga Olivia Patricia Petra Pilar Ruth Sabine Sara Sarah Sofia Sophie Susan Svetlana Teresa Ursula
Valentina Vera Yasmin Zofia Zoé
"""
MALE = """
Adam Alejandro Alexander Ali Andreas Andrew Antoine Anton Antonio Bernd Carlos Charles Christian Daniel David Diego Dieter Emil Erik Fabian Felix Fernando Florian François
Frank Friedrich George Giovanni Guillaume Günter Hans Heinrich Henri Hugo Igor Ivan Jacques Jakob James Jan Javier Johann John Jonas Jorge José Joseph Juan Jürgen Karl Klaus
Lorenzo Louis Luca Lucas Luis Manuel Marco Mario Martin Mateusz Matthias Michael Miguel Mohamed Nikolai Nicolas Olivier Otto Pablo Paolo Patrick Paul Pedro Peter Philippe Pierre Piotr
Rafael Ramón Richard Robert Roberto Sebastian Sergio Stefan Stephen Thomas Tomasz Ulrich Viktor Walter Wilhelm William Yusuf
"""
# Titles before family names, by gender.
TITLES = {"mr": "m", "herr": "m", "sr": "m", "señor": "m", "monsieur": "m", "don": "m", "signor": "m", "ms": "f", "mrs": "f", "miss": "f", "frau": "f", "sra": "f", "srta": "f", "señora": "f", "mme": "f", "madame": "f", "mlle": "f", "doña": "f", "dra": "f", "dr": "", "prof": "", "professor": "", "doctor": ""}
# Words that say that the number after them counts a thing, not a person.
THINGS = set(
    """order orders part parts batch build builds trace traces model ticket tickets version page pages run runs step steps job case ref plan task record item invoice lane line span lot lots commande
    dossier modèle page trace tâche article auftrag auftragsnummer bestellung charge bauteil teil spur seite fassung vorgang stapel artikel modell rechnung pedido lote traza página versión modelo pieza tarea factura construcción
    compilación ordre produit serial sku port commit hash id_run span_id trace_id""".split()
)
# Words that begin sentences and are no family names.
STARTERS = set(
    """the there then this that these those it its we you they he she i if in on at as and but or no not please could can why what who when where how let after before nobody
    der die das es ein eine wir ich sie er und aber wenn nach bitte kannst warum was wer le la les il elle nous vous je un une et mais si après pourquoi que qui el los las
    perché perche dlaczego почему waarom porque kann call sir madam amigos viele meine liebe lieber dear hello hallo bonjour hola
    ella nosotros yo y pero si después por qué quién o a is was has have asked asks said says will would from for with to of by via am auf an im von hat ist war steht und oder est sont avait a validé respondió es del de du des au aux en""".split()
)
_FIRST = {n.lower(): g for names, g in ((FEMALE, "f"), (MALE, "m")) for n in names.split()}
_FIRST |= {fold(n): g for n, g in _FIRST.items()}
_FIRST_WORDS, _TITLE_WORDS = frozenset(_FIRST), frozenset(TITLES)

_AT = r"(?: ?@ ?| ?[(\[{<] ?(?:at|a|arroba|arobase|chiocciola) ?[)\]}>] ?)"
_AT_WORD = r" (?:at|arroba|arobase|chiocciola) "
_DOT_WORD = r"(?: ?[(\[{] ?(?:dot|punto|point|punkt|punt|ponto) ?[)\]}] ?| (?:dot|punto|point|punkt|punt|ponto) )"
_LABEL = r"[^\W_][\w-]*"
_LOCAL = r"(?<![\w.+%-])[^\W_][\w.+%-]*"
EMAIL = re.compile(
    rf"{_LOCAL}{_AT}{_LABEL}(?:(?:\.|{_DOT_WORD}){_LABEL})*(?:\.|{_DOT_WORD})[^\W\d_]{{2,}}(?![\w])"
    rf"|{_LOCAL}{_AT_WORD}{_LABEL}(?:(?:\.|{_DOT_WORD}){_LABEL})*{_DOT_WORD}[^\W\d_]{{2,}}(?![\w])",
    re.I,
)
# Words for streets.
_EN_STREET = "street|st|road|rd|lane|ln|way|drive|dr|terrace|ter|close|cl|avenue|ave|court|ct|place|pl|square|sq|row|crescent|cres|boulevard|blvd|gardens|gdns|grove|mews|walk|parade|highway|hwy|parkway|pkwy|circle"
_DE_STREET = "straße|strasse|str\\.|gasse|weg|platz|allee|ufer|damm|steig|stieg|chaussee|pfad|promenade"
_FR_STREET = "rue|avenue|av\\.|boulevard|bd|bld|place|quai|impasse|allée|allee|chemin|route|square|sentier|ruelle|faubourg|esplanade|cité|villa|résidence"
_ES_STREET = "c/|calle|avda\\.?|av\\.|avenida|paseo|p\\.º|plaza|pza\\.?|pl\\.|camino|carretera|ctra\\.?|ronda|travesía|callejón|glorieta|rambla|cuesta"
_CITY_END = r"(?=\s*(?:[,.;:|\"')]|\n|$)| \d{5}| desde| depuis| (?-i:[A-ZÀ-Þ¿]))"
_EN_TAIL = rf"(?:,? (?:Apt|Flat|Unit|Suite)\.? ?\w+)?(?:(?:, ?|\n)(?-i:[A-ZÀ-Þ])[\w'’-]+{_CITY_END}(?: \d{{5}})?)?"
_DE_TAIL = rf"(?:(?:, ?|\n)(?:\d{{5}} (?-i:[A-ZÄÖÜ])[\w'’-]+|(?-i:[A-ZÄÖÜ])[\w'’-]+{_CITY_END}))?"
_FR_TAIL = r"(?:(?:, ?|\n)(?:\d{5} )(?-i:[A-ZÀ-Þ])[\w'’-]+| à (?-i:[A-ZÀ-Þ])[\w'’-]+)?"
_ES_TAIL = rf"(?:, \d+\.º ?\w?)?(?:(?:, ?|\n)(?:\d{{5}} (?-i:[A-ZÀ-Þ])[\w'’-]+|(?-i:[A-ZÀ-Þ])[\w'’-]+{_CITY_END}))?"
ADDRESSES = [
    re.compile(rf"(?<![\w.,/-])\d{{1,5}}[a-z]?,? (?P<words>(?:St\. )?(?:[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'’-]* ){{1,3}}?)(?:{_EN_STREET})\b\.?(?![\w'’-]){_EN_TAIL}", re.I),
    re.compile(rf"(?<![\w-])(?-i:(?:An|Am|Auf|Im|In|Zum|Zur|Bei)(?: der| dem| den)? |an der )?(?P<words>[A-Za-zÄÖÜäöüß][A-Za-zÄÖÜäöüß-]{{2,}}(?:{_DE_STREET}))\s+\d{{1,4}} ?[a-z]?(?![\w]){_DE_TAIL}", re.I),
    re.compile(rf"(?<![\w-])(?:(?:An|Am|Auf|Im|In|Zum|Zur)(?: der| dem| den)? )?(?P<words>[A-ZÄÖÜ][a-zäöüß]+(?:[bdfgklmnprstz]ring|hof|markt|graben|wall|berg|tor))\s+\d{{1,4}} ?[a-z]?(?![\w])(?i:{_DE_TAIL})"),
    re.compile(rf"(?<![\w.,/-])\d{{1,5}}(?: ?(?:bis|ter|quater))?,? (?:{_FR_STREET}) (?:de la |de l['’]|du |des |de |d['’]|la |le |les )?(?P<words>[^\W\d_][\w'’-]+(?: (?-i:[A-ZÀ-Þ])[\w'’-]+)*){_FR_TAIL}", re.I),
    re.compile(rf"(?<![\w-])(?:{_ES_STREET}) ?(?P<words>(?:(?:de|del|la|las|los|el) )*[^\W\d_][\w'’-]+(?: [^\W\d_][\w'’-]+){{0,2}}?)(?:,? (?:n\.? ?º|n\.? ?°|nº|n°|núm\.?|no\.?|num\.?))?,? \d{{1,4}}(?![\w]|[.]\d){_ES_TAIL}", re.I),
]
# Words within a would-be address that show that it is none; compounds that are no streets.
_NO_STREET = set("the of on a an in to and or for is was minutes minute days day steps step times hours hour seconds points retries months weeks years next until after from by with at".split())
_NO_COMPOUND = set("speicherplatz arbeitsplatz parkplatz stellplatz sitzplatz string spring monitoring unterwegs hinweg durchweg".split())

_ID_CUE = re.compile(r"ssn|social security|tax|passport|pass\b|national[_ ]?id|\bid\b|id[_ ]card|identity|badge|ausweis|steuer|personal|sozialvers|dni|nie\b|nif|documento|tarjeta|seguridad social|sécurité sociale|numéro|nir\b|identité|license|licence", re.I)
_ID_AFTER = re.compile(r"^[\s\"']*(?:printed on the badge|as my tax|belongs to|figure-t-il|auf dem ausweis|en la tarjeta|is my)", re.I)
IDS = [
    re.compile(r"(?<![\w.,/+-])\d{3}([-. ])\d{2}\1\d{4}(?![\w]|[-./]\d)"),
    re.compile(r"(?<![\w.,/+-])\d{2} \d{3} \d{3} \d{3}(?![\w]|[-./ ]\d)"),
    re.compile(r"(?<![\w.,/+-])[1-478] \d{2} \d{2} (?:\d{2}|2[AB]) \d{3} \d{3}(?: \d{2})?(?![\w]|[-./]\d)"),
    re.compile(r"(?<![\w.,/+-])\d{8}-?[A-Za-z](?![\w-])"),
    re.compile(r"(?<![\w.,/+-])\d{1,2}\.\d{3}\.\d{3}-?[A-Za-z](?![\w-])"),
    re.compile(r"(?<![\w.,/+-])[XYZxyz][- ]?\d{7}[- ]?[A-Za-z](?![\w-])"),
    re.compile(r"(?<![\w.,/+-])[CFGHJKLMNPRTVWXYZ]\d{2}[A-Z]\d{5}\d?(?![\w-])", re.I),
]
_RUN = re.compile(r"(?<![\w.,/+(-])\d{9,15}(?![\w]|[-./]\d)")
_PHONE_CUE = re.compile(r"call|phone|tel\b|tél|tel\.|mobile|mobil|callback|text|fax|ruf|rückruf|erreichbar|llam|rappel|appel|joindre|answers on|contact|handy|móvil|teléfono|oder|oppure|numero", re.I)
_INTERNATIONAL = re.compile(r"(?<![\w+.,/-])(?:\(\+ ?\d{1,3}\)|\+ ?\d{1,3}|00[1-9]\d{0,2}?)(?:[ .\-/]?\(0\))?(?:[ .\-/]{0,2}\(?\d{1,11}\)?){1,6}(?![\w])")
PHONES = [
    re.compile(r"(?<![\w.,/+-])(?:1[-. ])?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![\w]|[-./]\d)"),
    re.compile(r"(?<![\w.,/+-])\(0\d{2,4}\) ?\d{3,4}[ -]?\d{3,5}(?![\w]|[-./]\d)"),
    re.compile(r"(?<![\w.,/+-])0\d{2} \d{4} \d{4}(?![\w]|[-./]\d)"),
    re.compile(r"(?<![\w.,/+-])0[1-9](?:[ .-]?\d{2}){4}(?![\w]|[-./]\d)"),
    re.compile(r"(?<![\w.,/+-])(?<!\d )0\d{2,4}[ /-]{1,3}\d{3,8}(?:[ -]\d{1,5})?(?![\w]|[-./]\d)"),
    re.compile(r"(?<![\w.,/+-])(?<!\d )[5-9]\d{2}([ .-])\d{3}\1\d{3}(?![\w]|[-./ ]\d)"),
    # a trunk prefix and one of the area codes of two digits: British, and German
    re.compile(r"(?<![\w.,/+-])0(?:2[03489]|30|40|69|89)\d{7,9}(?![\w]|[-./]\d)"),
]

# What may stand before a person's name, in several languages. Small letters are believed only behind the first four.
_NAMING = r"\b(?:name|nom|nombre|nome|naam) (?:is|ist|est|es|è|é)|\bich hei(?:ß|ss)e|\bik heet|m['’]appelle|\b(?:me llamo|mi chiamo|me chamo|nazywam się)|меня зовут"
_OF = r"\b(?:badge|mobile|phone|desk|card|number|e-?mail|handy|ausweis|nummer|tarjeta|número|numero|móvil|portable|numéro|carte|nombre|nom|name|carné|telefon|téléphone|teléfono) (?:of|von|de|di)"
_BY = r"\b(?:approved|reviewed|forwarded|signed|written|requested|reported|confirmed|checked|opened|prepared|weitergeleitet|geprüft|freigegeben|genehmigt|unterschrieben|geschrieben|transféré|validé|approuvé|signé|relu|écrit|reenviado|aprobado|firmado|revisado|escrito|inoltrato|approvato|firmato|revisto|aprovado) (?:by|von|par|por|da)"
_CALL = r"\b(?:call|phone|ring|ruf(?:en sie)?|rappelez|appelez|llam[ae]n?(?: a)?|chiam[ai]|bel|zadzwoń do|позвоните)(?: bitte| please| back)?"
_ANY_BEFORE = (
    r"\b(?:by|par|por|von|przez|ask|tell|contact|notify|thank|frag(?:en sie)?|kontaktieren sie|contactez|demandez à|prévenez|(?:avis[ae]n?|pregunt[ae]n?|escrib[ae]n?) a|спросите|(?:spoke|speak|talk|talked|met) (?:with|to)|met|inhaber(?:in)?|owner|contact|manager"
    r"|customer|cliente?|kund(?:e|in)|autor(?:e|in)?|auteur|author|belongs to|gehört|appartient à|pertenece a|(?:ya )?respondió|i am|ich bin|je suis|soy|this is|sono|ik ben|jestem|sou)"
)
_BEFORE = re.compile(rf"(?:{_NAMING}|{_OF}|{_BY}|{_CALL}|{_ANY_BEFORE})\s+$", re.I)
# What may follow the name of someone who says or does something.
_AFTER = re.compile(
    r"\s+(?:asked|said|says|wrote|told|reported|answered|replied|confirmed|thinks|wants|hat (?:gesagt|geschrieben|gefragt)|sagte?|schrieb|fragte|meint|(?:l['’])?a (?:validé|dit|écrit|demandé|répondu|confirmé|envoyé|signé|lu)"
    r"|dijo|dice|escribió|preguntó|pidió|ha (?:dicho|escrito|detto|scritto|chiesto)|disse|сказал|написал)\w*\b",
    re.I,
)
_ASKED = re.compile(r"(?:^|[.?!…»\"')\n])\s*(?:Is|Has|Did|Does|Was|Hat|Ist|War|Kann)\s+$")
# Closings of letters.
_CLOSING = r"(?:regards|wishes|cheers|thanks|thank you|best|sincerely|yours|grü(?:ß|ss)en?|gru(?:ß|ss)|dank|cordialement|bien à vous|saludos?|atentamente|gracias|saluti|cumprimentos|groet(?:en)?|pozdrawiam|уважением)"
_SIGNED = re.compile(rf"{_CLOSING}[,.!]?\s*\n\s*$", re.I)
_APPOSED = re.compile(rf"(?<=[^\W\d_A-Z]{{3}}), $")
_CELL = re.compile(r"(?:^|[|;\t])\s*$")
_CELL_END = re.compile(r"\s*(?:$|[|;\t])")
# Words of quantity and kind that stand in small letters where a name might.
_NOT_PERSONS = set(
    """both two three some any all each every many most another other same new old next last first second third senior junior our your my his her their its me him them us people team teams group staff
    users members hand default mistake accident email mail phone letter zwei drei alle viele einige andere mehrere unser euer ihr mein dein jemand niemand deux trois tous plusieurs quelques autres notre votre
    leur mon ton son dos tres todos varios algunos otros otro nuestro vuestro su mi tu alguien nadie nobody somebody someone anyone everyone again back now today tomorrow later soon""".split()
)

_STOP = re.compile(r"[\n;|]|\",|(?<=[a-zß-ÿ\d]{2})[.?!] ")
_LAST_WORD = re.compile(r"([^\W\d_][\w]*)[\s:=\"'#.\[(nº°-]*$")
_FAMILY = r"(?:(?:von|van|de|del|della|da|di|ten|ter) )?{0}{1}+(?:[-'’]{0}{1}+)*"
_UPPER, _LOWER = (f"[{''.join(c for c in map(chr, range(0x2000)) if unicodedata.category(c) == kind)}]" for kind in ("Lu", "Ll"))
_NAME_CASES = [(_UPPER, _LOWER), (_UPPER, _UPPER), (_LOWER, _LOWER)]
_GIVEN_FAMILY = [re.compile(rf"(?<![\w@.-])({a}{b}+(?:-{a}{b}+)?) (?:{a}\.? )?({_FAMILY.format(a, b)})(?![\w@])") for a, b in _NAME_CASES]
_FAMILY_GIVEN = [re.compile(rf"(?<![\w@.-])({a}{b}+(?:[-'’]{a}{b}+)*), ({a}{b}+(?:-{a}{b}+)?)(?: {a}\.)?(?![\w@-])") for a, b in _NAME_CASES]
#: Two capitalised words, whether in capitals only, and whether the family name is first.
_TWO_CAPITALS = [
    (re.compile(rf"(?<![\w@.-])(?=(?P<all>(?P<one>{a}{b}+(?:-{a}{b}+)?) (?:{_UPPER}\.? )?(?P<two>{_FAMILY.format(a, b)}))(?![\w@]|-\d))"), a == b, False)
    for a, b in _NAME_CASES[:2]
] + [(re.compile(rf"(?<![\w@.-])(?=(?P<all>(?P<one>{_UPPER}{_LOWER}+(?:[-'’]{_UPPER}{_LOWER}+)*), (?P<two>{_UPPER}{_LOWER}+(?:-{_UPPER}{_LOWER}+)?)(?: {_UPPER}\.)?)(?![\w@]|-\d))"), False, True)]
_CAPITALS = re.compile(rf"(?<![\w@.-]){_UPPER}[\w'’-]+(?:,? (?:{_UPPER}\.? )?(?:(?:von|van|de|del|della|da|di|ten|ter) )?{_UPPER}[\w'’-]+)+")
_SMALL_PAIR = rf"({_LOWER}{{3,}}(?:-{_LOWER}+)?) (?:{_LOWER}\. )?({_LOWER}{{3,}}(?:[-'’]{_LOWER}+)*)(?![\w@-])"
# matched in the text in small letters, so that the search can start from the cues' first letters; the two words must be small in the text itself
_SMALL = [
    re.compile(rf"(?:{_NAMING})\s+{_SMALL_PAIR}".replace(r"\b", "")),
    re.compile(rf"(?:{_OF}|{_BY}|(?:belongs to|gehört|appartient à|pertenece a))\s+{_SMALL_PAIR}(?=\s*(?:[.,?!;:(\n]|$)| (?P<capital>\w))".replace(r"\b", "")),
    re.compile(rf"(?:{_CALL})\s+{_SMALL_PAIR}(?=\s+(?:unter|an|al|au|on|at|op|pod)\b)".replace(r"\b(?:call", "(?:call")),
    re.compile(rf"{_CLOSING}[,.!]?\s*\n\s*{_SMALL_PAIR}(?=[ .]*(?:\n|$))"),
]
_INITIAL = re.compile(rf"(?<![\w@.-]){_UPPER}\. ?(?:{_UPPER}\. ?)?({_UPPER}[^\W\d_]+(?:[-'’]{_UPPER}[^\W\d_]+)*)(?![\w@]|-\d)")
_TITLED = re.compile(rf"(?<![\w@.-])({'|'.join(sorted(TITLES, key=len, reverse=True))})(?:\.|\b) ?(?:(?:Dr|Prof)\.? )?((?:[^\W\d_]\. ?)?[^\W\d_]{{2,}}(?:[-'’][^\W\d_]+)*)(?![\w@]|-\d)", re.I)
_NAMED_FIELD = re.compile(r"(?:^|[\n;{,|]) ?-? ?\"?(?:name|owner|contact|user_name|full_name|assignee)\"? ?[:=] ?\"?([^\"\n;|{}=:@]+)", re.I)
_TOKENS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
#: Russian names: a patronymic shows a person, and so does a family name's usual ending behind a capitalised word within a sentence.
_PATRONYMIC = re.compile(r"(?<!\w)[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+(?:ович|евич|ич|овна|евна|ична)(?: [А-ЯЁ][а-яё]+)?(?!\w)|(?<!\w)[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+(?:ович|евич|овна|евна)(?!\w)")
_RUSSIAN = re.compile(r"(?<=[а-яё,] )[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]{2,}(?:ов|ева?|ёв|ова|ин|ина|ский|ская|ского|енко|чук|юк)(?:а|у|ым|ой)?(?!\w)")
#: A Japanese name before a title of respect; the excluded words end in the same sign.
_RESPECT = re.compile(r"(?<![一-龥々ァ-ヶー])((?!お?客|皆|奥|神|王|仕|同|模|有|多|異|一様|各|相|何|誰|先生)(?:[一-龥々]{1,5}|[ァ-ヶー]{2,12}))(?:さん|様|氏|先生|殿)")
_INTRODUCED = re.compile(r"(?:名前は|私は)([一-龥々]{2,6}|[ァ-ヶー・]{3,16})(?=です|と申|といい)")

_MAYBE_EMAIL = re.compile(r"@|[(\[{<] ?(?:at|a|arroba|arobase|chiocciola) ?[)\]}>]| (?:at|arroba|arobase|chiocciola) \S[^\n]{0,120}?(?:dot|punto|point|punkt|punt|ponto)[)\]} ]", re.I)
_MAYBE_NUMBER = re.compile(r"\d(?:[ .()/\-]{0,3}[A-Za-z]?\d){5}")
_COMPOUND_ENDS = tuple("straße strasse str gasse weg platz allee ufer damm steig stieg chaussee pfad promenade ring hof markt graben wall berg tor".split())


def _only_words(alternatives: str) -> frozenset[str]:
    """The words without which a pattern of alternatives can't match."""
    return frozenset(re.search(r"^[^\W\d_]+", x)[0] for x in alternatives.split("|"))


_EN_WORDS, _FR_WORDS, _ES_WORDS = (_only_words(x) for x in (_EN_STREET, _FR_STREET, _ES_STREET))


def _address_patterns(words: set[str]) -> Iterator[re.Pattern]:
    """The patterns that can match in a text of these words."""
    if not words.isdisjoint(_EN_WORDS):
        yield ADDRESSES[0]
    if any(w.endswith(_COMPOUND_ENDS) for w in words):
        yield from ADDRESSES[1:3]
    if not words.isdisjoint(_FR_WORDS):
        yield ADDRESSES[3]
    if not words.isdisjoint(_ES_WORDS):
        yield ADDRESSES[4]


#: Words of which each set must have one, or else a pattern for names in small letters can't match.
_SMALL_WORDS = [
    [set("name nom nombre nome naam heiße heisse heet appelle llamo chiamo chamo nazywam зовут".split())],
    [
        set("of von de di by par por da to gehört à a".split()),
        set(
            """badge mobile phone desk card number mail email handy ausweis nummer tarjeta número numero móvil portable numéro carte carné telefon téléphone teléfono name nom nombre belongs gehört appartient
            pertenece approved reviewed forwarded signed written requested reported confirmed checked opened prepared weitergeleitet geprüft freigegeben genehmigt unterschrieben geschrieben transféré validé
            approuvé signé relu écrit reenviado aprobado firmado revisado escrito inoltrato approvato firmato revisto aprovado""".split()
        ),
    ],
    [set("call phone ring ruf rufen rappelez appelez llama llame llaman llamen chiama chiami bel zadzwoń позвоните".split()), set("unter an al au on at op pod".split())],
    [set("regards wishes cheers thanks you best sincerely yours grüße grüßen grüsse grüssen gruss gruß dank cordialement vous saludo saludos atentamente gracias saluti cumprimentos groet groeten pozdrawiam уважением".split())],
]
_SMALL_HINTS = frozenset().union(*[hints[-1] if len(hints) == 2 and "badge" in hints[-1] else hints[0] for hints in _SMALL_WORDS])
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_LATIN = re.compile("[A-Za-z]")
_WHOLE_WORD = re.compile(r"[^\W\d_]+")


class Letters:
    """The look-alikes that are read as plain letters, prepared for many texts."""

    def __init__(self, table: dict[int, str]) -> None:
        self.to = {}
        for c, to in table.items():
            struck = (len(to) == 1 and not to.isascii()) or (len(to) > 1 and any(map(unicodedata.combining, to)))  # a struck letter is one of its own
            if c >= 0x80 and not struck:
                self.to[chr(c)] = to
        self.odd = frozenset(self.to) | {c for c in map(chr, range(0x300, 0x10000)) if unicodedata.combining(c)}


def legible(text: str, letters: Letters) -> tuple[str, list[int] | None]:
    """The text in one width, alphabet and kind of blank, and for each of its characters the position in the original (None: the same)."""
    if text.isascii() or letters.odd.isdisjoint(text):
        return text, None
    out: list[str] = []
    at: list[int] = []
    own: frozenset[int] = frozenset()
    if _CYRILLIC.search(text) and any(_CYRILLIC.match(c) and c not in letters.to for c in text):
        # a text with letters that are Cyrillic only: words without a Latin letter are in that alphabet
        own = frozenset(i for m in _WHOLE_WORD.finditer(text) if not _LATIN.search(m[0]) for i in range(*m.span()))
    for i, c in enumerate(text):
        if c < "\x80" or i in own:
            out.append(c)
            at.append(i)
            continue
        if unicodedata.combining(c) and out:
            joined = unicodedata.normalize("NFC", out[-1] + c)
            if len(joined) == 1:
                out[-1] = joined
            continue
        for x in letters.to.get(c, c):
            out.append(x)
            at.append(i)
    at.append(len(text))
    return "".join(out), at


def _thing(text: str, start: int) -> bool:
    m = _LAST_WORD.search(text[max(0, start - 30) : start])
    return bool(m) and m[1].lower() in THINGS


def _near(cue: re.Pattern, text: str, start: int) -> bool:
    """A cue in the same field or sentence before the position."""
    return bool(cue.search(_STOP.split(text[max(0, start - 60) : start])[-1]))


class _Spans:
    """What is found so far; a later find may not touch an earlier one."""

    def __init__(self) -> None:
        self.found: list[tuple[int, int, str]] = []

    def add(self, a: int, b: int, kind: str) -> bool:
        if any(a < y and x < b for x, y, _ in self.found):
            return False
        self.found.append((a, b, kind))
        return True


def _planned(digits: str) -> str:
    """What a bare number in a field of its own is by the public numbering plans; '' if none fits or several do."""
    n, first = len(digits), digits[0]
    if n == 9:  # from 5 on a Spanish telephone number, but from 9 on an American taxpayer's
        return "phone" if first in "5678" else "id_number"
    if n == 10:
        return "phone" if first != "1" else ""
    if n == 11:  # with 1 in front an American telephone number if the area's code can be one, else a German tax number
        return "phone" if first == "1" and digits[1] >= "2" and digits[4] >= "2" else "id_number"
    return "id_number" if n in (13, 15) and first in "12" and 1 <= int(digits[3:5]) <= 12 else ""


def _numbers(text: str, spans: _Spans) -> None:
    for m in _INTERNATIONAL.finditer(text):
        digits = re.sub(r"\D", "", m[0].replace("(0)", ""))
        plus, code = "+" in m[0], re.sub(r"\D", "", m[0])
        code = code if plus else code[2:]
        size = {"1": 11, "33": 11, "34": 11, "44": 12}.get(code[:1] if code[:1] == "1" else code[:2])
        have = len(digits) if plus else len(digits) - 2
        if have < 9 or _thing(text, m.start()) or (not plus and (_near(_ID_CUE, text, m.start()) or (size or have) > have)):
            continue
        end = m.end()
        if size and have > size:
            extra = have - size
            while extra:
                end -= 1
                extra -= text[end].isdigit()
            while not (text[end - 1].isdigit() or text[end - 1] == ")"):
                end -= 1
        if have <= 15 or size:
            spans.add(m.start(), end, "phone")
    for rx in IDS:
        for m in rx.finditer(text):
            if not _thing(text, m.start()):
                spans.add(m.start(), m.end(), "id_number")
    for rx in PHONES:
        for m in rx.finditer(text):
            if _thing(text, m.start()):
                continue
            if m[0].isdigit() and (_ID_AFTER.search(text[m.end() : m.end() + 40]) or (_near(_ID_CUE, text, m.start()) and not _near(_PHONE_CUE, text, m.start()))):
                continue
            spans.add(m.start(), m.end(), "phone")
    for m in _RUN.finditer(text):
        if _thing(text, m.start()):
            continue
        digits = m[0]
        field = (m.start() == 0 or text[m.start() - 1] in "|;,\t") and (m.end() == len(text) or text[m.end()] in "|;,\t") and len(digits) != len(text)
        if _near(_ID_CUE, text, m.start()) or _ID_AFTER.search(text[m.end() : m.end() + 40]):
            spans.add(m.start(), m.end(), "id_number")
        elif _near(_PHONE_CUE, text, m.start()) and len(digits) <= 12:
            spans.add(m.start(), m.end(), "phone")
        elif field and "|" in text and _planned(digits):
            spans.add(m.start(), m.end(), _planned(digits))


def _is_family(word: str) -> bool:
    low = word.lower()
    return len(word) > 1 and low not in STARTERS and low.partition("-")[0] not in STARTERS


def _is_given(word: str, given: dict[str, str]) -> bool:
    """Whether it is a known given name; of a double one the first part must be known, in small letters both, as compounds are written alike."""
    low = word.lower()
    first, _, second = low.partition("-")
    return low in given or (bool(second) and first in given and (word != low or second in given))


def _shown(text: str, start: int, end: int, loud: bool = False, turned: bool = False) -> bool:
    """Whether what stands around two capitalised words shows that they name a person; ``loud``: in capitals only, ``turned``: with the family name first."""
    before, after = text[max(0, start - 48) : start], text[end : end + 24]
    if before[-1:] == " " and _BEFORE.search(before) or "\n" in before and _SIGNED.search(before):
        return True
    if _CELL.search(before) and _CELL_END.match(after) and not (start == 0 and end == len(text)):
        return True
    if loud and not after[1:2].islower():  # in a text that is all in capitals
        return bool(_APPOSED.search(before)) and bool(re.match(r"[.!?](?:\s|$)|\s*$", after))
    if _ASKED.search(before) and re.match(r" [a-zß-ÿ]", after):
        return True
    if _AFTER.match(after):
        return not turned or bool(re.search(r"(?:^|[.?!\n])\s*$", before))
    if turned:
        return False
    return bool(_APPOSED.search(before)) and bool(re.match(r"[.!?]?(?:\s|$)", after)) and not re.match(r" [a-zß-ÿ]", after)


def _pairs_in(text: str, start: int, end: int) -> Iterator[tuple[re.Match, bool, bool]]:
    for rx, loud, turned in _TWO_CAPITALS:
        for m in rx.finditer(text, start):
            if m.start() >= end:
                break
            yield m, loud, turned


def _unlisted(text: str, spans: _Spans, words: set[str]) -> None:
    """Names whose given name is in no list, by what stands around them."""
    for run in _CAPITALS.finditer(text):
        if len([w for w in run[0].lower().replace(",", "").split() if w not in STARTERS]) < 2:
            continue
        for m, loud, turned in _pairs_in(text, run.start(), run.end()):
            first, second = m["one"].lower(), m["two"].lower()
            if {first, second} & (STARTERS | _NOT_PERSONS) or first in TITLES or second in TITLES or not _is_family(second) or len(second) < 3:
                continue
            if _shown(text, m.start(), m.end("all"), loud, turned):
                spans.add(m.start(), m.end("all"), "name")
    if words.isdisjoint(_SMALL_HINTS):
        return
    low = text.lower()
    for rx, hints in zip(_SMALL, _SMALL_WORDS, strict=True) if len(low) == len(text) else ():
        for m in rx.finditer(low) if not any(words.isdisjoint(h) for h in hints) else ():
            if not text[m.start(1) : m.end(2)].islower() or (m.groupdict().get("capital") and not text[m.start("capital")].isupper()):
                continue
            both = {w for g in (1, 2) for w in m[g].split("-")}
            if not both & STARTERS and not both & _NOT_PERSONS and not both & THINGS:
                spans.add(m.start(1), m.end(2), "name")


def _names(text: str, spans: _Spans, given: dict[str, str], words: set[str]) -> None:
    for m in _TITLED.finditer(text) if not words.isdisjoint(_TITLE_WORDS) else ():
        title, word = m[1], m[2]
        first = word.rpartition(" ")[2] or word
        if title.lower() == "don" and title != "Don":
            continue
        if not (first[0].isupper() or title.islower()) or not _is_family(first):
            continue
        start, end = m.start(2), m.end(2)
        for rx in _GIVEN_FAMILY:
            more = rx.match(text, start)
            # German writes any noun with a capital, so that two capitalised words behind Herr or Frau need not be one name
            if more and _is_family(more[2]) and (_is_given(more[1], given) or (more[2][0].isupper() and (title.lower() not in ("herr", "frau") or _shown(text, m.start(), more.end())))):
                end = more.end()
                break
        if text[end : end + 1] == "-" and text[end + 1 : end + 2].isdigit():
            continue
        spans.add(start, end, "name")
    if not words.isdisjoint(_FIRST_WORDS if given is _FIRST else {part for g in given for part in (g, g.partition("-")[0])}):
        known = [t for t in _TOKENS.finditer(text) if (low := t[0].lower()) in given or ("-" in low and low.partition("-")[0] in given)]
        if ", " in text:
            for rx in _FAMILY_GIVEN:
                for m in rx.finditer(text):
                    whole = text[: m.start()].rstrip(" \"'")[-1:] in ("", "|", "=", ":", "\n", "-") and text[m.end() : m.end() + 1] in ("", "|", ";", '"', "\n")
                    if (m[1][0].isupper() or whole) and _is_given(m[2], given) and m[1].lower() not in given and _is_family(m[1]) and len(m[1]) > 2:
                        spans.add(m.start(), m.end(), "name")
        upto = 0
        for t in known:
            if t.start() < upto:
                continue
            for rx in _GIVEN_FAMILY:
                m = rx.match(text, t.start())
                if m and _is_given(m[1], given) and _is_family(m[2]) and len(m[2]) > 2 and not text[m.end() : m.end() + 2].lstrip("-").isdigit():
                    if spans.add(m.start(), m.end(), "name"):
                        upto = m.end()
                    break
    for m in _NAMED_FIELD.finditer(text):
        value = m[1].strip()
        parts = value.replace(",", " ").split()
        if 2 <= len(parts) <= 5 and not any(c.isdigit() for c in value):
            skip = 0
            while parts and parts[0].rstrip(".").lower() in TITLES:
                skip = value.index(parts[0]) + len(parts[0])
                skip += len(value[skip:]) - len(value[skip:].lstrip())
                parts = parts[1:]
            spans.add(m.start(1) + m[1].index(value) + skip, m.start(1) + m[1].index(value) + len(value), "name")
    _unlisted(text, spans, words)
    if "." in text:
        for m in _INITIAL.finditer(text):
            if _is_family(m[1]) and len(m[1]) > 2:
                spans.add(m.start(), m.end(), "name")
    if text.isascii():
        return
    for rx in (_PATRONYMIC, _RUSSIAN) if _CYRILLIC.search(text) else ():
        for m in rx.finditer(text):
            if m[0].split()[0].lower() not in STARTERS:
                spans.add(m.start(), m.end(), "name")
    for rx, signs in ((_RESPECT, ("さん", "様", "氏", "先生", "殿")), (_INTRODUCED, ("名前は", "私は"))):
        for m in rx.finditer(text) if any(x in text for x in signs) else ():
            spans.add(m.start(1), m.end(1), "name")


def _spans_of(plain: str, given: dict[str, str]) -> list[tuple[int, int, str]]:
    spans, words = _Spans(), set(_WHOLE_WORD.findall(plain.lower()))
    if _MAYBE_EMAIL.search(plain):
        for m in EMAIL.finditer(plain):
            spans.add(m.start(), m.end(), "email")
    if _ANY_DIGIT.search(plain):
        for rx in _address_patterns(words):
            for m in rx.finditer(plain):
                street = m["words"].lower().split()
                if not (_NO_STREET & set(street)) and street[-1] not in _NO_COMPOUND:
                    spans.add(m.start(), m.end(), "address")
        if _MAYBE_NUMBER.search(plain):
            _numbers(plain, spans)
    _names(plain, spans, given, words)
    return sorted(spans.found)


_ANY_DIGIT = re.compile(r"\d")


def canonical(plain: str, kind: str) -> str:
    """The entity that all ways of writing one address, number or name share."""
    if kind == "email":
        low = re.sub(rf"{_AT}|{_AT_WORD}", "@", " ".join(plain.lower().split()), count=1)
        return fold(re.sub(_DOT_WORD, ".", low).replace(" ", ""))
    if kind == "phone":
        code, number, _ = surrogates.national(plain)
        return f"+{code} {number}" if code else number
    if kind == "id_number":
        return re.sub(r"[\W_]", "", fold(plain))
    if kind == "address":
        return re.sub(r"[^\w]+", " ", fold(plain)).strip()
    return "|".join(surrogates.name_key(plain))


def _gender(plain: str, before: str) -> str:
    title = re.search(r"([^\W\d_]+)\.? $", before)
    return (TITLES.get(title[1].lower(), "") if title else "") or _FIRST.get(surrogates.name_key(plain)[0].partition(" ")[0].partition("-")[0], "")


def find(text: str, letters: Letters, given: dict[str, str] = _FIRST) -> list[tuple[int, int, str, str, str, str]]:
    """(start, end, kind, entity, gender, plain) of the occurrences in a text, by position; ``given`` are listed given names and their gender.

    ``entity`` is the identity within this text, ``plain`` the occurrence in legible letters.
    """
    plain, at = legible(text, letters)
    out = []
    for a, b, kind in _spans_of(plain, given):
        gender = _gender(plain[a:b], plain[max(0, a - 12) : a]) if kind == "name" else ""
        out.append((a if at is None else at[a], b if at is None else at[b - 1] + 1, kind, canonical(plain[a:b], kind), gender, plain[a:b]))
    return _one_identity(out)


def _one_identity(found: list) -> list:
    """Parts of names and national numbers take the identity of the only full name or international number in the text that they can stand for."""
    names = {(e, g) for _, _, kind, e, g, _ in found if kind == "name"}
    abroad = {e for _, _, kind, e, _, _ in found if kind == "phone" and e.startswith("+")}
    if len(names) < 2 and not abroad:
        return found
    out = []
    for a, b, kind, entity, gender, plain in found:
        if kind == "name":
            given, _, family = entity.partition("|")
            if len(given) <= 1:
                full = {e for e, g in names if e.partition("|")[2] == family and len(e.partition("|")[0]) > 1 and e.startswith(given) and not (g and gender and g != gender)}
                if len(full) == 1:
                    entity = full.pop()
        elif kind == "phone" and not entity.startswith("+"):
            full = {e for e in abroad if e.partition(" ")[2] == entity}
            if len(full) == 1:
                entity = full.pop()
        out.append((a, b, kind, entity, gender, plain))
    return out


# Words of an address that tell what it is and not where.
_ADDRESS_WORDS = set(
    """street st road rd lane ln way drive dr terrace ter close cl avenue ave court ct place pl square sq row crescent cres boulevard blvd gardens gdns grove mews walk parade highway hwy parkway pkwy circle
    straße strasse str gasse weg platz allee ufer damm steig stieg chaussee pfad promenade rue av bd bld quai impasse chemin route sentier ruelle faubourg esplanade cite villa residence calle avda avenida
    paseo plaza pza camino carretera ctra ronda travesia callejon glorieta rambla cuesta apt flat unit suite bis quater no num am an auf im in zum zur bei der dem den de la le les du des del las los el""".split()
)
_COMPOUND = re.compile(r"(?<=..)(?:straße|strasse|str|gasse|weg|platz|allee|ufer|damm|steig|stieg|chaussee|pfad|promenade|ring|hof|markt|graben|wall|berg|tor)$")


def _compound(word: str) -> int:
    m = _COMPOUND.search(word)
    return len(m[0]) if m else 0


def written(s: Surrogates, kind: str, plain: str, original: str) -> str:
    """The surrogate of an occurrence, written as it is: in its script, width, case, order and separators.

    ``plain`` is the occurrence in legible letters, ``original`` the characters it was read from, one for each.
    """
    if kind == "phone":
        return surrogates.phone_surrogate(s, plain, original)
    if kind == "id_number":
        return surrogates.id_surrogate(s, plain, original)
    if kind == "name":
        return surrogates.name_surrogate(s, plain, original, _FIRST.get(surrogates.name_key(plain)[0].partition(" ")[0].partition("-")[0], ""))
    if kind == "address":
        return surrogates.words_surrogate(s, plain, original, "address", _ADDRESS_WORDS.__contains__, _compound)
    spared = [m.span() for m in (re.search(rf"{_AT}|{_AT_WORD}", plain, re.I),) if m]
    spared += [m.span() for m in re.finditer(_DOT_WORD, plain, re.I)]
    last = re.search(r"[^\W\d_]+$", plain)
    spared += [last.span()] if last else []
    return surrogates.words_surrogate(s, plain, original, "email", lambda _: False, spared=spared)


def marks_of(text: str, letters: Letters, s: Surrogates, given: dict[str, str] = _FIRST) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, placeholder, surrogate) of the occurrences in a text."""
    found = find(text, letters, given)
    if not found:
        return []
    at = legible(text, letters)[1]
    places = {p: i for i, p in reversed(list(enumerate(at)))} if at else None
    out = []
    for a, b, kind, entity, _, plain in found:
        if places is None:
            original = text[a:b]
        else:
            first = places[a]
            original = "".join(text[at[first + k]] for k in range(len(plain)))
        out.append((a, b, kind, f"[{kind.upper()}:{s.tag(kind, entity)}]", written(s, kind, plain, original)))
    return out


MARK = "struct<start_pos:bigint,length:bigint,kind:string,placeholder:string,surrogate:string>"


def _run(df: DataFrame, text: Column, key: bytes, kind: str, each) -> Column:
    """A Python column over a text column; ``each`` gets a text and its marks. Key and tables reach the workers as broadcast values."""
    shared = df.sparkSession.sparkContext.broadcast((key, confusables.prototypes(df.sparkSession)))

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own_key, table = shared.value
        letters, s = Letters(table), Surrogates(own_key)
        known: dict[str, list] = {}

        def marks(t: str) -> list:
            got = known.get(t)
            if got is None:
                got = marks_of(t, letters, s)
                if len(known) >= KNOWN_TEXTS:
                    known.clear()
                if len(t) < 1000:
                    known[t] = got
            return got

        for texts in batches:
            yield each([(t, marks(t)) if isinstance(t, str) and t else (t if isinstance(t, str) else None, []) for t in texts])

    # not to be run again, or before a repartition, for a filter on its result
    return run.asNondeterministic()(text)


def with_surrogates(df: DataFrame, id_col: str, text_col: str, by: list[str], key: bytes) -> DataFrame:
    """(by..., id, start_pos, length, kind, placeholder, surrogate): every occurrence with what replaces it, positions in code points from 1.

    NULL and empty texts have none; repeated rows have theirs each; rows with equal ids and different texts keep their own. Other columns are ignored.
    """

    def each(rows: list) -> pd.Series:
        return pd.Series([[{"start_pos": a + 1, "length": b - a, "kind": kind, "placeholder": p, "surrogate": x} for a, b, kind, p, x in marks] for _, marks in rows], dtype=object)

    marks = _run(df, F.col(text_col), key, f"array<{MARK}>", each)
    return df.select(*by, F.col(id_col).alias("_id"), F.inline(marks)).select(*by, F.col("_id").alias("id"), "start_pos", "length", "kind", "placeholder", "surrogate")


def rewritten(text: str | None, marks: list) -> tuple[str | None, str | None]:
    """The text with placeholders, and with surrogates."""
    if not marks:
        return text, text
    redacted, replaced, at = [], [], 0
    for a, b, _, placeholder, surrogate in marks:
        redacted += [text[at:a], placeholder]
        replaced += [text[at:a], surrogate]
        at = b
    return "".join(redacted) + text[at:], "".join(replaced) + text[at:]


def replaced_texts(df: DataFrame, id_col: str, text_col: str, by: list[str], key: bytes) -> DataFrame:
    """(by..., id, redacted, surrogate): the texts with typed placeholders, and with surrogates; all else unchanged.

    Every row is kept, in the pass that finds; texts without an occurrence come out as they are, NULL as NULL. Other columns are ignored.
    """

    def each(rows: list) -> pd.DataFrame:
        return pd.DataFrame([rewritten(t, marks) for t, marks in rows], columns=["redacted", "surrogate"], dtype=object)

    out = _run(df, F.col(text_col), key, "struct<redacted:string,surrogate:string>", each)
    return df.select(*by, F.col(id_col).alias("id"), out.alias("_out")).select(*by, "id", "_out.redacted", "_out.surrogate")
