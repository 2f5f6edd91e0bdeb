import itertools

import pytest
from pyspark.sql import functions as F

from wardenlake.llm import confusables, pii
from wardenlake.llm.surrogates import Surrogates

CASES = {
    "Mail a.b+c@mail.example or x_y (at) post [dot] example.": [("email", "a.b+c@mail.example"), ("email", "x_y (at) post [dot] example")],
    "lucas at mail punkt example": [("email", "lucas at mail punkt example")],
    "Upgrade to toolkit@3.1.97, run deploy@worker-7, ping @reviewers.": [],
    "Call +44 (0)20 7946 0219 or (228) 555-0160.": [("phone", "+44 (0)20 7946 0219"), ("phone", "(228) 555-0160")],
    "Ruf 030/23125990 an, tél. 01 99 00 58 12, llama al 0034 500 054 954": [("phone", "030/23125990"), ("phone", "01 99 00 58 12"), ("phone", "0034 500 054 954")],
    "SSN 932-86-0847, DNI 00543845-B, 1 90 12 99 684 450 18": [("id_number", "932-86-0847"), ("id_number", "00543845-B"), ("id_number", "1 90 12 99 684 450 18")],
    "Batch 238-44-0112, order 4534636168, trace 20240424367025136, ticket 555-0583, 1 200 822 ms on 192.0.2.69": [],
    "She lives at 14 Saltgate Ln, Marwick.": [("address", "14 Saltgate Ln, Marwick")],
    "Wir wohnen Ulmenstraße 96\n00298 Mooringbach, Livrez au 64, place du Vieux-Lavoir.": [("address", "Ulmenstraße 96\n00298 Mooringbach"), ("address", "64, place du Vieux-Lavoir")],
    "Vivo en Avenida del Cerro Gris n.º 27 desde marzo. Lane 5 of the road map is free.": [("address", "Avenida del Cerro Gris n.º 27")],
    "Dr. Mireille Ravengård met Mr. Kalholt, V. Dunini and Osterley, Elena.": [("name", "Mireille Ravengård"), ("name", "Kalholt"), ("name", "V. Dunini"), ("name", "Osterley, Elena")],
    "forwarded by beatriz marmann; The Quiet Harbor release follows Amber Falcon. Fennel-12 waits.": [("name", "beatriz marmann")],
    "Ｍａｉｌ dtoreira＠casa.example.net": [("email", "dtoreira＠casa.example.net")],
}


#: No given name of these is listed.
UNLISTED = {
    "Ask Priyanka Venkataraman about it. Spoke with Oluwaseun Adeyemi.": ["Priyanka Venkataraman", "Oluwaseun Adeyemi"],
    "My name is Thandiwe Q. Mokoena and I am late.": ["Thandiwe Q. Mokoena"],
    "Reviewed by Bjarne Okonkwo, approved by Hoang, Linh.": ["Bjarne Okonkwo", "Hoang, Linh"],
    "Ich heiße ruprecht zwiesel und bin hier. Hat Gundula Zwiesel den Bericht schon gelesen?": ["ruprecht zwiesel", "Gundula Zwiesel"],
    "Gwenaëlle Kerbrat a validé le plan. transféré par ÉLOUAN KERBRAT (hier)": ["Gwenaëlle Kerbrat", "ÉLOUAN KERBRAT"],
    "Me llamo Xochitl Itzel y llama a Itziar Goikoetxea al 5.": ["Xochitl Itzel", "Itziar Goikoetxea"],
    "12|Ngozi Achebe|planbox": ["Ngozi Achebe"],
    "Viele Grüße\nWiebke Tjarks": ["Wiebke Tjarks"],
    "Отчёт прочитал Иван Сергеевич Петров, а потом Мария Лебедева.": ["Иван Сергеевич Петров", "Мария Лебедева"],
    "田中さんに聞いてください。私は山田太郎です。皆様、お客様、仕様": ["田中", "山田太郎"],
    "The Quiet Harbor release follows Amber Falcon. El proyecto Puerto Sereno sigue a Halcón Rojo. Le projet Faucon Rouge suit Port Tranquille.": [],
    "Der Bauplan Stiller Hafen kommt vor Roter Falke. Pourquoi Pebble-25 a-t-il appelé? IT TOOK 86 MINUTES UNTIL PINBOARD ANSWERED.": [],
    "approved by the team leads; forwarded by our partner. My name is on the list, call me back at ten.": [],
}


@pytest.fixture(scope="module")
def table(spark):
    return pii.Letters(confusables.prototypes(spark))


@pytest.mark.parametrize("text", CASES)
def test_found(table, text):
    assert [(x[2], text[x[0] : x[1]]) for x in pii.find(text, table)] == CASES[text]


@pytest.mark.parametrize("text", UNLISTED)
def test_names_outside_any_list(table, text):
    assert [text[x[0] : x[1]] for x in pii.find(text, table, {}) if x[2] == "name"] == UNLISTED[text]


def _written(texts, kind, s=None):
    s = s or Surrogates(b"k")
    return [pii.written(s, kind, t, t) for t in texts]


def test_texts(spark):
    rows = [(1, "m", "Call Anna Kalholt on +1 667 555 0145."), (2, "m", "anna kalholt, +16675550145"), (3, "m", None), (4, "m", ""), (5, "m", "nothing here"), (1, "m", "Call Anna Kalholt on +1 667 555 0145."), (6, "m", "word " * 50_000 + "mail x@mail.example")]
    rows += [(7, "m", "Mr. Kalholt"), (7, "m", "x " * 20 + "mail y@mail.example")]
    df = spark.createDataFrame(rows, "seq bigint, tbl string, text string").withColumns({"kind": F.lit(0), "entity": F.lit(0), "id": F.lit(0)})
    out = pii.replaced_texts(df, "seq", "text", ["tbl"], b"key")
    assert "Exchange" not in out._jdf.queryExecution().toString() and "key" not in out._jdf.queryExecution().toString().replace("_key", "")
    got = {r.id: r for r in out.collect() if r.id != 7}
    assert got[3].redacted is None and got[4].redacted == "" and got[5].redacted == got[5].surrogate == "nothing here"
    assert "Anna" not in got[1].redacted and got[1].redacted.startswith("Call [NAME:") and got[1].redacted.endswith("].")
    tag = got[1].redacted.split("[NAME:")[1].split("]")[0]
    assert tag in got[2].redacted and len(tag) == 20  # one person, one tag
    name = got[1].surrogate.removeprefix("Call ").split(" on ")[0]
    assert name.lower() in got[2].surrogate and got[2].surrogate.islower() and name != "Anna Kalholt"
    assert name.split()[0].endswith("a") and got[1].surrogate.split(" on ")[1].startswith("+1 ") and got[6].redacted.endswith("]")
    two = sorted(r.redacted for r in out.filter("id = 7").collect())  # equal ids, texts of their own
    assert two[0].startswith("Mr. [NAME:") and two[1].startswith("x x") and "[EMAIL:" in two[1]
    marks = pii.with_surrogates(df, "seq", "text", ["tbl"], b"key")
    assert marks.filter("id = 1").count() == 4 and pii.with_surrogates(df.limit(0), "seq", "text", ["tbl"], b"key").count() == 0
    again = {r.id: r.surrogate for r in pii.replaced_texts(df, "seq", "text", ["tbl"], b"other").collect()}
    assert again[1] != got[1].surrogate


def test_written_surrogates_are_distinct():
    """100,000 entities, no two alike as they are written, and none left as it was."""
    parts = ["".join(x) for x in itertools.product("bdfklmnprst", "aeiou", "lmnrst", "aeiou", "kmnrt")][:20_000]
    families = [f"{p}{e}".capitalize() for p in parts for e in ("holt", "ik", "berg", "son")][:20_000]
    kinds = {
        "name": [*families, *[f"{c}. {f}" for c in "ABEZ" for f in families[:5000]], *[f"Anna {f}" for f in families[:5000]], *[f"Ann{x} Li" for x in "abcdefghijklmnopqrstuvwxyz"]],
        "address": [f"{n} {f} Lane" for n in range(1, 10) for f in families[:2000]] + [f"{f}straße {n}" for n in range(1, 5) for f in families[:500]],
        "phone": [f"+44 20 {n:04d} {m:04d}" for n in range(7000, 7100) for m in range(0, 100)] + [f"+33 {n}" for n in range(100_000_000, 100_005_000)],
        "id_number": [f"{n:03d}-{m:02d}-0001" for n in range(200) for m in range(50)] + [f"X{n:07d}Z" for n in range(5000)],
        "email": [f"{f.lower()}.{n}@mail.example" for n in range(3) for f in families[:5000]],
    }
    assert sum(map(len, kinds.values())) >= 100_000
    for kind, texts in kinds.items():
        got = _written(texts, kind)
        assert len({pii.canonical(t, kind) for t in texts}) == len(set(got)), kind
        assert not any(a == b for a, b in zip(texts, got, strict=True)), kind


def test_written_surrogates_agree():
    full, reverse, initial, close, accent, family, loud = _written(("Elena Kalholt", "Kalholt, Elena", "E. Kalholt", "E.Kalholt", "É. Kalholt", "Kalholt", "ELENA KALHOLT"), "name")
    given, _, name = full.partition(" ")
    assert reverse == f"{name}, {given}" and initial == accent == f"{given[0]}. {name}" and close == f"{given[0]}.{name}" and family == name and loud == full.upper()
    assert given.endswith("a") and _written(["Peter Kalholt"], "name")[0].split()[0].endswith("o")
    abroad, home, zero = _written(("+44 20 7946 0219", "020 7946 0219", "0044 (0)20 7946 0219"), "phone")
    assert abroad[:4] == "+44 " and home == "0" + abroad[4:] and zero == "0044 (0)" + abroad[4:]
    assert _written(["12 Saltgate Lane, Marwick"], "address")[0].split(",")[0] == _written(["12 Saltgate Lane"], "address")[0]


def test_one_identity_in_a_text(table):
    def tags(text):
        return [m[3] for m in pii.marks_of(text, table, Surrogates(b"k"))]

    one = tags("Anna Kalholt called. Mrs. Kalholt and A. Kalholt are one; so are +44 20 7946 0219 and 020 7946 0219.")
    assert len(one) == 5 and len(set(one[:3])) == 1 and one[3] == one[4]
    two = tags("Anna Kalholt met Peter Kalholt. Mr. Kalholt left, K. Kalholt stayed.")
    assert two[2] == two[1] != two[0] and two[3] not in two[:3]


def test_script_and_width_stay(table):
    s = Surrogates(b"k")
    wide = pii.marks_of("Ｍａｉｌ ｄｔｏｒｅｉｒａ＠ｃａｓａ．ｅｘａｍｐｌｅ, call +４４ ２０ ７９４６ ０２１９", table, s)
    assert [m[2] for m in wide] == ["email", "phone"] and not any(c.isascii() and c.isalnum() for m in wide for c in m[4])
    russian, japanese = pii.marks_of("Звонил, Иван Сергеевич Петров.", table, s)[0][4], pii.marks_of("田中さん", table, s)[0][4]
    assert all("Ѐ" <= c <= "ӿ" or c == " " for c in russian) and len(japanese) == 2 and all("一" <= c <= "鿿" for c in japanese)


def test_double_and_foreign_names_are_found(table):
    given = pii._FIRST | {"łukasz": ""}
    got = pii.find("Anne-Marie Dupont and Karl-Heinz Weber met Łukasz Kowalski. So did Weber, Karl-Heinz and Ł. Żukowski over an anna-lytic report.", table, given)
    assert [x[3] for x in got] == ["anne-marie dupont".replace(" ", "|").replace("-", " "), "karl heinz|weber", "łukasz|kowalski", "karl heinz|weber", "ł|zukowski"]
    assert [x[4] for x in got[:2]] == ["f", "m"]


def test_letters_of_other_scripts_stay_apart():
    for texts in (["김민준", "김민서", "박서준", "이도윤"], ["かな", "がな", "はな", "ばな", "ぱな"], ["Райкин", "Раикин"], ["田中", "田口", "龻中", "\u9fff中"], ["حسن", "حسين"], ["Müller", "Möller", "Miller"]):
        got = _written(texts, "name")
        assert len(set(got)) == len({pii.canonical(t, "name") for t in texts}) == len(texts) and not set(got) & set(texts)
    assert pii.canonical("José Peña", "name") == pii.canonical("Jose\u0301 Pena", "name") and len(set(_written(["José Peña", "Jose Pena"], "name"))) == 1
    assert all("가" <= c <= "힣" for c in _written(["김민준"], "name")[0])


def test_odd_texts_do_not_crash(table):
    s = Surrogates(b"k")
    for text in ("", " ", "\x00", "Mr. ", "A. ", "- name: ", "Mr. \u0301\u0301", "ﬃ ﬁ Dr. ﬁnn Ǆivko", "+٤٤ ٢٠ ٧٩٤٦ ٠٢١٩", "Call " + "A" * 3000 + " " + "b" * 3000, "x@" * 500, "1" * 5000, "|".join(["Ann Lee"] * 300), "Mr. 𝒜𝓃𝓃𝒶 𝒦alholt", "İbrahim İnce asked", "İ. İnce, ß. ßen"):
        marks = pii.marks_of(text, table, s)
        redacted, replaced = pii.rewritten(text, marks)
        assert isinstance(redacted, str) and isinstance(replaced, str) and all(a < b for a, b, *_ in marks)
