"""One form for texts that look the same, by a skeleton of look-alike characters.

skeleton(text) = decompose, replace every character by its prototype, decompose again. Two texts look the same
exactly if their skeletons are equal. The prototypes come from the public Unicode confusables data that the JVM's ICU
carries, narrowed to what makes no visible difference here: width, invisible characters, the kind of blank, the encoding of an
accent, the alphabet of a letter. A letter only takes a prototype of its own case, so I, l and 1 stay apart;
figures, punctuation and accents are never exchanged, and blanks are never counted or trimmed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenlake.plans.lineage import cut

# Default-ignorable characters outside the category Cf.
IGNORED = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
#: Bidirectional overrides change the visible order and stay.
KEPT_FORMATS = "‭‮"
JOINER = "‍"
#: The highest code point with letters of a look-alike alphabet.
LAST = 0x1F000
#: Contents with more rows than this are split over several tasks when pairs are built.
HOT_ROWS = 20_000
#: Contents of one look that one task pairs on each side; a look with more is cut into blocks.
HOT_FORMS = 5_000
#: So many contents at most have more than HOT_ROWS rows and are split; they are broadcast.
HOT_CONTENTS = 10_000


def _own_case(c: str) -> str:
    return "u" if c.isupper() else "l" if c.islower() else ""


def prototypes(spark: SparkSession) -> dict[int, str]:
    """The replacements, by code point; '' removes a character. Built from rules and ICU's table on the driver."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    points = [c for c in range(0x80, LAST) if not 0xD800 <= c < 0xE000]
    letters = [chr(c) for c in points if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lo", "Nl") and unicodedata.normalize("NFD", chr(c)) == chr(c)]
    ascii_letters = [chr(c) for c in range(0x41, 0x7B) if chr(c).isalpha()]
    seen = dict(zip([*ascii_letters, *letters], checker.getSkeleton("\0".join([*ascii_letters, *letters])).split("\0"), strict=True))
    latin: dict[str, list[str]] = {}
    for c in ascii_letters:
        latin.setdefault(seen[c], []).append(c)

    def same_case(c: str, s: str) -> str | None:
        """The letter that stands for the prototype s of the letter c."""
        known = latin.get(s)
        if known:
            case = _own_case(c)
            fit = [k for k in known if not case or _own_case(k) == case]
            return fit[-1] if fit else None
        return s if s.isalpha() and _own_case(c) == _own_case(s) else None

    table: dict[int, str] = {}
    for c in letters:
        s = seen[c]
        to = same_case(c, s[0]) if s and all(unicodedata.category(m) == "Mn" for m in s[1:]) else None
        if to and to + s[1:] != c:
            table[ord(c)] = unicodedata.normalize("NFD", to + s[1:])
    for n in points:
        c, kind, parts = chr(n), unicodedata.category(chr(n)), unicodedata.decomposition(chr(n))
        if parts.startswith(("<wide>", "<narrow>")):
            wide = unicodedata.normalize("NFKD", c)
            table[n] = "".join(table.get(ord(x), x) for x in wide)
        elif "ﬀ" <= c <= "ﬆ":
            table[n] = unicodedata.normalize("NFKD", c)
        if kind == "Zs":
            table[n] = " "
        elif kind == "Zl" or kind == "Zp" or n == 0x85:
            table[n] = "\n"
        elif (kind == "Cf" and c not in KEPT_FORMATS) or c in IGNORED or 0xFE00 <= n <= 0xFE0F:
            table[n] = ""
    for n in (*range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)):
        table[n] = ""
    return table


def skeleton(text: str, table: dict[int, str]) -> str:
    """The skeleton of one text. A joiner between two pictures is part of them and stays."""
    if text.isascii():
        return text.replace("\r\n", "\n") if "\r" in text else text
    if JOINER in text:
        chars = list(text)
        for i, c in enumerate(chars):
            if c == JOINER and 0 < i < len(chars) - 1 and unicodedata.category(chars[i + 1]) == "So" and unicodedata.category(chars[i - 1]) in ("So", "Sk", "Mn"):
                chars[i] = "\x00"
        text = "".join(chars)
    out = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))
    return out.replace("\x00", JOINER).replace("\r\n", "\n")


def skeleton_column(text: Column, spark: SparkSession) -> Column:
    """The skeleton of a text column; NULL for NULL, empty for empty."""
    table = spark.sparkContext.broadcast(prototypes(spark))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = table.value
        for texts in batches:
            yield pd.Series([None if t is None else skeleton(t, known) for t in texts], dtype=object)

    # not to be run again, or before a repartition, for a filter on its result
    return run.asNondeterministic()(text)


def _hash(column: str) -> Column:
    """128 bits of SHA-256: no two texts of any corpus share them, also none that somebody made to."""
    return F.unhex(F.substring(F.sha2(column, 256), 1, 32))


def _hashed(df: DataFrame, id_col: str, text_col: str, by: list[str]) -> DataFrame:
    """(by..., id, look, content): the hashes of skeleton and text; NULL texts look like nothing and are left out."""
    text = F.col(text_col)
    rows = df.select(*by, F.col(id_col).alias("_id"), text.alias("_text"), skeleton_column(text, df.sparkSession).alias("_look")).filter("_text IS NOT NULL")
    return rows.select(*by, "_id", _hash("_look").alias("_look"), _hash("_text").alias("_content"))


def same_look_pairs(df: DataFrame, id_col: str, text_col: str, by: list[str]) -> DataFrame:
    """(by..., a, b), a < b: every two rows whose texts look the same and are different strings.

    Pairs are built between *different contents* of one look and then given their rows, so the work is the size of the result;
    copies of one string never meet. Contents of very many rows are salted on both sides, looks of very many contents are cut into blocks. Rows with equal
    ids make no pair of their own, NULL texts make none, blank texts are texts like others; an empty table gives no pairs.
    """
    rows = cut(_hashed(df, id_col, text_col, by))
    contents = rows.groupBy(*by, "_look", "_content").agg(F.count(F.lit(1)).alias("_n"))
    looks = contents.groupBy(*by, "_look").agg(F.count(F.lit(1)).alias("_forms")).filter("_forms > 1")
    varied = contents.join(looks, [*by, "_look"])
    salts = F.ceil(F.col("_n") / HOT_ROWS).cast("int")
    hot = varied.filter(F.col("_n") > HOT_ROWS).orderBy(F.desc("_n"), "_content").limit(HOT_CONTENTS).select(*by, "_content", salts.alias("_salts"))
    rows = (
        rows.join(looks, [*by, "_look"], "left_semi")
        .join(F.broadcast(hot), [*by, "_content"], "left")
        .select(*by, "_content", "_id", F.pmod(F.xxhash64("_id"), F.coalesce("_salts", F.lit(1))).cast("int").alias("_salt"))
    )
    split = varied.join(F.broadcast(hot), [*by, "_content"], "left").select(*by, "_look", "_content", "_forms", F.coalesce("_salts", F.lit(1)).alias("_salts"))
    split = split.select("*", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt")).drop("_salts")
    # a look of very many contents is paired block by block: a content meets each block of the other side once
    blocks = F.ceil(F.col("_forms") / HOT_FORMS).cast("int")
    split = split.withColumns({"_own": F.pmod(F.xxhash64("_content", "_salt"), blocks).cast("int"), "_every": F.sequence(F.lit(0), blocks - 1)})
    left = split.select(*by, "_look", F.col("_content").alias("_c1"), F.col("_salt").alias("_s1"), F.col("_own").alias("_b1"), F.explode("_every").alias("_b2"))
    right = split.select(*by, "_look", F.col("_content").alias("_c2"), F.col("_salt").alias("_s2"), F.col("_own").alias("_b2"), F.explode("_every").alias("_b1"))
    pairs = left.join(right, [*by, "_look", "_b1", "_b2"]).filter("_c1 < _c2").drop("_look", "_b1", "_b2")
    one = rows.select(*by, F.col("_content").alias("_c1"), F.col("_salt").alias("_s1"), F.col("_id").alias("_i1"))
    two = rows.select(*by, F.col("_content").alias("_c2"), F.col("_salt").alias("_s2"), F.col("_id").alias("_i2"))
    met = pairs.join(one, [*by, "_c1", "_s1"]).join(two, [*by, "_c2", "_s2"]).filter("_i1 <> _i2")
    return met.select(*by, F.least("_i1", "_i2").alias("a"), F.greatest("_i1", "_i2").alias("b"))


def consistent_forms(df: DataFrame, id_col: str, text_col: str, by: list[str]) -> DataFrame:
    """(by..., id, form, look): one form for each row, equal exactly for texts that look the same.

    The form is the plainest original of the class: the fewest characters beyond ASCII, then the smallest string. ``look`` is
    the hash of the skeleton. NULL has the form NULL; every row of the input is kept, repeated rows too.
    """
    text = F.col(text_col)
    rows = cut(df.select(*by, F.col(id_col), text.alias("_text"), F.sha2(skeleton_column(text, df.sparkSession), 256).alias("look")))
    odd = F.length(F.regexp_replace("_text", r"[\x00-\x7F]", ""))
    best = rows.groupBy(*by, "look").agg(F.min(F.struct(odd.alias("odd"), F.col("_text").alias("form"))).alias("_best"))
    same = F.lit(True)
    for c in (*by, "look"):
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}"))
    out = rows.alias("r").join(best.alias("k"), same, "left")
    return out.select(*[f"r.{c}" for c in by], f"r.{id_col}", F.col("k._best.form").alias("form"), "r.look")
