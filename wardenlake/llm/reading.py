"""The reading grade of running text.

For each document the smallest frequency-ranked vocabulary is found that covers a fixed share of its words, for each of a few shares. The rank where it ends, in the word
frequencies of the whole corpus in its language, is told as the share of the corpus's own words that lie beyond it: ranks of a small and of a large corpus compare then.
With the complexity of its sentences it is compared, in SQL, with the profiles of graded samples, by a distance that knows how these numbers vary together within a grade. Logs,
tables, payloads, dumps and headings are left out line by line; a document without running text has no grade.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardenlake.llm import language
from wardenlake.plans.lineage import cut
from wardenlake.sources.tables import spread

#: The shares of a document's words that its vocabularies cover.
SHARES = (0.5, 0.7, 0.9)
#: The most frequent words, which are broadcast with their ranks; the others are joined by the word, and none of them is frequent.
HEAD_WORDS = 50_000
#: Added to the covariance within grades: a share of each number's own spread, and a least spread.
RIDGE, LEAST_SPREAD = 0.3, 0.03
COVERAGE = tuple(f"coverage_{round(100 * s)}" for s in SHARES)
FEATURES = (*COVERAGE, "sentence")

_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\u00ad\u200b-\u200f\u2060-\u2064\ufeff]+")
_MARK_SET = frozenset(c for c in map(chr, range(0xAD, 0x10000)) if _MARKS.match(c))
_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_LINK = re.compile(r"\(?\b(?:https?://|www\.)\S*[^\s.,;:!?]|\(v\d[\d.]*\)")
_BULLET = re.compile(r"^(?:[*•‣◦▪–—-]|\d+[.)])\s+")
_HEADING = re.compile(r"^(?:#{1,6}|=+)\s")
_SENTENCES = re.compile(r"[.!?…][\"'”»)\]]*\s+")
_WORD = re.compile(r"[^\W\d_]+")
_PLAIN_TOKENS = re.compile(r"(?<!\S)[\"'“„«(¿¡\[]*[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?)\"'”»…\]]*(?!\S)")
#: A line without any of these is one of words; it may still be a list of values.
_ODD = re.compile(r"[^\w .,;:!?…\"'“”„«»¿¡’-]|[\d_]")
_VALUES = re.compile(r"\S+,\S*,\S*|Traceback")
_LETTERS = re.compile(r"\w+")
_PAYLOAD = re.compile(r"\s*[\[{|<]|\s+at \S+\(|\S+,\S*,\S*|\d{4}-\d\d-\d\d[ T]|Traceback|\s*File \"")
_FIELDS = re.compile(r"\w+=\S+ \w+=\S+")


def fold(text: str) -> str:
    """In lower case, without accents and invisible characters."""
    text = text.casefold()
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text))


_folded = lru_cache(maxsize=100_000)(fold)


def running_sentences(text: str) -> list[list[str]]:
    """The words of the sentences of the running text: of lines that are mostly words, without headings, list marks and links."""
    if not text.isascii() and not _MARK_SET.isdisjoint(text):
        text = _MARKS.sub("", text)
    if "http" in text or "www." in text or "(v" in text:
        text = _LINK.sub(" ", text)
    out = []
    for raw in _LINES.split(text):
        line = " ".join(raw.split())
        words = _WORD
        if not _ODD.search(line):
            if not line or ("," in line or line[0] == "T") and _VALUES.match(line):
                continue
            words = _LETTERS
        else:
            if _PAYLOAD.match(raw) or _HEADING.match(line) or ("=" in raw and _FIELDS.search(raw)):
                continue
            line = _BULLET.sub("", line)
            plain = len(_PLAIN_TOKENS.findall(line))
            if plain < 2 or plain < 0.6 * (line.count(" ") + 1):
                continue
        out += [w for s in _SENTENCES.split(line) if len(w := words.findall(s)) >= 2]
    return out


class Votes:
    """The language of a text by its words: a word speaks for a language as far as labelled texts with it carry that label.

    Labels may be wrong, as long as most texts with a word have the right one.
    """

    def __init__(self, labelled: list[tuple[str, str]], script: language.Script) -> None:
        texts: dict[str, Counter] = {}
        self.languages = sorted({lang for _, lang in labelled})
        at = {lang: i for i, lang in enumerate(self.languages)}
        for text, lang in labelled:
            for w in {_folded(w) for s in running_sentences(script.alphabet(text)) for w in s}:
                texts.setdefault(w, Counter())[at[lang]] += 1
        n = len(self.languages)
        # of labels as frequent as they are, so that a frequent language doesn't win by its size
        size = Counter(at[lang] for _, lang in labelled)
        self.bits: dict[str, list[float]] = {}
        for w, c in texts.items():
            rates = [(c[i] + 0.1) / (size[i] + 1) for i in range(n)]
            total = sum(rates)
            self.bits[w] = [log2(r / total) for r in rates]

    def winner(self, words: Counter) -> str | None:
        """The language with the most votes; None if no word is known."""
        total = [0.0] * len(self.languages)
        for w, n in words.items():
            for i, b in enumerate(self.bits.get(w, ())):
                total[i] += n * b
        return self.languages[total.index(max(total))] if any(total) else None


def fit_votes(spark: SparkSession, labelled: list[tuple[str, str]]) -> tuple[Votes, language.Script]:
    script = language.script_of(spark)
    return Votes(labelled, script), script


PREPARED = "struct<lang:string,sentences:bigint,words:array<string>,counts:array<int>>"


def _prepared(text: str | None, given: str | None, votes: Votes, script: language.Script) -> tuple:
    sentences = running_sentences(script.alphabet(text)) if isinstance(text, str) else []
    words: Counter = Counter()
    for w, n in Counter(w for s in sentences for w in s).items():
        words[_folded(w)] += n
    if not words:
        return None, None, None, None
    return given or votes.winner(words), len(sentences), list(words), list(words.values())


def prepared_column(text: Column, spark: SparkSession, fitted: tuple, lang: Column | None = None) -> Column:
    """Language, sentences and distinct words of the running text; NULL where there is none. A known language may be given."""
    shared, unknown = spark.sparkContext.broadcast(fitted), lang is None

    @F.pandas_udf(PREPARED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        votes, script = shared.value
        for texts, langs in batches:
            got = [_prepared(t, x if isinstance(x, str) and not unknown else None, votes, script) for t, x in zip(texts, langs, strict=True)]
            yield pd.DataFrame(got, columns=["lang", "sentences", "words", "counts"], dtype=object)

    # not to be run again, or before a repartition, for a filter on its result
    return run.asNondeterministic()(text, text if unknown else lang)


def word_ranks(words: DataFrame) -> DataFrame:
    """(lang, word, rank, freq, beyond): how many words of the language are at least as frequent, and -ln of the share of all its words that aren't more frequent.

    Both come from the counts of each frequency, of which there are few, not from an order of the whole vocabulary in one task.
    """
    vocabulary = cut(words.groupBy("lang", "word").agg(F.sum("n").alias("freq")))
    by_freq = vocabulary.groupBy("lang", "freq").agg(F.count(F.lit(1)).alias("_n"))
    upto, more = (Window.partitionBy("lang").orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, last) for last in (0, -1))
    mass = F.coalesce(F.sum(F.col("freq") * F.col("_n")).over(more), F.lit(0)) / F.sum(F.col("freq") * F.col("_n")).over(Window.partitionBy("lang"))
    ranks = by_freq.select("lang", "freq", F.sum("_n").over(upto).alias("rank"), (-F.log(F.greatest(F.lit(1.0) - mass, F.lit(1e-12)))).alias("beyond"))
    return vocabulary.join(ranks, ["lang", "freq"]).select("lang", "word", "rank", "freq", "beyond")


RANKED = "struct<beyond:array<double>,n:array<bigint>,rare:array<string>,rare_n:array<bigint>>"


def _looked_up(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """``rows`` with the ranks of their frequent words (_beyond, _n), and their other words (_rare, _rare_n), in place of words and counts."""
    head: dict[str | None, dict[str, float]] = {}
    for r in ranks.orderBy(F.desc("freq"), "lang", "word").limit(HEAD_WORDS).select("lang", "word", "beyond").collect():
        head.setdefault(r["lang"], {})[r["word"]] = r["beyond"]
    shared = rows.sparkSession.sparkContext.broadcast(head)

    @F.pandas_udf(RANKED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for langs, words, counts in batches:
            out = []
            for lang, w, c in zip(langs, words, counts, strict=True):
                known, at, rare, rare_n = shared.value.get(lang, {}), {}, [], []
                for word, n in zip(w, c.tolist(), strict=True):
                    beyond = known.get(word)
                    if beyond is None:
                        rare.append(word)
                        rare_n.append(n)
                    else:
                        at[beyond] = at.get(beyond, 0) + n
                out.append((list(at), list(at.values()), rare, rare_n))
            yield pd.DataFrame(out, columns=["beyond", "n", "rare", "rare_n"], dtype=object)

    ranked = rows.select("*", run.asNondeterministic()("lang", "words", "counts").alias("_r"))
    return ranked.select("*", F.col("_r.beyond").alias("_beyond"), F.col("_r.n").alias("_n"), F.col("_r.rare").alias("_rare"), F.col("_r.rare_n").alias("_rare_n")).drop("_r", "words", "counts")


def _features(rows: DataFrame, ranks: DataFrame, all_ranked: bool, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """Each row of ``rows`` (_row, lang, sentences, words, counts, ...) with its features. A word that the corpus lacks counts as rarer than its rarest.

    Frequent words have their ranks looked up where the rows are; the others are joined by the word. With ``all_ranked``, that every word is among the frequent ones,
    there is nothing to join.
    """
    known = _looked_up(rows, ranks)
    pairs = F.arrays_zip(F.col("_beyond").alias("beyond"), F.col("_n").alias("n"))
    if all_ranked:
        known = known.withColumn("_ranks", pairs)
    else:
        known = cut(known)
        last = ranks.groupBy("lang").agg((F.max("beyond") + 1).alias("_last"))
        rare = known.select("_row", "lang", F.inline(F.arrays_zip(F.col("_rare").alias("word"), F.col("_rare_n").alias("n"))))
        rare = rare.join(ranks.select("lang", "word", "beyond"), ["lang", "word"], "left").join(F.broadcast(last), "lang", "left")
        rare = rare.groupBy("_row").agg(F.collect_list(F.struct(F.coalesce("beyond", "_last", F.lit(1.0)).alias("beyond"), "n")).alias("_others"))
        none = F.array().cast("array<struct<beyond:double,n:bigint>>")
        known = known.join(rare, "_row", "left").withColumn("_ranks", F.concat(pairs, F.coalesce("_others", none))).drop("_others")
    known = known.withColumn("_ranks", F.sort_array("_ranks")).withColumn("_words", F.aggregate("_ranks", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]))
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), *[F.lit(None).cast("double").alias(c) for c in COVERAGE])

    def step(a: Column, x: Column) -> Column:
        upto = a["upto"] + x["n"]
        return F.struct(upto.alias("upto"), *[F.coalesce(a[c], F.when(upto >= F.col("_words") * F.lit(s) - F.lit(1e-9), x["beyond"])).alias(c) for c, s in zip(COVERAGE, shares, strict=True)])

    covered = known.withColumn("_c", F.aggregate("_ranks", start, step)).withColumn("sentence", F.log(F.col("_words") / F.col("sentences")))
    return covered.select("*", *[f"_c.{c}" for c in COVERAGE]).drop("_c", "_ranks", "_beyond", "_n", "_rare", "_rare_n", "_words")


def _profiles(samples: DataFrame) -> tuple[DataFrame, list[list[float]]]:
    """(lang, profiles), for each language and for NULL over all of them the means of the features by grade; and the inverse of their covariance within language and grade.

    Means and products are summed in SQL; the driver inverts one matrix of the few features.
    """
    both = samples.select("lang", "grade", *FEATURES).unionByName(samples.select(F.lit(None).cast("string").alias("lang"), "grade", *FEATURES))
    means = both.groupBy("lang", "grade").agg(*[F.avg(f).alias(f) for f in FEATURES])
    within = Window.partitionBy("lang", "grade")
    off = samples.select(*[(F.col(f) - F.avg(f).over(within)).alias(f) for f in FEATURES])
    row = off.agg(*[F.coalesce(F.avg(F.col(f) * F.col(g)), F.lit(0.0)) for f in FEATURES for g in FEATURES]).first()
    spread_of = np.array(row, dtype=float).reshape(len(FEATURES), len(FEATURES))
    spread_of += np.diag(RIDGE**2 * np.diag(spread_of) + LEAST_SPREAD**2)
    return means.groupBy("lang").agg(F.collect_list(F.struct("grade", *FEATURES)).alias("profiles")), np.linalg.inv(spread_of).tolist()


def grades(df: DataFrame, id_col: str, text_col: str, samples: DataFrame, fitted: tuple) -> DataFrame:
    """(id, grade): the grade whose profile the features of a document are nearest to, ties to the lower grade.

    ``samples`` has lang, grade and text. NULL, empty and blank texts, and texts without a running line, have no row; repeated rows have theirs
    each. A language without samples, or a text without a known word, is compared with the profiles over all languages. Without samples there is no row.
    """
    spark = df.sparkSession
    docs = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_text IS NOT NULL"))
    rows = docs.select("_id", prepared_column(F.col("_text"), spark, fitted).alias("p")).filter("p.words IS NOT NULL")
    # texts without a known word are ranked among themselves
    rows = cut(rows.select("_id", "p.*").withColumns({"lang": F.coalesce("lang", F.lit("und")), "_row": F.monotonically_increasing_id()}))
    graded = samples.select(F.col("grade").cast("bigint").alias("grade"), F.col("text").alias("_text"), F.lower("lang").alias("_lang")).filter("_text IS NOT NULL AND grade IS NOT NULL")
    graded = graded.select("grade", prepared_column(F.col("_text"), spark, fitted, F.col("_lang")).alias("p")).filter("p.words IS NOT NULL")
    graded = cut(graded.select("grade", "p.*").withColumn("_row", F.monotonically_increasing_id()))
    ranks = cut(word_ranks(rows.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))))))
    profiles, inverse = _profiles(cut(_features(graded, ranks, False)))
    profiles = cut(profiles)
    documents = _features(rows, ranks, ranks.count() <= HEAD_WORDS)
    whole = profiles.filter("lang IS NULL").first()
    if whole is None:
        return documents.filter(F.lit(False)).select(F.col("_id").alias("id"), F.lit(None).cast("bigint").alias("grade"))
    overall = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in p.asDict().items()]) for p in whole["profiles"]])
    joined = documents.join(F.broadcast(profiles.filter("lang IS NOT NULL").withColumnRenamed("profiles", "_own")), "lang", "left")

    def away(p: Column) -> Column:
        off = [F.col(f) - p[f] for f in FEATURES]
        return sum((F.lit(inverse[i][j]) * off[i] * off[j] for i in range(len(off)) for j in range(len(off))), F.lit(0.0))

    nearest = F.array_min(F.transform(F.coalesce(F.col("_own"), overall), lambda p: F.struct(away(p).alias("away"), p["grade"].alias("grade"))))
    return joined.select(F.col("_id").alias("id"), nearest["grade"].alias("grade"))
