"""Licence scans: a trained paragraph classifier, in DataFrame and SQL operations (and Spark ML) only.

Paragraphs are runs of lines with words; their lines are joined, so notices may be wrapped. They are looked at in windows of
words, half of each shared with the next, that become sparse vectors of word pairs and triples. A multinomial logistic
regression over the pairs and triples of licence notices tells families and an unknown class apart; its bound is calibrated
on rows held out from training; and a prediction counts only if the window holds enough of one of the family's notices and
the whole name of the licence, where the notice has one: a notice of a licence that differs by a word of its name is unknown.

Some notices stand in several licences. Which one is read from what follows: the version number of the GNU licences and
whether a later one may be chosen, within AHEAD words; the clauses of BSD licences in the whole text.

Texts without any key word are not looked at further. Key words are chosen so that a window without one can't hold enough of
any notice, so nothing is lost.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Families and short notices that name them (fixed values, public texts).
NOTICES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "lgpl": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "This work is licensed under the GNU Lesser General Public License."],
    "agpl": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "This work is licensed under the GNU Affero General Public License."],
    "bsd-2-clause": ["Licensed under the BSD 2-Clause License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-3-clause": ["Licensed under the BSD 3-Clause License."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "proprietary": ["All rights reserved."],
}
#: Names of licences as they stand in notices (fixed values).
NAMES = [
    "Apache License, Version 2.0", "MIT License", "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License", "BSD 2-Clause License",
    "BSD 3-Clause License", "Mozilla Public License", "Eclipse Public License", "CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC BY-SA 4.0",
    "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License",
]
UNKNOWN = "unknown"
#: Families whose licences are told apart by a version number, and how many words after a notice it stands at most.
VERSIONED, AHEAD = ("gpl", "lgpl", "agpl"), 24
#: The clauses that tell BSD licences apart (fixed values), and the lines near another licence's notice in which "All rights
#: reserved." belongs to that licence.
BINARY, ENDORSE, NEAR = "redistributions in binary form", "neither the names? of", 40
#: Different corpus windows that stand for the unknown class in training (those with the smallest hashes), the share of a
#: notice that a window must hold, and words of a notice below which it must begin a sentence.
SAMPLE, CONFIRM, SHORT = 1_000, 0.7, 5
_SPLIT, _NUMBER = r"[^\p{L}\p{N}]+", "\x01"
#: Words put into notices for training: a name with one of them in it is another licence's name.
STRANGE = ("lesser", "open", "academic", "simple", "european", "personal")


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def plain_grams(words: list[str]) -> list[str]:
    """Pairs and triples of words, each once."""
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)))


class Notice:
    def __init__(self, family: str, text: str) -> None:
        self.family, self.text, self.words = family, text, plain_words(text)
        self.grams = plain_grams(self.words)
        joined = f" {' '.join(self.words)} "
        names = [plain_words(n) for n in NAMES if f" {' '.join(plain_words(n))} " in joined]
        self.name = max(names, key=len, default=[])
        self.name_grams = [" ".join(self.name[i : i + 2]) for i in range(len(self.name) - 1)]

    def keys(self) -> set[str]:
        """Words of which a window must hold one: the longest of the name, else the longest ones that take part in so many of
        the grams that the others aren't enough."""
        if self.name:
            return {max(self.name, key=len)}
        found: set[str] = set()
        for w in sorted(set(self.words), key=lambda w: (-len(w), w)):
            if sum(not found & set(g.split()) for g in self.grams) < CONFIRM * len(self.grams):
                break
            found.add(w)
        return found


def notices(families: dict[str, list[str]]) -> list[Notice]:
    return [Notice(f, t) for f, texts in families.items() for t in texts]


def words_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), _SPLIT), lambda w: w != "")


def _listed(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _grams(words: Column) -> Column:
    n, none = F.size(words), F.array().cast("array<string>")
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))).otherwise(none)
    triples = F.when(n > 2, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))).otherwise(none)
    return F.concat(pairs, triples)


def _once(expression: Column, name: str) -> Column:
    """Computed once, however often it is named later: an explosion of one element."""
    return F.explode(F.array(expression)).alias(name)


class Finder:
    """What follows from the notices alone."""

    def __init__(self, families: dict[str, list[str]] | None = None) -> None:
        self.notices = notices(NOTICES if families is None else families)
        self.families = [*dict.fromkeys(n.family for n in self.notices), UNKNOWN]
        self.vocabulary = sorted({g for n in self.notices for g in n.grams})
        self.keys = sorted(set().union(*(n.keys() for n in self.notices)))
        self.reach = max(len(n.words) for n in self.notices)
        #: Key words of a few letters stand in many words; what follows them in a name is looked for with them.
        pairs = [(k, next((g for g in n.name_grams if k in g.split()), k)) for n in self.notices for k in n.keys() if len(k) < 5]
        self.pairs = sorted({r"[^\p{L}\p{N}]+".join(map(re.escape, g.split())) for _, g in pairs})
        short = ["[^\\p{L}\\p{N}]+".join(map(re.escape, n.words)) for n in self.notices if len(n.words) < SHORT]
        self.begins = rf"(?i)(?:^|[^\p{{L}}\p{{N}}\s]|\d|^.*copyright.*)\s*(?:{'|'.join(short) or '(?!)'})"

    def has_key(self, text: Column) -> Column:
        """True wherever a key word stands; sometimes elsewhere."""
        return F.exists(F.array(F.lower(text)), lambda x: reduce(lambda a, b: a | b, [*(F.contains(x, F.lit(k)) for k in self.keys if len(k) > 4), *(F.rlike(x, F.lit(p)) for p in self.pairs)]))

    def windows(self, docs: DataFrame) -> DataFrame:
        """``id, doc_id, clauses, paragraph, at, words`` (with their lines), ``after`` (words that follow) of all windows with a key
        word. ``id``: of the row."""
        clauses = [F.rlike("text", F.lit("(?i)" + c.replace(" ", r"[^\p{L}\p{N}]+"))).alias(n) for c, n in ((BINARY, "binary"), (ENDORSE, "endorse"))]
        rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("id")).where(self.has_key(F.col("text")))
        numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(i.cast("string"), F.lit(_NUMBER), x)), "\n")
        blank = rf"(?:^|\n)\d+{_NUMBER}[^\p{{L}}\p{{N}}\n]*(?=\n|\z)"
        rows = rows.select("id", "doc_id", F.struct(*clauses).alias("clauses"), F.posexplode(F.split(numbered, blank)).alias("paragraph", "part")).where(self.has_key(F.col("part")))

        split = F.filter(F.split("part", "\n"), lambda x: x != "")
        plain = F.transform(split, lambda x: F.struct(F.substring_index(x, _NUMBER, 1).cast("long").alias("n"), F.regexp_replace(x, rf"^\d+{_NUMBER}", "").alias("text")))
        lines = F.transform(plain, lambda x: F.struct(x.n.alias("n"), words_of(x.text).alias("words"), F.rlike(x.text, F.lit(self.begins)).alias("ok")))
        words = F.flatten(F.transform(lines, lambda x: F.transform(x.words, lambda w: F.struct(w.alias("w"), x.n.alias("n"), x.ok.alias("ok")))))
        rows = rows.select("id", "doc_id", "clauses", "paragraph", _once(words, "all"))
        last = F.greatest(F.lit(0), F.ceil(F.size("all") / self.reach) - 2)
        parts = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct(i.alias("at"), F.slice("all", (i * self.reach + 1).cast("int"), F.lit(2 * self.reach)).alias("words"), F.transform(F.slice("all", ((i + 2) * self.reach + 1).cast("int"), F.lit(self.reach + AHEAD)), lambda x: x.w).alias("after")))
        parts = F.filter(parts, lambda x: F.exists(x.words, lambda y: y.w.isin(self.keys)))
        return rows.select("id", "doc_id", "clauses", "paragraph", F.explode(parts).alias("x")).select("id", "doc_id", "clauses", "paragraph", "x.at", "x.words", "x.after")

    def with_grams(self, rows: DataFrame) -> DataFrame:
        known = F.array_intersect(_grams(F.col("words.w")), _listed(self.vocabulary))
        return rows.select("*", _once(known, "grams")).where(F.size("grams") > 0)

    def held(self, grams: Column) -> Column:
        """Of each notice the share that the grams hold; 0 without its whole name."""
        shares = []
        for n in self.notices:
            share = F.size(F.array_intersect(grams, _listed(n.grams))) / F.lit(float(len(n.grams)))
            shares.append(F.when(F.size(F.array_intersect(grams, _listed(n.name_grams))) == len(n.name_grams), share).otherwise(F.lit(0.0)) if n.name else share)
        return F.array(*shares)


class Classifier:
    """The regression, fitted on notices and on a bounded sample of the corpus, and its calibrated bound."""

    def __init__(self, docs: DataFrame, sample: int = SAMPLE, families: dict[str, list[str]] | None = None) -> None:
        self.finder = Finder(families)
        rows = written(training_rows(docs, self.finder, sample), "training")
        self.vectors = CountVectorizerModel.from_vocabulary(self.finder.vocabulary, "grams", "features", minTF=1.0)
        label = reduce(lambda c, f: c.when(F.col("family") == f, float(self.finder.families.index(f))), self.finder.families, F).cast("double")
        data = self.vectors.transform(rows.select("held", label.alias("label"), "family", "grams"))
        fit = LogisticRegression(maxIter=60, regParam=2e-4, elasticNetParam=0.2, family="multinomial")
        self.model = fit.fit(data.where("not held").select("label", "features").coalesce(1))
        wrong = self.predict(rows.where("held")).where((F.col("family") == UNKNOWN) & (F.col("guess") != UNKNOWN))
        #: A family's probability must exceed what all but one in twenty of the held-out unknown rows that are taken for
        #: a family reach, and a half.
        self.bound = min(0.9, max(0.5, wrong.agg(F.percentile("probability", F.lit(0.95))).first()[0] or 0.0))

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``guess`` and ``probability`` by ``grams``."""
        found = self.model.transform(self.vectors.transform(rows)).withColumn("p", vector_to_array("probability")).drop("probability", "rawPrediction", "features")
        guess = F.element_at(_listed(self.finder.families), F.col("prediction").cast("int") + 1)
        return found.withColumn("guess", guess).withColumn("probability", F.round(F.array_max("p"), 6)).drop("p", "prediction")


def training_rows(docs: DataFrame, finder: Finder, sample: int = SAMPLE) -> DataFrame:
    """``family, grams, held``: notices as they are, without a word at either end, and with text around them; for the unknown
    class notices with a strange word in the name, beginnings of notices, and windows of the corpus that hold a key word but
    no notice, each once. ``held``: every fifth row, for calibration."""
    plain: list[tuple[str, str]] = []
    for n in finder.notices:
        text = " ".join(n.words)
        plain += [(n.family, x) for x in (text, f"copyright 2024 {text}", f"{text} see the file for more", f"the files here are {text} and so on", f"note {text}")]
        if len(n.words) > 6:
            plain += [(n.family, " ".join(n.words[1:])), (n.family, " ".join(n.words[:-1]))]
        plain += [(UNKNOWN, " ".join(n.words[: len(n.words) // k])) for k in (2, 3, 4)]
        for k, w in enumerate(x for x in STRANGE if x not in n.words):
            i = 1 + k % max(1, len(n.name) - 1) if n.name else 0
            if n.name:
                plain.append((UNKNOWN, text.replace(" ".join(n.name), " ".join([*n.name[:i], w, *n.name[i:]]))))
                plain.append((UNKNOWN, text.replace(" ".join(n.name), " ".join([*n.name[: i - 1], w, *n.name[i:]]))))
    known = {f" {' '.join(n.name)} " for n in finder.notices if n.name}
    plain = [(f, t) for f, t in dict.fromkeys(plain) if f != UNKNOWN or not any(x in f" {t} " for x in known)]
    given = docs.sparkSession.createDataFrame(plain, "family string, line string").select("family", _grams(words_of(F.col("line"))).alias("grams"), F.xxhash64("line").alias("h"))
    corpus = finder.with_grams(finder.windows(docs)).where(F.array_max(finder.held(F.col("grams"))) < CONFIRM)
    corpus = corpus.select(F.array_sort("grams").alias("grams")).distinct().withColumn("h", F.xxhash64("grams")).orderBy("h", "grams").limit(sample)
    return given.unionByName(corpus.withColumn("family", F.lit(UNKNOWN))).select("family", "grams", (F.pmod("h", F.lit(5)) == 0).alias("held"))


def member(family: Column, following: Column, clauses: Column) -> Column:
    """The licence of a family by the words from its notice on and by its text's clauses; without a version, or without
    clauses, the family alone."""
    number = r"(?:^| )(?:version|v) ?([0-9])(?: ([0-9])(?: |$))?"
    major, minor = F.regexp_extract(following, number, 1), F.regexp_extract(following, number, 2)
    later = F.when(F.rlike(following, F.lit(r"(?:any|or) later")), "-or-later").otherwise("")
    version = F.when(major == "", "").otherwise(F.concat(F.lit("-"), major, F.lit("."), F.when(minor == "", "0").otherwise(minor), later))
    bsd = F.when(clauses["endorse"], "bsd-3-clause").when(clauses["binary"], "bsd-2-clause").otherwise("bsd")
    return F.when(family.isin(*VERSIONED), F.concat(family, version)).when(family == "bsd", bsd).otherwise(family)


def scan(docs: DataFrame, sample: int = SAMPLE, families: dict[str, list[str]] | None = None) -> DataFrame:
    """``doc_id, paragraph, family, probability, similarity`` of each licence notice in ``docs`` (``doc_id, text``; other
    columns play no part).

    paragraph: the number of the line where the notice begins, from 0; probability: the family's, above the calibrated bound;
    similarity: the share of the notice's pairs and triples that stand there, at least CONFIRM, its name whole. A notice of
    fewer than SHORT words must begin a line or a sentence. family: of GNU licences with the version that follows (``gpl-2.0``,
    ``lgpl-2.1-or-later``), without one ``gpl``; a BSD text with its third clause ``bsd-3-clause``, with the second alone
    ``bsd-2-clause``, with neither ``bsd``; ``proprietary`` only where no other notice is within NEAR lines. Several notices on one line have a row for each family. Null,
    empty and blank texts have no paragraphs; texts of any length count whole; repeated rows give repeated results; null ids
    stay. A table without text trains on the notices alone.
    """
    model = Classifier(docs, sample, families)
    finder = model.finder
    rows = finder.with_grams(finder.windows(docs)).select("*", _once(finder.held(F.col("grams")), "shares"))
    cases = []
    for i, n in enumerate(finder.notices):
        own = F.array_intersect("grams", _listed(n.grams))
        # Another notice that holds most of the same grams and more of itself is what stands there.
        more = [F.get("shares", F.lit(j)) > F.get("shares", F.lit(i)) for j, o in enumerate(finder.notices) if o.family != n.family and 2 * len(set(o.grams) & set(n.grams)) >= len(n.grams)]
        worse = reduce(lambda a, b: a | b, more, F.lit(False))
        fits = (F.get("shares", F.lit(i)) >= CONFIRM) & ~worse
        cases.append(F.when(fits, F.struct(F.lit(i).alias("notice"), F.lit(n.family).alias("family"), F.lit(len(n.words)).alias("length"), F.get("shares", F.lit(i)).alias("similarity"), own.alias("own"), _listed(n.grams).alias("whole"))))
    rows = rows.select("id", "doc_id", "clauses", "paragraph", "at", "words", "after", F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("c"))
    pair = lambda i: F.concat_ws(" ", F.element_at("words.w", i), F.element_at("words.w", i + 1))
    first = F.array_min(F.filter(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.array_contains(F.col("c.whole"), pair(i))))
    rows = rows.select("*", _once(first, "first"))
    following = F.array_join(F.slice(F.concat("words.w", "after"), F.col("first"), F.col("c.length") + AHEAD), " ")
    rows = rows.select("id", "doc_id", "clauses", "paragraph", "at", "c.*", "first", F.element_at("words", F.col("first")).alias("word"), following.alias("following"))
    rows = rows.where((F.col("length") >= SHORT) | F.col("word.ok")).withColumnRenamed("own", "grams")
    found = model.predict(rows).where((F.col("guess") == F.col("family")) & (F.col("probability") > model.bound))
    # A notice at the end of a window stands at the beginning of the next one too.
    place = F.col("at") * finder.reach + F.col("first")
    before = F.lag(place).over(Window.partitionBy("id", "paragraph", "notice").orderBy("at"))
    found = found.withColumn("same", F.coalesce(place - before < F.col("length"), F.lit(False))).where("not same")
    found = found.withColumn("family", member(F.col("family"), F.col("following"), F.col("clauses")))
    found = found.groupBy("id", "doc_id", F.col("word.n").alias("line"), "family").agg(F.max("probability").alias("probability"), F.round(F.max("similarity"), 6).alias("similarity"))
    others = F.count_if(F.col("family") != "proprietary").over(Window.partitionBy("id").orderBy("line").rangeBetween(-NEAR, NEAR))
    found = found.withColumn("others", others).where("family != 'proprietary' or others = 0")
    return found.select("doc_id", F.col("line").alias("paragraph"), "family", "probability", "similarity")
