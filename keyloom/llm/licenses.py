"""License scan by a positional index of rare words; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm import common as C

#: The phrases that a license's users are bound to quote, and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: Label, words of the notice, and the key phrases in it that must stand in their places.
NOTICES = [
    ("apache-2", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "source and binary forms"]),
    ("cc-by-4", "creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ["gnu lesser general public license", "version 3"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted", "free of charge"]),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
]

#: A notice's rarest words that are looked up, and the share of its words that must stand in their places.
ANCHORS, LEAST = 3, 0.75


def words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. lower() changes letters above ASCII too, which
    no phrase has; a mark keeps the Kelvin sign, its only one that gives an ASCII letter, from becoming a k."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("K̇")))
    spaced = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _at(phrase: list[str], inner: list[str]) -> int:
    return next(k for k in range(len(phrase)) if phrase[k : k + len(inner)] == inner)


def scan_licenses(docs: DataFrame, base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str, list[str]]] = NOTICES) -> DataFrame:
    """For each document its words' number, the base phrases' places (start, label) and the notices found (start, label, score).

    One scan keeps, of each whole text, the positions of words that some template has. Their document frequencies over all
    documents give each template's rarest words; these make the index: word to (template, position in it). A document's
    occurrences of indexed words vote for starts of templates; a base phrase is then verified word by word (each place has its
    rarest word, so none is missed), a notice by its key phrases in their relative places and LEAST of its words. Null, empty
    or wordless texts have no places; equal rows give equal rows; columns other than doc_id and text are left out.
    """
    spark = docs.sparkSession
    templates = [(p.split(), label, None) for p, label in base] + [(p.split(), label, [(_at(p.split(), k.split()), k.split()) for k in keys]) for label, p, keys in notices]
    vocabulary = sorted({w for t, _, _ in templates for w in t})
    w = F.col("_words")
    known = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(vocabulary))
    hits = F.when(F.size(w) > 0, F.transform(known, lambda i: F.struct(i.alias("at"), F.get(w, i).alias("word")))).otherwise(F.array().cast("array<struct<at:int,word:string>>"))
    kept = C.materialize(docs.select("doc_id", words(F.col("text")).alias("_words")).select("doc_id", F.size("_words").cast("long").alias("n_words"), hits.alias("hits")), "license-hits")
    df = dict(kept.select(F.explode(F.array_distinct(F.col("hits.word"))).alias("word")).groupBy("word").count().collect())  # a row for each word of the templates at most

    index: dict[str, list[tuple[int, int]]] = {}
    for k, (t, _, keys) in enumerate(templates):
        rare = sorted(set(t), key=lambda x: (df.get(x, 0), x))[: 1 if keys is None else ANCHORS]
        for at, word in enumerate(t):
            if word in rare:
                index.setdefault(word, []).append((k, at))
    postings = F.create_map(*[x for word, ps in sorted(index.items()) for x in (F.lit(word), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(at).alias("at")) for k, at in ps]))])
    votes = F.flatten(F.transform(F.filter("hits", lambda h: h.word.isin(sorted(index))), lambda h: F.transform(postings[h.word], lambda p: F.struct(p.k.alias("k"), (h["at"] - p["at"]).alias("start")))))
    found = kept.withColumn("votes", F.array_distinct(votes)).withColumn("place", F.when(F.size("votes") > 0, F.map_from_arrays(F.col("hits.at"), F.col("hits.word"))))

    def score(v: Column) -> Column:
        """Of the template v.k at v.start: the share of its words in place, 0 without its key phrases."""
        out = F.lit(0.0)
        for k, (t, _, keys) in enumerate(templates):
            same = [F.coalesce(F.col("place")[v.start + at] == word, F.lit(False)) for at, word in enumerate(t)]
            share = sum((x.cast("int") for x in same[1:]), same[0].cast("int")) / float(len(t))
            must = range(len(t)) if keys is None else [at + j for at, key in keys for j in range(len(key))]
            sure = same[must[0]]
            for j in must[1:]:
                sure = sure & same[j]
            out = F.when(v.k == k, F.when(sure, share).otherwise(0.0)).otherwise(out)
        return out

    scored = F.filter(F.transform("votes", lambda v: F.struct(v.start.alias("start"), v.k.alias("k"), score(v).alias("score"))), lambda s: s.score >= F.when(s.k < len(base), 1.0).otherwise(LEAST))
    label = F.array(*[F.lit(x[1]) for x in templates])
    found = found.withColumn("scored", F.when(F.size("votes") > 0, scored).otherwise(F.array().cast("array<struct<start:int,k:int,score:double>>")))
    named = F.transform("scored", lambda s: F.struct(s.start.cast("long").alias("start"), F.get(label, s.k).alias("label"), s.score.alias("score"), (s.k < len(base)).alias("base")))
    return found.select("doc_id", "n_words", named.alias("found")).select("doc_id", "n_words", F.filter("found", lambda s: s.base).alias("places"), F.filter("found", lambda s: ~s.base).alias("notices"))


def license_digest(docs: DataFrame) -> DataFrame:
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scan_licenses(docs).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(F.col("places.start")).alias("first_word"), F.array_max(F.col("places.start")).alias("last_word"),
        names(F.col("places.label")).alias("base_labels"), names(F.concat(F.col("places.label"), F.col("notices.label"))).alias("labels"),
        F.coalesce(F.greatest(F.when(F.size("places") > 0, 1.0), F.array_max(F.col("notices.score"))), F.lit(0.0)).alias("score"),
    )
