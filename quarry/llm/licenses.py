"""Licence scans by a positional index of rare words.

Templates are short passages of licences and notices, each with a phrase that
must stand word for word. A first pass counts in how many documents each licence
word stands. A template's anchors are its words of the highest inverse document
frequency; the index has for each anchor word its (template, position) postings.
A document's words are looked up; a hit at word p on a posting at q votes for the
template starting at word p - q, and postings are intersected by that start. A
passage may differ from its template in a fifth of the words, so a template has
two anchors more than may differ, and two must agree on a start: no passage is
lost. What is left is compared word by word, and the key phrase checked.

Words are compared by 64-bit hashes; a passage has four words or more.
"""

from __future__ import annotations

import itertools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quarry.llm import spans

LEAST_AGREEMENT = 0.8
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Phrases whose every place counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Template(NamedTuple):
    label: str
    text: str
    key: str


#: Passages as they stand in the licences and in notices, with the phrase that must stand (fixed values).
PASSAGES = [
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License", "except in compliance with the License"),
    Template("mit", "released under the MIT License", "the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "free of charge, to any person obtaining a copy of this software"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistribution and use in source and binary forms"),
    Template("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License, v. 2.0"),
    Template("mpl-2.0", "under the Mozilla Public License, version 2.0", "Mozilla Public License, version 2.0"),
    Template("epl-2.0", "under the Eclipse Public License, version 2.0", "Eclipse Public License, version 2.0"),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", "Boost Software License, Version 1.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template("zlib", "In no event will the authors be held liable for any damages arising from the use of this software", "will the authors be held liable for any damages"),
    Template("cc0-1.0", "CC0 1.0 Universal", "CC0 1.0 Universal"),
]


def templates() -> list[Template]:
    """PASSAGES, and those of the families whose names follow a rule: elements and versions."""
    out = list(PASSAGES)
    for kind, label in (("", "gpl"), ("Lesser ", "lgpl"), ("Affero ", "agpl")):
        for version, written_ in itertools.product(("2", "2.1", "3"), ("version ", "v")):
            name = f"GNU {kind}General Public License {written_}{version}"
            out.append(Template(f"{label}-{version if '.' in version else version + '.0'}", name, name))
    names = {"nc": ("NonCommercial", "Non-Commercial"), "sa": ("ShareAlike", "Share Alike"), "nd": ("NoDerivatives", "NoDerivs")}
    for parts in ((), ("sa",), ("nd",), ("nc",), ("nc", "sa"), ("nc", "nd")):
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            label = "-".join(("cc-by", *parts, version))
            for name in (" ".join(("CC BY", *parts, version)), *(" ".join(("Creative Commons Attribution", *spelt, version)) for spelt in itertools.product(*(names[p] for p in parts)))):
                out.append(Template(label, name, name))
    return out


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def hashed(words: list[str]) -> np.ndarray:
    return spans.word_hashes(pa.array([" ".join(words)]), False, spans.PUNCT)[0]


class Index:
    """Postings of the templates' anchors. seen: in how many documents each licence word stands."""

    def __init__(self, found: list[Template], seen: dict[str, int], agreement: float = LEAST_AGREEMENT):
        self.labels, self.words, self.must, self.most, self.least = [], [], [], [], []
        postings = []
        for k, t in enumerate(found):
            words, key = words_of(t.text), words_of(t.key)
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            differ = int((1 - agreement) * len(words) + 1e-9)
            rare = sorted(range(len(words)), key=lambda i: (seen.get(words[i], 0), i))[: differ + 2]
            hashes = hashed(words)
            self.labels.append(t.label)
            self.words.append(hashes)
            self.must.append(slice(at, at + len(key)))
            self.most.append(differ)
            self.least.append(len(rare) - differ)
            postings += [(int(hashes[i]), k, i) for i in rare]
        postings.sort()
        all_ = np.array([p[0] for p in postings], np.uint64)
        self.keys, self.first, self.times = np.unique(all_, return_index=True, return_counts=True)
        self.template, self.position = (np.array([p[i] for p in postings], np.int64) for i in (1, 2))
        self.least = np.array(self.least, np.int64)

    def passages(self, h: np.ndarray, own: np.ndarray):
        """(text, template, start word, words that agree) of each accepted passage; own: bounds of the texts' words in h."""
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[k] == h)
        k = k[hits]
        times = self.times[k]
        posting = np.repeat(self.first[k] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        at = np.repeat(hits, times)
        votes = np.stack([np.searchsorted(own, at, "right") - 1, self.template[posting], at - self.position[posting]], axis=1)
        if not len(votes):
            return
        starts, n = np.unique(votes, axis=0, return_counts=True)
        for text, t, start in starts[n >= self.least[starts[:, 1]]].tolist():
            wanted = self.words[t]
            a, b = max(start, int(own[text])), min(start + len(wanted), int(own[text + 1]))
            agree = np.zeros(len(wanted), bool)
            agree[a - start : b - start] = h[a:b] == wanted[a - start : b - start]
            if len(wanted) - agree.sum() <= self.most[t] and agree[self.must[t]].all():
                yield text, t, start, int(agree.sum())


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return spans.word_hashes(texts, True, spans.PUNCT)


def seen_in(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many rows each word of the vocabulary stands."""
    order = sorted(zip((int(hashed([w])[0]) for w in vocabulary), vocabulary, strict=True))
    keys = np.array([x[0] for x in order], np.uint64)

    def run(parts):
        total = np.zeros(len(keys), np.int64)
        for part in parts:
            for i, j in spans.batches(part.column(0)):
                h, own = words_in(part.column(0).slice(i, j - i))
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hits = np.flatnonzero(keys[k] == h)
                text = np.searchsorted(own, hits, "right") - 1
                total += np.bincount(np.unique(text * len(keys) + k[hits]) % len(keys), minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys))), pa.array(total)], ["word", "n"])

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {order[r["word"]][1]: r["n"] for r in counts.collect()}  # a row a licence word


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", found: list[Template] | None = None, base: dict[str, str] | None = None, agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """The columns keep, n_words, base_places (label and start word of every base phrase) and passages (label, start word, share of its words that agree).

    Both arrays are in order of their start words. Null and empty texts have no words
    and empty arrays. Rows are scanned alone, but for the rarity of words, which is that
    of the whole table: repeated rows agree, null ids are kept, an empty table stays
    empty. Other columns are left out.
    """
    found, base = templates() if found is None else found, BASE if base is None else base
    index = Index(found, seen_in(docs, sorted({w for t in found for w in words_of(t.text)}), text_col), agreement)
    phrases = [(label, hashed(words_of(phrase))) for phrase, label in base.items()]
    place = StructType().add("label", "string").add("start", "long")
    schema = docs.select(*keep).schema.add("n_words", "long").add("base_places", ArrayType(place)).add("passages", ArrayType(StructType([*place.fields]).add("agreement", "double")))
    places = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("agreement", pa.float64())]))

    def scanned(texts: pa.Array):
        h, own = words_in(texts)
        base_, more = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
        for label, wanted in phrases:
            n = max(0, len(h) - len(wanted) + 1)
            at = np.flatnonzero(h[:n] == wanted[0])
            for i in range(1, len(wanted)):
                at = at[h[at + i] == wanted[i]]
            text = np.searchsorted(own, at, "right") - 1
            ok = at + len(wanted) <= own[text + 1]
            for d, p in zip(text[ok].tolist(), (at[ok] - own[text[ok]]).tolist(), strict=True):
                base_[d].append({"label": label, "start": p})
        for d, t, start, n in index.passages(h, own):
            more[d].append({"label": index.labels[t], "start": start - int(own[d]), "agreement": n / len(index.words[t])})
        by = lambda x: (x["start"], x["label"])
        return np.diff(own), [sorted(x, key=by) for x in base_], [sorted(x, key=by) for x in more]

    def run(parts):
        for part in parts:
            n, base_, more = [], [], []
            for i, j in spans.batches(part.column("__text")):
                a, b, c = scanned(part.column("__text").slice(i, j - i))
                n += a.tolist()
                base_ += b
                more += c
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(base_, places), pa.array(more, found_type)], schema.names)

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and places; score is the largest share of a licence's or phrase's words that agree, 0 without any."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.when(F.size("base_places") > 0, 1.0).otherwise(F.coalesce(F.array_max("passages.agreement"), F.lit(0.0)))
    return out.select("doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min("base_places.start").alias("first_word"), F.array_max("base_places.start").alias("last_word"), joined(F.col("base_places.label")).alias("base_labels"), joined(F.concat("base_places.label", "passages.label")).alias("labels"), score.alias("score"))
