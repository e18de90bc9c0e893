"""License scans: a positional index of license words, entered by the rarest words a file holds.

The words of all license templates are a fixed vocabulary. A first pass counts how many documents hold each of them;
the rarest words of a template (highest inverse document frequency) are its postings in the index. A second pass
looks up the rare license words of each file, places the templates they come from by relative position, and keeps a
template where enough of its rare words stand in line and its mandatory phrases stand there word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.leaks import words_of
from palisade.llm.spans import batches

SLICE_BYTES = 2 << 20
RARE_WORDS = 8  # postings of a template
SLACK = 8  # words that a file may add or leave out between two of them
LEAST_SHARE = 0.5  # of the weight of a template's postings


@dataclass(frozen=True)
class Template:
    """A notice and the phrases it cannot do without; an exact one is a phrase that has to stand as it is."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()

    @property
    def exact(self) -> bool:
        return not self.phrases


# Phrases whose every occurrence counts, and the notices of common licenses.
PHRASES = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)
NOTICES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at",
        ("you may not use this file except in compliance with the license",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "bsd-3",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission",
        ("endorse or promote products derived from this software",),
    ),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template(
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
        "by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu general public license as published by the free software foundation", "version 3 of the license"),
    ),
    Template(
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
        "by the free software foundation either version 2 of the license or at your option any later version",
        ("gnu general public license as published by the free software foundation", "version 2 of the license"),
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        ("gnu lesser general public license",),
    ),
    Template("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at",
        ("mozilla public license v 2 0",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template(
        "cc-by-nc",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        ("creative commons attribution noncommercial",),
    ),
    Template(
        "cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)
    ),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
)
TEMPLATES = PHRASES + NOTICES

PLACE = "struct<label:string,template:int,start:long,end:long,score:double,exact:boolean>"


def vocabulary(templates: Sequence[Template]) -> list[str]:
    """All words of the templates and their phrases, in order."""
    return sorted({w for t in templates for text in (t.text, *t.phrases) for w in text.split()})


def weigh(words: Sequence[str], held: dict[str, int], documents: int) -> dict[str, float]:
    """Inverse document frequency of each word, above zero."""
    return {w: 1.0 + math.log((1 + documents) / (1 + held.get(w, 0))) for w in words}


def rare_positions(words: Sequence[str], weights: dict[str, float], most: int) -> list[int]:
    """Positions of the `most` rarest distinct words of a template, each at its first place; ties by the word."""
    first = {w: i for i, w in reversed(list(enumerate(words)))}
    ranked = sorted(first, key=lambda w: (-weights[w], w))[:most]
    return sorted(first[w] for w in ranked)


@dataclass
class _Words:
    """The vocabulary by hash: sorted hashes, and a table of their low bits that rules most other words out."""

    hashes: np.ndarray
    sieve: np.ndarray
    number: dict[str, int]

    @classmethod
    def of(cls, words: Sequence[str]) -> _Words:
        hashes, _ = words_of(pa.array(list(words), pa.string()))
        order = np.argsort(hashes)
        sieve = np.zeros(1 << 16, dtype=bool)
        sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        return cls(hashes[order], sieve, {words[w]: i for i, w in enumerate(order)})

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the vocabulary's words among the hashes, and which word each is."""
        at = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        word = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        hit = self.hashes[word] == hashes[at]
        return at[hit], word[hit]


def count_documents(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> tuple[dict[str, int], int]:
    """How many documents hold each word of the templates, and how many there are: one row a word reaches the driver."""
    words = vocabulary(templates)
    known = _Words.of(words)
    n_words = len(words)

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_words + 1, dtype=np.int64)
        for table in tables:
            for part in batches(pa.Table.from_batches([table]), SLICE_BYTES, "text"):
                hashes, bounds = words_of(part["text"])
                at, word = known.find(hashes)
                doc = np.searchsorted(bounds, at, side="right") - 1
                held[:-1] += np.bincount(np.unique(doc * n_words + word) % n_words, minlength=n_words)
                held[-1] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_words + 1, dtype=np.int32)), pa.array(held)], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    total = {r["word"]: int(r["n"]) for r in rows}
    return {w: total.get(i, 0) for w, i in known.number.items()}, total.get(n_words, 0)


@dataclass
class Index:
    """Postings of the templates' rare words, and each phrase with its rarest word."""

    templates: tuple[Template, ...]
    known: _Words
    postings: list[list[tuple[int, int, float]]]  # of each template: word, position in it, weight; empty if exact
    phrases: list[tuple[np.ndarray, int]]  # words, and which of them is looked up
    own: list[list[int]]  # phrases of each template

    @classmethod
    def build(cls, templates: Sequence[Template], held: dict[str, int], documents: int) -> Index:
        words = vocabulary(templates)
        known, weights = _Words.of(words), weigh(words, held, documents)
        postings, phrases, own = [], [], []
        for t in templates:
            split = t.text.split()
            postings.append([] if t.exact else [(known.number[split[p]], p, weights[split[p]]) for p in rare_positions(split, weights, RARE_WORDS)])
            own.append([])
            for phrase in t.phrases or (t.text,):
                parts = phrase.split()
                own[-1].append(len(phrases))
                phrases.append((np.array([known.number[w] for w in parts]), rare_positions(parts, weights, 1)[0]))
        return cls(tuple(templates), known, postings, phrases, own)

    def places(self, hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """document, template, start, end (words in all texts) and score of every verified place, by document and start."""
        at, word = self.known.find(hashes)
        order = np.argsort(word, kind="stable")
        lo = np.searchsorted(word[order], np.arange(len(self.known.hashes) + 1))
        where = [at[order[lo[w] : lo[w + 1]]] for w in range(len(self.known.hashes))]
        begin = lambda spots: bounds[np.searchsorted(bounds, spots, side="right") - 1]
        end = lambda spots: bounds[np.searchsorted(bounds, spots, side="right")]

        found = []
        for parts, rarest in self.phrases:
            spots = where[parts[rarest]]
            starts = spots - rarest
            inside = (starts >= begin(spots)) & (starts + len(parts) <= end(spots)) if len(spots) else np.zeros(0, dtype=bool)
            starts = starts[inside]
            for i, w in enumerate(parts):
                starts = starts[hashes[starts + i] == self.known.hashes[w]]
            found.append(starts)

        out = [[np.zeros(0, dtype=np.int64)] * 4 + [np.zeros(0)]]
        for number, template in enumerate(self.templates):
            size = len(template.text.split())
            if template.exact:
                starts = found[self.own[number][0]]
                out.append([np.searchsorted(bounds, starts, side="right") - 1, np.full(len(starts), number), starts, starts + size, np.ones(len(starts))])
                continue
            placed = self._aligned(number, size, where, bounds)
            keep = np.ones(len(placed[0]), dtype=bool)
            for phrase in self.own[number]:
                spots, length = found[phrase], len(self.phrases[phrase][0])
                first = np.searchsorted(spots, placed[1])
                have = np.append(spots, np.iinfo(np.int64).max - length)
                keep &= have[first] + length <= placed[2]
            doc, starts, ends, score = (a[keep] for a in placed)
            out.append([doc, np.full(len(doc), number), starts, ends, score])
        columns = [np.concatenate(c) for c in zip(*out)]
        order = np.lexsort((columns[1], columns[2], columns[0]))
        return [c[order] for c in columns]

    def _aligned(self, number: int, size: int, where: list[np.ndarray], bounds: np.ndarray) -> list[np.ndarray]:
        """document, start, end and score where enough of a template's rare words stand in line.

        Places of rare words whose offsets to their places in the template follow each other within SLACK words are one
        alignment; its score is the share of the rare words' weight that it holds.
        """
        postings = self.postings[number]
        spots = np.concatenate([where[w] for w, _, _ in postings])
        which = np.repeat(np.arange(len(postings)), [len(where[w]) for w, _, _ in postings])
        weight = np.array([x for _, _, x in postings])
        offset = spots - np.array([p for _, p, _ in postings])[which]
        doc = np.searchsorted(bounds, spots, side="right") - 1
        order = np.lexsort((which, offset, doc))
        doc, offset, which = doc[order], offset[order], which[order]
        if len(doc) == 0:
            return [doc, doc, doc, np.zeros(0)]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (offset[1:] - offset[:-1] > SLACK)]
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(doc)] - 1
        once = np.unique(group * len(postings) + which)
        score = np.bincount(once // len(postings), weights=weight[once % len(postings)], minlength=len(starts)) / weight.sum()
        at = bounds[doc[starts]]
        first = np.maximum(at, offset[starts] - SLACK)
        last = np.minimum(bounds[doc[starts] + 1], offset[ends] + size + SLACK)
        keep = score >= LEAST_SHARE - 1e-12
        return [doc[starts][keep], first[keep], last[keep], np.minimum(score, 1.0)[keep]]


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and places (label, template, start, end, score, exact) of each row of `docs` (doc_id, text).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased, and places are word numbers from 0, end
    exclusive. An exact template stands wherever its words follow each other, overlaps included, with score 1. Any
    other one stands where at least LEAST_SHARE of the weight of its RARE_WORDS rarest words is in line and all its
    phrases occur; start and end hold the notice and SLACK words around it. Weights come from all rows. A null text is
    an empty one: no words, no places. Rows that share an id or a text are judged one by one; other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held, documents = count_documents(docs, templates)
    # Some hundred words at most.
    index = docs.sparkSession.sparkContext.broadcast(Index.build(templates, held, documents))

    def scan(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        labels = np.array([t.label for t in known.templates], dtype=object)
        exact = np.array([t.exact for t in known.templates])
        for table in tables:
            for part in batches(pa.Table.from_batches([table]), SLICE_BYTES, "text"):
                hashes, bounds = words_of(part["text"])
                doc, number, start, end, score = known.places(hashes, bounds)
                fields = [
                    pa.array(labels[number], pa.string()), pa.array(number.astype(np.int32)), pa.array(start - bounds[doc]),
                    pa.array(end - bounds[doc]), pa.array(score), pa.array(exact[number]),
                ]
                places = pa.StructArray.from_arrays(fields, ["label", "template", "start", "end", "score", "exact"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)), places)
                ids = part["doc_id"].combine_chunks()
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), lists], ["doc_id", "n_words", "places"])

    return docs.mapInArrow(scan, f"doc_id long, n_words long, places array<{PLACE}>")


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    """Phrases and licenses that every document holds."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("places", lambda p: p.exact)
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(places.label)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base.start).alias("first_word"),
        F.array_max(base.start).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.col("places.score")), F.lit(0.0)).alias("score"),
    )
