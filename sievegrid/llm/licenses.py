"""License scans by an exact set-similarity join of text blocks with license templates.

A block of size s is the set of words of 2s words that begin at a multiple of s, so any s words in a row are in one.
A template meets the blocks of the least size (a power of two from 8 on) that holds its words. Block b has template t if
|b & t| >= least * |t|; all such pairs are found, and no others, by

1. length: a block needs as many template words as the least of its size's templates asks for; nearly all blocks
   end here, where their text lies, since few words of prose are words of templates;
2. prefix: template words in order of their counts over all documents, rarest first. With o words to share, a pair
   shares one of the first |t| - o + 1 of the template and one of the first |b| - o + 1 of the block;
3. position: at a shared word, what follows on both sides must be able to reach o;
4. verification on the whole sets.

Words in no template can't be shared, so blocks keep template words only: lists no longer than the templates' vocabulary,
which a template table that is a parameter bounds. Phrases are found by their places and count as whole containment.

Defined cases: a null or empty text has no words, no labels and score 0; a null id is scanned like others; repeated rows get
repeated results; an empty table gives an empty one; texts are whole, of any length; no other column is read; without
templates only phrases are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.textvec import chunks, packed, stretches
from sievegrid.session import stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The bytes that words are made of: digits, letters and all of other scripts.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Phrases that name a license, and the notices by which licenses ask to be declared.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def block_size(template: str) -> int:
    """The least power of two from 8 on that holds the template's words."""
    return max(8, 1 << (len(template.split()) - 1).bit_length())


def required(n: int, least: float) -> int:
    """The number of shared words at which a template of n distinct words is contained."""
    return max(1, int(np.ceil(n * least - 1e-9)))


def _scan(docs: DataFrame, phrases: list[tuple[str, str]], templates: list[tuple[str, str]], least: float, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """(row, id, n_words, places, blocks, seen) of each row, and the vocabulary: blocks have the numbers of template words.

    ``places`` are (start, phrase) of the phrases; ``seen`` has a chunk's counts of the vocabulary, on its first row only.
    """
    sets = [(block_size(t), sorted(set(t.split()))) for _, t in templates]
    vocabulary = sorted({w for _, s in sets for w in s} | {w for p, _ in phrases for w in p.split()})
    number = {w: i for i, w in enumerate(vocabulary)}
    wanted = [[number[w] for w in p.split()] for p, _ in phrases]
    sizes = {}
    for size, words in sets:
        own, few = sizes.setdefault(size, (np.zeros(len(vocabulary), bool), len(words)))
        own[[number[w] for w in words]] = True
        sizes[size] = own, min(few, required(len(words), least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([w.encode() for w in vocabulary], pa.large_binary())
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                rows, data = last - first, _LOWER[data]
                starts, ends, row = stretches(_LETTER[data], offsets)
                code = pc.index_in(packed(data, starts, ends), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                counts = np.bincount(row, minlength=rows)
                begin = np.concatenate([[0], np.cumsum(counts)])
                places: list[list[dict]] = [[] for _ in range(rows)]
                for p, words in enumerate(wanted):
                    at = np.flatnonzero(code[: len(code) - len(words) + 1] == words[0]) if len(code) >= len(words) else np.zeros(0, int)
                    at = at[row[at] == row[at + len(words) - 1]] if len(at) else at
                    for k, w in enumerate(words):
                        at = at[code[at + k] == w]
                    for i in at.tolist():
                        places[row[i]].append({"start": i - int(begin[row[i]]), "phrase": p})
                blocks: list[list[dict]] = [[] for _ in range(rows)]
                at = np.flatnonzero(code >= 0)
                for size, (own, few) in sizes.items():
                    for r, block, words in _blocks(at[own[code[at]]], code, row, begin, size, few):
                        blocks[r].append({"size": size, "block": block, "words": words})
                seen = [np.bincount(code[at], minlength=len(vocabulary)).tolist()] + [None] * (rows - 1)
                place = pa.list_(pa.struct([("start", pa.int64()), ("phrase", pa.int32())]))
                block = pa.list_(pa.struct([("size", pa.int32()), ("block", pa.int64()), ("words", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(counts), pa.array(places, place), pa.array(blocks, block), pa.array(seen, pa.list_(pa.int64()))],
                    names=["id", "n_words", "places", "blocks", "seen"],
                )

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    form = f"id {kind}, n_words long, places array<struct<start:long,phrase:int>>, blocks array<struct<size:int,block:long,words:array<int>>>, seen array<long>"
    return stage(texts.mapInArrow(run, form).withColumn("row", F.monotonically_increasing_id()), "license-parts"), vocabulary


def _blocks(at: np.ndarray, code: np.ndarray, row: np.ndarray, begin: np.ndarray, size: int, few: int) -> Iterator[tuple[int, int, list[int]]]:
    """(row, block, distinct words) of the blocks with ``few`` or more of the words at ``at``."""
    block = (at - begin[row[at]]) // size
    most = int(block.max(initial=0)) + 2
    key = row[at] * most + block
    key, code = np.concatenate([key, key[block > 0] - 1]), np.concatenate([code[at], code[at][block > 0]])
    full = np.bincount(key, minlength=1) >= few
    key, code = key[full[key]], code[full[key]]
    pairs = np.unique(key.astype(np.int64) << 32 | code)
    names, first, n = np.unique(pairs >> 32, return_index=True, return_counts=True)
    for name, a, k in zip(names.tolist(), first.tolist(), n.tolist(), strict=True):
        if k >= few:
            yield name // most, name % most, (pairs[a : a + k] & 0xFFFFFFFF).tolist()


def contained_templates(parts: DataFrame, vocabulary: list[str], templates: list[tuple[str, str]], least: float) -> DataFrame:
    """(row, size, block, label, containment) of every block and template that meet the threshold."""
    spark = parts.sparkSession
    totals = parts.where("seen is not null").select(F.posexplode("seen").alias("word", "n")).groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a template word
    seen = {r["word"]: r["n"] for r in totals}
    order = sorted(range(len(vocabulary)), key=lambda w: (seen.get(w, 0), vocabulary[w]))
    rank = {vocabulary[w]: i for i, w in enumerate(order)}
    ranks = F.array(*[F.lit(rank[w]) for w in vocabulary])
    prefixes = []
    for label, text in templates:
        words = sorted(rank[w] for w in set(text.split()))
        o = required(len(words), least)
        prefixes += [(label, block_size(text), o, i, w, words) for i, w in enumerate(words[: len(words) - o + 1])]
    index = spark.createDataFrame(prefixes, "label string, size int, need int, t_at int, rank int, t_words array<int>")

    blocks = parts.select("row", F.explode("blocks").alias("b")).select("row", "b.size", "b.block", F.array_sort(F.transform("b.words", lambda w: F.get(ranks, w))).alias("words"))
    few = index.groupBy("size").agg(F.min("need").alias("few"))
    keyed = blocks.join(F.broadcast(few), "size").select("*", F.posexplode(F.expr("slice(words, 1, size(words) - few + 1)")).alias("at", "rank"))
    meets = (F.col("at") <= F.size("words") - F.col("need")) & (F.least(F.size("words") - F.col("at"), F.size("t_words") - F.col("t_at")) >= F.col("need"))
    shared = F.size(F.array_intersect("words", "t_words"))
    found = keyed.join(F.broadcast(index), ["size", "rank"]).where(meets).withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
    return found.groupBy("row", "size", "block", "label").agg(F.max(F.col("shared") / F.size("t_words")).alias("containment"))


def license_scan(
    docs: DataFrame,
    phrases: list[tuple[str, str]] = PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    least: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_words, places, matches, base_labels, labels, score) of each row.

    ``places`` are (start, phrase, label) of the phrases by start, ``matches`` (start, size, label, containment) of the blocks by start;
    ``labels`` those of both, ``score`` the greatest containment, 1 where a phrase stands, 0 without labels.
    """
    parts, vocabulary = _scan(docs, phrases, templates, least, id_col, text_col)
    kind = "array<struct<start:long,size:int,label:string,containment:double>>"
    if templates:
        found = contained_templates(parts, vocabulary, templates, least)
        match = F.struct((F.col("block") * F.col("size")).alias("start"), (2 * F.col("size")).alias("size"), "label", "containment")
        matches = found.groupBy("row").agg(F.sort_array(F.collect_list(match)).alias("matches"))
        out = parts.join(matches, "row", "left")
    else:
        out = parts.withColumn("matches", F.lit(None).cast(kind))
    named = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(label).alias("label")) for p, label in phrases]) if phrases else F.array().cast("array<struct<phrase:string,label:string>>")
    place = lambda x: F.struct(x["start"].alias("start"), F.get(named, x["phrase"])["phrase"].alias("phrase"), F.get(named, x["phrase"])["label"].alias("label"))
    out = out.withColumns({"places": F.array_sort(F.transform("places", place)), "matches": F.coalesce("matches", F.array().cast(kind))})
    base = F.array_sort(F.array_distinct("places.label"))
    labels = F.array_sort(F.array_union("places.label", "matches.label"))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_words", "places", "matches", base.alias("base_labels"), labels.alias("labels"), score.alias("score"))
