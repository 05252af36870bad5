"""Licence scan by diagonal voting of word k-grams against templates."""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text, util

#: Words in a k-gram; share of a template's k-grams that must vote; diagonals this near are one; words that must match.
K = 3
VOTES = 0.3
NEAR = 4
COVERAGE = 0.8

TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": ["Licensed under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0"],
}


def words_of(t: str) -> list[tuple[str, int, int]]:
    """(word, first byte, byte after) in the UTF-8 text."""
    w = text.Words(pa.array([t]), want_hash=False)
    raw = w.data.tobytes()
    return [(raw[a:b].decode("utf-8", "replace"), a, b) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]


def template_table() -> list[tuple[int, str, list[str]]]:
    return [(n, name, [w for w, _, _ in words_of(t)]) for n, (name, t) in enumerate((k, t) for k, ts in TEMPLATES.items() for t in ts)]


def _positions(spark: SparkSession, k: int) -> DataFrame:
    rows = []
    for n, _, ts in template_table():
        h, at = text.windows(text.Words(pa.array([" ".join(ts)])), k)
        rows += [(int(v), n, int(p)) for v, p in zip(h.view(np.int64), at, strict=True)]
    return spark.createDataFrame(rows, "hash bigint, template int, tpos int")


def _grams(batches, k: int):
    for b in batches:
        for at, part in text.slices(b.column("text")):
            w = text.Words(part)
            h, pos = text.windows(w, k)
            row = w.row_of()[pos] if len(pos) else pos
            key = b.column("key").slice(at, len(part)).to_numpy()[row]
            pos = (pos - w.first[row]).astype(np.int32)
            for a in range(0, len(h), 65536):
                s = slice(a, a + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(pos[s]), pa.array(h[s].view(np.int64))], ["key", "pos", "hash"])


def verify(t: str, candidates: list[tuple[int, int, int]], templates: dict[int, tuple[str, list[str]]], coverage: float) -> list[tuple[str, int, int, float]]:
    """(license, start, end, coverage) by character offsets, of the candidates (template, least diagonal, greatest diagonal) that hold."""
    words = words_of(t)
    ok = []
    for n, low, high in candidates:
        name, want = templates[n]
        # a whole copy on the diagonal itself first, then one with words put in or left out
        for slack in (0, NEAR):
            a, b = max(0, low - slack), min(len(words), high + len(want) + slack)
            blocks = [m for m in difflib.SequenceMatcher(None, want, [w[0] for w in words[a:b]], autojunk=False).get_matching_blocks() if m.size]
            hit = sum(m.size for m in blocks)
            if not hit:
                continue
            first, last = a + blocks[0].b, a + blocks[-1].b + blocks[-1].size
            if hit >= coverage * len(want) and hit >= coverage * (last - first):
                ok.append((hit, hit / len(want), name, first, last))
                if hit == len(want):
                    break
    out = []
    taken = np.zeros(len(words) + 1, np.bool_)
    for hit, share, name, first, last in sorted(ok, key=lambda x: (-x[0], -x[1], x[2], x[3])):
        if not taken[first:last].any():
            taken[first:last] = True
            out.append((name, first, last, share))
    data, _ = text.utf8(pa.compute.utf8_lower(pa.array([t])))
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(name, int(chars[words[a][1]]), int(chars[words[b - 1][2]]), round(share, 4)) for name, a, b, share in sorted(out, key=lambda x: x[1])]


_FOUND = "doc_id bigint, license string, start int, end int, coverage double"


def _verified(batches, coverage: float):
    templates = {n: (name, ts) for n, name, ts in template_table()}
    for b in batches:
        rows = []
        for i, t, c in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True):
            # each diagonal is a place: a template that recurs within a few words is one chain of them, and several copies
            places = [(x["template"], d, d) for x in c for d in x["diagonals"]]
            rows += [(i, *f) for f in verify(t, places, templates, coverage)]
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["doc_id", "license", "start", "end", "coverage"])


def candidates(docs: DataFrame, k: int, share: float) -> DataFrame:
    """(key, found): diagonals of each text on which enough of a template's k-grams agree, near ones merged."""
    spark = docs.sparkSession
    grams = docs.where("text IS NOT NULL").select("key", "text").mapInArrow(util.frugal(lambda b: _grams(b, k)), "key bigint, pos int, hash bigint")
    # the templates are part of this module, a few thousand rows whatever the input
    hits = grams.join(F.broadcast(_positions(spark, k)), "hash").select("key", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    votes = hits.groupBy("key", "template", "diagonal").agg(F.count(F.lit(1)).alias("votes"))
    w = W.partitionBy("key", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > NEAR, F.lit(True))
    merged = votes.withColumn("far", far.cast("int")).withColumn("group", F.sum("far").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    merged = merged.groupBy("key", "template", "group").agg(F.sum("votes").alias("votes"), F.collect_list("diagonal").alias("diagonals"))
    need = F.create_map(*(F.lit(x) for n, _, ts in template_table() for x in (n, max(1, int(np.ceil(share * (len(ts) - k + 1)))))))
    enough = merged.where(F.col("votes") >= need[F.col("template")])
    return enough.groupBy("key").agg(F.collect_list(F.struct("template", "diagonals")).alias("found"))


def scan(docs: DataFrame, k: int = K, share: float = VOTES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, start, end, coverage): licence texts and notices in documents, by code point offsets of the lower-cased text.

    All rolling word k-grams of all texts are joined to the templates' positions;
    votes are counted by diagonal, diagonals at most NEAR apart are merged, and
    what is left is aligned word by word, at every place where a copy may begin. Of overlapping spans the one with most
    words stays, then the better covered, then the first by name. Null texts and
    texts shorter than k words have none, very long ones are read whole; a null identifier stays null; a row
    repeated whole is reported once; an empty table gives no rows; other
    columns, whatever their names, are not looked at.

    Texts with candidates are few and read again; if the list of them is too long to
    be broadcast, a filter of bounded size picks the texts to be shuffled.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = slim.withColumn("key", F.xxhash64(F.lit("licence"), "doc_id", "text"))
    found = util.spool(candidates(slim, k, share), "licences")
    n = found.count()
    if n * 200 <= util.BROADCAST_BYTES:
        rows = slim.join(F.broadcast(found), "key")
    else:
        rows = util.marked(slim, found, ["key"], "__may", n).where("__may").join(found.hint("shuffle_hash"), "key")
    out = rows.select("doc_id", "text", "found").mapInArrow(util.frugal(lambda b: _verified(b, coverage)), _FOUND)
    return out.distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(util.table(spark, sf_dir, "documents"))
