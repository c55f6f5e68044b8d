"""Licence scan: a paragraph classifier over word n-grams, confirmed by templates.

Multinomial logistic regression over words and word pairs of the templates tells licence families
from each other and from other text. It is trained here on the templates with words dropped,
swapped in and put around them, and on a bounded sample of windows of the corpus, chosen by a
hash of the id; those that hold a notice, and their neighbours, are left out of it. A temperature and a threshold are set on examples held back from training
(calibration); below the threshold a paragraph that speaks of a licence is "unknown". A family is
confirmed if the paragraph holds enough of one of its templates, in word pairs; otherwise it is
"unknown", too.

Paragraphs are runs of lines that have words, so that lines of comment marks alone end them. Each
line is read by itself, and each paragraph across its line breaks; what has over ``LONG`` words is
read in overlapping windows. A window without any anchor (a template word that is not in ``PLAIN``)
is other text.

A finding's place is the first line of the shortest run of words that holds what is found of the
template. Of findings that share words, that with the most word pairs of its template is kept;
an unknown one is kept where no confirmed one has a line of it.

Defined results: a null or empty text has no licence. Each row gives one row, repeated or not; of
equal findings that start in one line, one is kept. Other columns are not looked at.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padron.llm.words import as_text, with_key

# Notices of licence families, as they are worded in public.
TEMPLATES = {
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is distributed under the terms of the Apache License 2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "This software is licensed under the MIT license, see the LICENSE file",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL version 2 or later.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the LGPL 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPL v3.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License 2.0",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public domain": (
        "This is free and unencumbered software released into the public domain.",
        "Released under CC0 1.0 Universal, public domain dedication.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "proprietary": (
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "This software is proprietary and confidential. Unauthorized copying is strictly prohibited.",
    ),
}
# Licence talk of no listed family, and harmless uses of the same words.
UNLISTED = (
    "Licensed under the terms of our own community agreement.",
    "You may use this work under the license agreement of the vendor.",
    "This file is licensed under the Foo Public License.",
    "The license terms permit redistribution for members only.",
)
HARMLESS = (
    "He got his driving license last year.",
    "The public version of the source was free and general.",
    "A work of art under the terms of the contest.",
    "The restaurant lost its license to serve wine.",
    "Please use the file as the person in charge permits.",
)

# Words of the templates that any text may hold.
PLAIN = frozenset(
    b"a all an and any are as at be by can following for found free general in is it may met must no not of"
    b" on or other our own part person that the their these this to under use used version was with without work"
    b" you your".split()
)

OTHER, UNKNOWN = "other", "unknown"
LONG, STEP = 60, 30
SAMPLE_DOCS, SAMPLE_LINES = 1500, 3
COPIES, ROUNDS = 40, 200
#: Share of a template's word pairs that a paragraph must hold.
CONFIRM = 0.6
#: A calibrated probability at which held-back predictions are right this often.
PRECISION = 0.98

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def grams(found: list[bytes]) -> list[bytes]:
    """Words and word pairs."""
    return [*found, *map(b" ".join, zip(found, found[1:], strict=False))]


@dataclass
class Model:
    families: list[str]
    names: dict[bytes, int]
    weights: np.ndarray
    bias: np.ndarray
    anchors: frozenset[bytes]
    temperature: float = 1.0
    least: float = 0.5

    def logits(self, found: list[bytes]) -> np.ndarray:
        own = {self.names[g] for g in grams(found) if g in self.names}
        z = self.bias.copy()
        if own:
            z += self.weights[sorted(own)].sum(0) / len(own) ** 0.5
        return z

    def probabilities(self, found: list[bytes]) -> np.ndarray:
        z = self.logits(found) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def verdict(self, found: list[bytes]) -> tuple[str, float, float] | None:
        """(family, probability, share of the template) of a window, or nothing."""
        if self.anchors.isdisjoint(found):
            return None
        p = self.probabilities(found)
        best = int(p.argmax())
        family = self.families[best]
        if family == OTHER:
            return None
        share = held(found, family)[0]
        if family == UNKNOWN or p[best] < self.least or share < CONFIRM:
            return UNKNOWN, float(1 - p[self.families.index(OTHER)]), share
        return family, float(p[best]), share


_PAIRS = {
    family: [set(grams(words(t))) - set(words(t)) for t in texts] for family, texts in TEMPLATES.items()
}


def held(found: list[bytes], family: str) -> tuple[float, set[bytes]]:
    """Share of a template's word pairs in a window, and these pairs: the most of a confirmed template, or else the largest share."""
    own = set(grams(found))
    every = [(len(own & t) / len(t), own & t) for t in _PAIRS.get(family, ())]
    return max(every, default=(0.0, set()), key=lambda x: (x[0] >= CONFIRM, len(x[1]) if x[0] >= CONFIRM else x[0]))


def windows(found: list) -> list[list]:
    if len(found) <= LONG:
        return [found]
    return [found[a : a + LONG] for a in range(0, len(found) - STEP, STEP)]


def shortest(found: list[bytes], pairs: set[bytes]) -> tuple[int, int]:
    """The shortest run of words that holds all the pairs."""
    best, last = (0, len(found)), {}
    for at, pair in enumerate(map(b" ".join, zip(found, found[1:], strict=False))):
        if pair in pairs:
            last.pop(pair, None)
            last[pair] = at  # the first key is the pair seen longest ago
            first = next(iter(last.values()))
            if len(last) == len(pairs) and at + 2 - first < best[1] - best[0]:
                best = first, at + 2
    return best


def paragraphs(text: str) -> list[list[tuple[int, bytes]]]:
    """(line, word) of each run of lines with words."""
    out, rest = [], []
    for at, line in enumerate(text.split("\n")):
        found = words(line)
        if found:
            rest += [(at, w) for w in found]
        elif rest:
            out.append(rest)
            rest = []
    return [*out, rest] if rest else out


def other(text: str) -> list[list[bytes]]:
    """Windows of a text that hold no notice and are not next to one."""
    listed = {b"license", b"licence", b"licensed", b"copyright", b"spdx"}
    out = []
    for paragraph in paragraphs(text):
        parts = windows([w for _, w in paragraph])
        notice = [not listed.isdisjoint(p) or any(held(p, f)[0] >= CONFIRM for f in TEMPLATES) for p in parts]
        out += [p for at, p in enumerate(parts) if not any(notice[max(0, at - 1) : at + 2])]
    return out


def examples(lines: list[str], rng: random.Random) -> list[tuple[list[bytes], str]]:
    """Templates with noise, and other text."""
    prose = [w for line in lines for w in words(line)] or [b"and", b"so", b"on"]
    out = []
    wanted = [*TEMPLATES.items(), (UNKNOWN, UNLISTED), (OTHER, HARMLESS)]
    for family, texts in wanted:
        for text in texts:
            for copy in range(COPIES):
                found = words(text)
                if copy:
                    drop, swap = rng.choice([0, 0, 0.05, 0.15]), rng.choice([0, 0, 0.05])
                    found = [rng.choice(prose) if rng.random() < swap else w for w in found if rng.random() >= drop]
                    around = [rng.choice(prose) for _ in range(rng.choice([0, 0, 0, 5, 20]))]
                    cut = rng.randrange(len(around) + 1)
                    found = around[:cut] + found + around[cut:]
                if found:
                    out.append((found, family))
    for line in lines:  # one window of each, drawn from all of its text
        found = other(line)
        if found:
            out.append((rng.choice(found), OTHER))
    for _ in range(400):  # template words in no order are no licence
        text = words(rng.choice(rng.choice(list(TEMPLATES.values()))))
        out.append(([rng.choice(prose) for _ in range(8)] + rng.sample(text, min(2, len(text))), OTHER))
    rng.shuffle(out)
    return out


def fitted(lines: list[str], seed: int = 11) -> Model:
    """Train on four fifths of the examples, calibrate on the rest."""
    rng = random.Random(seed)
    made = examples(lines, rng)
    families = [*TEMPLATES, UNKNOWN, OTHER]
    vocabulary = sorted({g for texts in [*TEMPLATES.values(), UNLISTED, HARMLESS] for t in texts for g in grams(words(t))})
    names = {g: i for i, g in enumerate(vocabulary)}
    of_templates = {w for texts in TEMPLATES.values() for t in texts for w in words(t)}
    anchors = frozenset(w for w in of_templates if w not in PLAIN and len(w) > 1)
    model = Model(families, names, np.zeros((len(names), len(families))), np.zeros(len(families)), anchors)
    cut = len(made) * 4 // 5
    x = np.zeros((len(made), len(names)))
    for i, (found, _) in enumerate(made):
        own = sorted({names[g] for g in grams(found) if g in names})
        if own:
            x[i, own] = 1 / len(own) ** 0.5
    y = np.array([families.index(f) for _, f in made])
    truth = np.eye(len(families))[y[:cut]]
    slow_w, slow_b = np.full_like(model.weights, 1e-8), np.full_like(model.bias, 1e-8)
    for _ in range(ROUNDS):
        z = x[:cut] @ model.weights + model.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (truth - p) / max(cut, 1)
        g_w, g_b = x[:cut].T @ error - 1e-5 * model.weights, error.sum(0)
        slow_w += g_w * g_w
        slow_b += g_b * g_b
        model.weights += 0.5 * g_w / np.sqrt(slow_w)
        model.bias += 0.5 * g_b / np.sqrt(slow_b)
    held, truth = x[cut:] @ model.weights + model.bias, y[cut:]
    model.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: _loss(held / t, truth))
    p = np.exp(held / model.temperature - (held / model.temperature).max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    top, right = p.max(1), p.argmax(1) == truth
    model.least = min(
        (t for t in np.arange(0.3, 0.96, 0.05) if right[top >= t].mean() >= PRECISION), default=0.95
    )
    return model


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    z = z - z.max(1, keepdims=True)
    return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())


def trained(df: DataFrame, key: str = "doc_id", text: str = "text", docs: int = SAMPLE_DOCS) -> Model:
    """A model whose other text comes from a few windows each of about ``docs`` documents."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    share = min(1.0, docs / max(1, rows.count()))
    chosen = F.pmod(F.xxhash64(F.coalesce("key", F.lit(""))), F.lit(1 << 30)) < int(share * (1 << 30))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, x in zip(batch["key"], batch["text"], strict=True):
                parts = other(x or "")
                picked = random.Random(str(k)).sample(parts, min(SAMPLE_LINES, len(parts)))
                out += [(k or "", b" ".join(p).decode("utf-8", "surrogatepass")) for p in picked]
            yield pd.DataFrame(out, columns=["key", "line"])

    found = rows.where(chosen).limit(2 * docs).mapInPandas(run, "key string, line string").toPandas()
    return fitted(list(found.sort_values(["key", "line"])["line"]))


def scan(text: str | None, model: Model) -> list[tuple[int, str, float, float]]:
    """(line, family, probability, share) of each finding, in order."""
    if not text or model.anchors.isdisjoint(words(text)):
        return []
    return [hit for paragraph in paragraphs(text) for hit in _findings(paragraph, model)]


def _findings(paragraph: list[tuple[int, bytes]], model: Model) -> list[tuple[int, str, float, float]]:
    lines = [at for at, _ in paragraph]
    found = [w for _, w in paragraph]
    starts = [0, *(i for i in range(1, len(lines)) if lines[i] != lines[i - 1]), len(lines)]
    cuts = {(0, len(lines)), *zip(starts, starts[1:], strict=False)}
    hits = set()
    for a, b in cuts:
        for part in windows(range(a, b)):
            mine = found[part.start : part.stop]
            if model.anchors.isdisjoint(mine):
                continue
            hit = model.verdict(mine)
            if hit and hit[0] == UNKNOWN:
                at = [i for i, w in enumerate(mine) if w in model.anchors]
                hits.add((part.start + at[0], part.start + at[-1] + 1, *hit, 0))
            for family in TEMPLATES:  # a window may hold several notices
                share, pairs = held(mine, family)
                if share < CONFIRM:
                    continue
                first, end = shortest(mine, pairs)
                alone = model.verdict(mine[first:end])
                best = max((h for h in (hit, alone) if h and h[0] == family), default=None)
                if best:
                    hits.add((part.start + first, part.start + end, *best, len(pairs)))
    kept: list[tuple] = []
    for hit in sorted(hits, key=lambda h: (-h[5], -h[3], h[0], h[1], h[2], h[4])):  # unknown ones have no pairs
        first, end, family = hit[:3]
        own = range(lines[first], lines[end - 1] + 1)
        for a, b, before, *_ in kept:
            if first < b and a < end:
                break
            if family == UNKNOWN and own.start <= lines[b - 1] and lines[a] < own.stop:
                break
            if family == before and lines[a] == own.start:
                break
        else:
            kept.append(hit)
    return sorted((lines[first], family, p, share) for first, _, family, p, share, _ in kept)


def report(df: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """Per row: id, confirmed families, number of findings and unknown ones, findings in detail."""
    model = model or trained(df, key, text)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch["text"]:
                found = scan(x, sent.value)
                known = sorted({f for _, f, _, _ in found if f != UNKNOWN})
                rows.append(
                    (
                        ",".join(known),
                        len(found),
                        sum(f == UNKNOWN for _, f, _, _ in found),
                        ",".join(f"{at}:{f}:{p:.4f}:{s:.4f}" for at, f, p, s in found),
                    )
                )
            out = pd.DataFrame(rows, columns=["families", "n_found", "n_unknown", "findings"])
            out.insert(0, "key", batch["key"].array)
            yield out

    rows = df.select(as_text(key), F.col(text).alias("text"))
    shape = "key string, families string, n_found long, n_unknown long, findings string"
    return with_key(rows.mapInPandas(run, shape), key, df.schema[key].dataType)
