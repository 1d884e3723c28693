"""License scans: a trained statement classifier, native in scoring.

A softmax regression over sparse word 1- and 2-grams is fitted on the driver from varied copies of short
licence statements and of ordinary and legal-sounding sentences (the unknown class). Its probabilities are
calibrated by a temperature on held-out copies, and a passage below the calibrated threshold is unknown. A
prediction must be confirmed by comparison with the family's templates: enough of a template's 2-grams must
stand in the passage. Weights and templates are literals; scoring is column expressions over each document,
without a shuffle.

Words are read across line ends, so wrapped statements and comment marks don't matter. Passages are lines and
windows of words: one window starts at each of a template's 2-grams in the document and is as long as the
template, another is twice as long (and 4 words more, for words put in between), both cut after the last 2-gram.
Passages that hold too few 2-grams of all templates can't be confirmed and aren't scored.

A document without any of the templates' anchor words is skipped. The words are chosen so that nothing is lost:
the 2-grams without an anchor word are too few for confirmation, for every template. Defined results: null and
empty texts have no licences; repeated rows repeat; a text of any length is scanned whole, as one row's array of words.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need

#: Short public licence statements by family.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "Licensed under the MIT license."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "either version 3 of the GNU General Public License, or (at your option) any later version", "SPDX-License-Identifier: GPL-3.0-only"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "either version 2 of the GNU General Public License, or (at your option) any later version", "SPDX-License-Identifier: GPL-2.0-only"),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD license.", "Released under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("Released into the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission."),
}
#: Sentences that are no licence though they use some of the words.
ORDINARY = (
    "A driving license is required to rent the car.", "The committee reserved the hall for the public meeting.", "Version two of the program was released in spring.",
    "The general told the public that the work was done.", "Apache helicopters flew over the town.", "She studied at MIT and holds two patents.",
    "The right to vote is reserved to members.", "You may copy the text by hand.", "Permission to land was granted by the tower.", "The license plate was missing.",
    "All seats are reserved.", "The library of the creative arts is open to the public.", "Common conditions are met in the following source.", "See the copyright office for forms.",
)
UNKNOWN = "unknown"
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
CONFIRM = 0.6


def grams(text: str) -> list[str]:
    words = re.findall(WORD, text.lower())
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))


def template_pairs(text: str) -> list[str]:
    return [x for x in grams(text) if " " in x] or grams(text)


def fewest(pairs: list[str], confirm: float) -> int:
    """The smallest count of a template's 2-grams that confirms it."""
    return next(k for k in range(len(pairs) + 1) if k / len(pairs) >= confirm)


def anchors(confirm: float) -> list[str]:
    """Words such that each template's 2-grams without any of them are too few to confirm it."""
    out: list[str] = []
    for text in (t for ts in TEMPLATES.values() for t in ts):
        pairs = template_pairs(text)
        open_pairs = [x for x in pairs if not any(a in w for a in out for w in x.split())]
        for word in sorted({w for x in pairs for w in x.split()}, key=lambda w: (-len(w), w)):
            if len(open_pairs) < max(1, fewest(pairs, confirm)):
                break
            if any(word in x.split() for x in open_pairs):
                out.append(word)
                open_pairs = [x for x in open_pairs if not any(word in w for w in x.split())]
    return [a for a in out if not any(b != a and b in a for b in out)]


class Model:
    def __init__(self, seed: int = 11, copies: int = 40):
        rng = random.Random(seed)
        self.classes = [*TEMPLATES, UNKNOWN]
        rows: list[tuple[list[str], int]] = []
        held: list[tuple[list[str], int]] = []
        noise = lambda: "".join(rng.choice("aeioubcdfghlmnprst") for _ in range(rng.randint(2, 9)))
        vocabulary = sorted({w for ts in TEMPLATES.values() for t in ts for w in re.findall(WORD, t.lower())})

        def varied(text: str) -> str:
            words = [w for w in text.split() if rng.random() > 0.06] or text.split()
            return " ".join([noise() for _ in range(rng.choice((0, 0, 1, 3)))] + words + [noise() for _ in range(rng.choice((0, 0, 1, 4)))])

        for k, family in enumerate(self.classes):
            texts = TEMPLATES.get(family, ())
            made = [grams(t) for t in texts] + [grams(varied(t)) for t in texts for _ in range(copies)]
            if family == UNKNOWN:
                made = [grams(varied(t)) for t in ORDINARY for _ in range(copies)]
                made += [grams(" ".join(noise() if rng.random() > 0.25 else rng.choice(vocabulary) for _ in range(rng.randint(2, 18)))) for _ in range(20 * copies)]
            for n, g in enumerate(made):
                (held if n % 5 == 4 else rows).append((g, k))
        counts: dict[str, int] = {}
        for g, k in rows:
            for x in g:
                counts[x] = counts.get(x, 0) + 1
        self.names = sorted(x for x, n in counts.items() if n >= 8)
        place = {x: k for k, x in enumerate(self.names)}

        def matrix(found):
            out = np.zeros((len(found), len(self.names) + 1))
            out[:, -1] = 1
            for r, (g, _) in enumerate(found):
                out[r, [place[x] for x in g if x in place]] = 1
            return out, np.array([k for _, k in found])

        x, y = matrix(rows)
        one = np.eye(len(self.classes))[y]
        w, m = np.zeros((x.shape[1], len(self.classes))), np.zeros((x.shape[1], len(self.classes)))
        balance = (len(y) / (len(self.classes) * one.sum(0)))[y][:, None]
        for _ in range(300):
            p = self._softmax(x @ (w + 0.9 * m))
            m = 0.9 * m - 0.4 * (x.T @ ((p - one) * balance) / len(y) + 2e-4 * w)
            w = w + m
        self.weights, self.bias = w[:-1], w[-1]
        hx, hy = matrix(held)
        z = hx @ w
        grid = [0.5, 0.7, 1.0, 1.4, 2.0, 3.0]
        self.temperature = min(grid, key=lambda t: -np.log(self._softmax(z / t)[np.arange(len(hy)), hy] + 1e-12).mean())
        p = self._softmax(z / self.temperature)
        wrong = p[:, :-1].max(1)[hy == len(self.classes) - 1]
        self.threshold = float(min(0.9, max(0.5, np.quantile(wrong, 0.995))))  # one in 200 unknowns passes to the template check
        self.held_out_accuracy = float((p.argmax(1) == hy).mean())

    @staticmethod
    def _softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def default_model() -> Model:
    """Always the same model: its training texts and its seed are fixed."""
    return Model()


def _let(value: Column, body) -> Column:
    """body(value), value being computed once."""
    return F.transform(F.array(value), body)[0]


def _pairs(words: Column) -> Column:
    """The 2-gram at each word but the last."""
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def license_scan(docs: DataFrame, model: Model | None = None, confirm: float = CONFIRM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, found array<struct<line, family, probability, overlap>>, families array<string>, n_checked (passages scored).

    A window gives way to one as long as a template that covers more than half of it with a larger overlap.
    Of passages of one family that share a line, found has the one with the largest overlap; line is where it starts.
    """
    model = model or default_model()
    json_of = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    weights = json_of({x: [round(float(v), 6) for v in row] for x, row in zip(model.names, model.weights, strict=True)}, "map<string,array<double>>")
    bias = json_of([round(float(v), 6) for v in model.bias], "array<double>")
    names = json_of(model.names, "array<string>")
    classes = json_of(model.classes, "array<string>")
    templates = json_of({k: [template_pairs(t) for t in ts] for k, ts in TEMPLATES.items()}, "map<string,array<array<string>>>")
    flat = [(t, template_pairs(t)) for ts in TEMPLATES.values() for t in ts]
    asked = json_of([{"least": fewest(g, confirm), "long": len(re.findall(WORD, t.lower())), "pairs": g} for t, g in flat], "array<struct<least:int,long:int,pairs:array<string>>>")
    every = json_of(sorted({x for _, g in flat for x in g}), "array<string>")
    wanted = anchors(confirm)
    any_anchor = lambda c: _any([F.contains(c, F.lit(a)) for a in wanted])
    kind = "struct<line:int,family:string,probability:double,overlap:double,last:int,begin:int,end:int,exact:boolean>"

    def judge(words, line, last, begin=None, end=None, exact=None):
        place = (F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("end"), F.lit(False).alias("exact")) if begin is None else (begin.cast("int").alias("begin"), end.cast("int").alias("end"), exact.alias("exact"))

        def with_grams(g):
            logits = F.aggregate(F.array_intersect(g, names), bias, lambda acc, x: F.zip_with(acc, F.element_at(weights, x), lambda a, b: a + b))

            def with_logits(z):
                top = F.array_max(z)
                total = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp((v - top) / model.temperature))
                family = F.get(classes, (F.array_position(z, top) - 1).cast("int"))
                overlap = F.coalesce(F.array_max(F.transform(F.element_at(templates, family), lambda t: F.size(F.array_intersect(g, t)) / F.size(t))), F.lit(0.0))
                return F.struct(line.cast("int").alias("line"), family.alias("family"), (1 / total).alias("probability"), overlap.alias("overlap"), last.cast("int").alias("last"), *place)

            return _let(logits, with_logits)

        return _let(F.array_distinct(F.concat(words, _pairs(words))), with_grams)

    def near(pairs):
        """Templates that the 2-grams can confirm."""
        return _let(F.array_intersect(pairs, every), lambda known: F.filter(asked, lambda t: F.size(F.array_intersect(known, t["pairs"])) >= t["least"]))

    def windows(words, at, pairs, t):
        """(first, last word) of the windows that confirm the template t."""

        def with_hits(hits):
            def spans(h, k):
                within = lambda long: F.filter(F.slice(hits, k + 1, long - 1), lambda q: q["i"] - h["i"] <= long - 2)
                count = lambda span: F.size(F.array_distinct(F.transform(span, lambda q: q["x"])))
                made = lambda span, long: F.struct(h["i"].alias("first"), (F.element_at(span, -1)["i"] + 1).alias("last"), count(span).alias("n"), (long == t["long"]).alias("exact"))
                both = F.transform(F.array(t["long"], 2 * t["long"] + 4), lambda long: _let(within(long), lambda span: made(span, long)))
                return F.filter(both, lambda s, k: (s["n"] >= t["least"]) & ((k == 0) | (s["n"] > F.get(both, F.lit(0))["n"])))

            return F.flatten(F.transform(hits, spans))

        hits = F.filter(F.transform(pairs, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda h: F.array_contains(t["pairs"], h["x"]))
        return F.transform(_let(hits, with_hits), lambda s: judge(F.slice(words, s["first"] + 1, s["last"] - s["first"] + 1), F.get(at, s["first"]), F.get(at, s["last"]), s["first"], s["last"], s["exact"]))

    words_of = lambda text: F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    none = F.array().cast(f"array<{kind}>")

    def scan(lines):
        def with_words(words):
            at = F.flatten(F.transform(lines, lambda s: F.array_repeat(s["at"], F.size(s["words"]))))
            single = F.filter(lines, lambda s: F.size(near(_pairs(s["words"]))) > 0)

            def with_pairs(pairs):
                def with_near(ts):
                    inside = _let(at, lambda a: F.flatten(F.transform(ts, lambda t: windows(words, a, pairs, t))))
                    return F.when(F.size(ts) > 0, F.concat(inside, F.transform(single, lambda s: judge(s["words"], s["at"], s["at"])))).otherwise(none)

                return _let(near(pairs), with_near)

            return _let(_pairs(words), with_pairs)

        return _let(F.flatten(F.transform(lines, lambda s: s["words"])), with_words)

    source = need(docs, id_col, text_col).select(F.col(id_col), F.lower(F.col(text_col).cast("string")).alias("_low"))
    lines = F.transform(F.split("_low", "\n", -1), lambda line, i: F.struct(i.alias("at"), words_of(line).alias("words")))
    scored = source.select(id_col, F.coalesce(F.when(any_anchor(F.col("_low")), _let(lines, scan)), none).alias("_all"))
    passes = lambda s: (s["family"] != UNKNOWN) & (s["probability"] >= model.threshold) & (s["overlap"] >= confirm)

    def alone(all_):
        """Without windows that lie by more than half in a template-long one of another family with a larger overlap."""

        def clashes(s, y):
            shared = F.least(s["end"], y["end"]) - F.greatest(s["begin"], y["begin"]) + 1
            return (y["family"] != s["family"]) & (y["overlap"] > s["overlap"]) & (2 * shared > s["end"] - s["begin"] + 1)

        several = F.size(F.array_distinct(F.transform(all_, lambda s: s["family"]))) > 1
        strong = lambda ys: F.filter(all_, lambda s: s["begin"].isNull() | (s["overlap"] >= 1) | ~F.exists(ys, lambda y: clashes(s, y)))
        return F.when(several, _let(F.filter(all_, lambda y: y["exact"]), strong)).otherwise(all_)

    passed = _let(F.filter("_all", passes), alone)
    ordered = F.array_sort(F.transform(passed, lambda s: F.struct(s["family"].alias("family"), s["line"].alias("line"), s["last"].alias("last"), s["overlap"].alias("overlap"), s["probability"].alias("probability"))))

    def merged(acc, s):
        top = F.try_element_at(acc, F.lit(-1))
        shares = F.coalesce((top["family"] == s["family"]) & (s["line"] <= top["last"]), F.lit(False))
        better = (s["overlap"] > top["overlap"]) | ((s["overlap"] == top["overlap"]) & (s["probability"] > top["probability"]))
        return F.when(~shares, F.concat(acc, F.array(s))).when(better, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(s))).otherwise(acc)

    start = F.array().cast("array<struct<family:string,line:int,last:int,overlap:double,probability:double>>")
    kept = F.aggregate(ordered, start, merged)
    rows = F.array_sort(F.transform(kept, lambda s: F.struct(s["line"].alias("line"), s["family"].alias("family"), s["probability"].alias("probability"), s["overlap"].alias("overlap"))))
    found = scored.select(id_col, "_all", rows.alias("found"))
    return found.select(id_col, "found", F.array_sort(F.array_distinct(F.transform("found", lambda s: s["family"]))).alias("families"), F.size("_all").cast("long").alias("n_checked"))


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out
