"""Licence scans: TF-IDF cosine of lines to templates, then inheritance from the nearest licensed directory.

Texts are cut into lines, lines into sentences. Every line, every sentence and every run of neighbouring sentences of
at most `SPAN` terms (a header wrapped over lines) is a sparse TF-IDF vector, and so is the whole of a licence file; it is
compared with the vectors of `TEMPLATES` through their shared terms. Document frequencies of the templates' terms are
counted over all texts; a term outside the templates counts as the rarest. Near relatives (versions, added clauses) have
templates of their own that differ in those words, so the nearest one wins; a text without them falls to the template it is
nearest to. A file takes the licence of its best piece
from `THRESHOLD` on. A bare reservation of rights counts by whole lines only: inside a line it tells the owner and stands
before licences of all kinds. A licence file gives its licence to its directory; a file without a licence of its own
inherits from the nearest ancestor directory that has one, found by joining the ancestors of the distinct directories.

Defined cases: null or empty text has no licence of its own, and neither has a file with a null path; pieces that score
alike: the template first by name; blank lines do not part neighbours; directories with several licence files take the best score, then the first
name; rows that repeat get the same verdict; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwave.llm.common import stored, table

# The licences' own words, and the parts that several of them share.
_GNU = ("This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License "
        "as published by the Free Software Foundation{stop} either version {version} of the License, or (at your option) any later version.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.")
_NEITHER = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
            "this software without specific prior written permission.")
_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
          "NOT LIMITED TO,")
_CC = "This work is licensed under a Creative Commons {long} International License."

TEMPLATES = {
    "agpl-3.0": [_GNU.format(what="program", mark=":", kind="Affero ", stop=",", version="3"),
                 "This work is licensed under the GNU Affero General Public License, version 3.",
                 "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "You may not use this file except in compliance with the License.",
                   "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "bsd-2-clause": [f"{_BSD} {_AS_IS}"],
    "bsd-3-clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted.",
                     "Use of this source code is governed by a BSD-style license.", _NEITHER, f"{_BSD} 3. {_NEITHER} {_AS_IS}"],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", _CC.format(long="Attribution 4.0")],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", _CC.format(long="Attribution-NonCommercial 4.0")],
    "cc-by-nc-nd-4.0": ["Licensed under CC BY-NC-ND 4.0.", _CC.format(long="Attribution-NonCommercial-NoDerivatives 4.0")],
    "cc-by-nc-sa-4.0": ["Licensed under CC BY-NC-SA 4.0.", _CC.format(long="Attribution-NonCommercial-ShareAlike 4.0")],
    "cc-by-nd-4.0": ["Licensed under CC BY-ND 4.0.", _CC.format(long="Attribution-NoDerivatives 4.0")],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", _CC.format(long="Attribution-ShareAlike 4.0")],
    "cc0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal", "Licensed under CC0 1.0."],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
                "Eclipse Public License - v 2.0"],
    "gpl-2.0": [_GNU.format(what="program", mark=";", kind="", stop=";", version="2"),
                "This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
                _GNU.format(what="program", mark=":", kind="", stop=",", version="3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies."],
    "lgpl-2.1": [_GNU.format(what="library", mark=";", kind="Lesser ", stop=";", version="2.1"),
                 "This work is licensed under the GNU Lesser General Public License, version 2.1.",
                 "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl-3.0": [_GNU.format(what="library", mark=":", kind="Lesser ", stop=",", version="3"),
                 "This work is licensed under the GNU Lesser General Public License, version 3.",
                 "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
            "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
            "furnished to do so, subject to the following conditions:"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
             "redistribute it freely, subject to the following restrictions:"],
}
THRESHOLD = 0.7
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)(\.[a-z]+)?$"
TERM = "[a-z0-9]+"
#: What a lower-case text is read as: terms, ends of lines, ends of sentences.
TOKEN = re.compile(TERM + r"|\n|[.!?](?=[ \t])")


def terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0))


def _template_terms() -> list[tuple[str, Counter]]:
    return [(name, Counter(re.findall(TERM, line.lower()))) for name, lines in TEMPLATES.items() for line in lines]


#: A run of n terms that repeat nothing and weigh alike has a cosine of at most sqrt(m / n) with a template of m terms.
SPAN = math.ceil(max(sum(c.values()) for _, c in _template_terms()) / THRESHOLD**2)
#: Terms whose products with the templates are added up at once.
CHUNK = 1 << 15
#: Starts whose runs are looked at together.
STARTS = 1 << 12
#: Licences whose templates say nothing but that rights are reserved.
RESERVED = "proprietary"


def weights(files: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each template term over all texts; "" stands for any other term."""
    vocabulary = sorted({t for _, c in _template_terms() for t in c})
    held = F.array_intersect(F.array_distinct(terms(F.col("text"))), F.array(*map(F.lit, vocabulary)))
    df = {r["term"]: r["n"] for r in files.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    n = files.count()
    idf = lambda d: math.log((1 + n) / (1 + d)) + 1
    return {t: idf(df.get(t, 0)) for t in vocabulary} | {"": idf(0)}


def scorer(idf: dict[str, float]) -> Callable[[str, bool], tuple[str | None, float | None]]:
    """(lower-case text, is it a licence file) -> licence and score of the best piece.

    Counting each repeated term by itself makes a norm smaller, and then sums over terms bound all cosines from above;
    only pieces whose bound reaches THRESHOLD are scored exactly.
    """
    vocabulary = ["", *sorted(t for t in idf if t)]
    number = {t: i for i, t in enumerate(vocabulary) if t} | {"\n": -1, ".": -2, "!": -2, "?": -2}
    square = np.array([idf[t] ** 2 for t in vocabulary])
    names, part, unit = [], np.zeros((len(vocabulary), len(_template_terms()))), []
    for no, (name, counts) in enumerate(_template_terms()):
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in counts.items()))
        names.append(name)
        unit.append({t: k * idf[t] / norm for t, k in counts.items()})
        for t, w in unit[-1].items():
            part[number[t], no] = idf[t] * w
    reserved = np.array([n == RESERVED for n in names])
    most = part.max(axis=1)                                        # of a term, over all templates

    def products(terms_: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sums of `part` over the terms from a to b: running sums over a chunk of starts, long pieces by counting."""
        out = np.empty((len(a), len(names)))
        long = b - a > CHUNK
        for h in np.flatnonzero(long):
            out[h] = np.bincount(terms_[a[h]:b[h]], minlength=len(vocabulary)) @ part
        for c in np.unique(a[~long] // CHUNK):
            some = np.flatnonzero(~long & (a // CHUNK == c))
            lo, hi = int(a[some].min()), int(b[some].max())
            run = np.vstack([np.zeros(len(names)), np.cumsum(part[terms_[lo:hi]], axis=0)])
            out[some] = run[b[some] - lo] - run[a[some] - lo]
        return out

    def best(text: str | None, whole: bool) -> tuple[str | None, float | None]:
        tokens = TOKEN.findall(text or "")
        ids = np.array([number.get(t, 0) for t in tokens], np.int64)
        at = np.append(0, np.cumsum(ids >= 0))                     # terms before each token
        n = int(at[-1])
        if not n:
            return None, None
        terms_ = ids[ids >= 0]
        tops = np.append(0.0, np.cumsum(most[terms_]))
        norms = np.append(0.0, np.cumsum(square[terms_]))
        near = lambda a, b: (tops[b] - tops[a]) ** 2 >= (THRESHOLD - 1e-6) ** 2 * (norms[b] - norms[a])
        ends = lambda marks: np.unique(np.concatenate([[0, n], at[:-1][marks]]))
        lines, cuts = ends(ids == -1), ends(ids < 0)
        is_line = np.zeros(n + 1, bool)
        is_line[lines] = True
        pieces = []

        def add(a: np.ndarray, b: np.ndarray) -> None:             # most pieces fall here, before any template is looked at
            keep = near(a, b)
            pieces.append((a[keep], b[keep]))

        add(lines[:-1], lines[1:])
        if whole:
            add(np.array([0]), np.array([n]))
        starts = np.arange(len(cuts) - 1)
        many = np.maximum(np.searchsorted(cuts, cuts[:-1] + SPAN, side="right") - starts - 1, 1)   # runs from each start
        for at_once in range(0, len(starts), STARTS):
            m = many[at_once:at_once + STARTS]
            first = np.repeat(starts[at_once:at_once + STARTS], m)
            add(cuts[first], cuts[first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(m) - m, m)])
        a, b = (np.concatenate(x) for x in zip(*pieces))
        if not len(a):
            return None, None
        bound = products(terms_, a, b) / np.sqrt(norms[b] - norms[a])[:, None]
        bound[np.ix_(~(is_line[a] & is_line[b]), reserved)] = 0.0
        pairs = np.argwhere(bound >= THRESHOLD - 1e-6)
        words = [t for t, i in zip(tokens, ids.tolist()) if i >= 0] if len(pairs) else []
        name, top, vector = None, THRESHOLD, {}
        for h, no in pairs[np.argsort(-bound[tuple(pairs.T)], kind="stable")].tolist():
            if bound[h, no] < top - 1e-6:                          # nothing that follows can score more
                break
            if h not in vector:
                held = {t: k * idf.get(t, idf[""]) for t, k in Counter(words[a[h]:b[h]]).items()}
                vector[h] = held, math.sqrt(sum(v * v for v in held.values()))
            held, norm = vector[h]
            score = round(sum(held[t] * w for t, w in unit[no].items() if t in held) / norm, 9)
            if score > top or score == top and (name is None or names[no] < name):
                name, top = names[no], score
        return (name, top) if name else (None, None)

    return best


def own_licences(files: DataFrame) -> DataFrame:
    """`files` (path, text) without text, with the license and the score of each text's best piece."""
    idf = weights(files)

    @F.pandas_udf("license string, score double")
    def own(text: pd.Series, whole: pd.Series) -> pd.DataFrame:
        best = scorer(idf)
        return pd.DataFrame([best(t, w) for t, w in zip(text, whole)], columns=["license", "score"])

    whole = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    rows = files.withColumn("__own", own(F.when(F.col("path").isNotNull(), F.lower("text")), whole))
    return rows.select(*[c for c in files.columns if c != "text"], "__own.license", "__own.score")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def licensed(files: DataFrame) -> DataFrame:
    """`files` (path, text) with license, score, how (own, inherited, none) and from_dir."""
    rows = stored(own_licences(files))
    given = (rows.where(F.col("license").isNotNull() & F.col("path").rlike(LICENCE_FILE)).withColumn("from_dir", directory(F.col("path"))).groupBy("from_dir")
             .agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("b")).select("from_dir", F.col("b.license").alias("inherits")))
    dirs = rows.where(F.col("path").isNotNull()).select(directory(F.col("path")).alias("dir")).distinct()
    depth = F.size(F.split("dir", "/"))
    chains = dirs.withColumn("from_dir", F.explode(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), i), "/"))))).distinct()
    nearest = (chains.join(given, "from_dir").groupBy("dir")
               .agg(F.max(F.struct(F.length("from_dir").alias("n"), "from_dir", "inherits")).alias("b"))
               .select("dir", "b.from_dir", "b.inherits"))
    out = rows.withColumn("dir", directory(F.col("path"))).join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    return out.select(*[c for c in files.columns if c != "text"], F.coalesce("license", "inherits").alias("license"), "score",
                      F.when(mine, "own").when(F.col("inherits").isNotNull(), "inherited").otherwise("none").alias("how"),
                      F.when(~mine, F.col("from_dir")).alias("from_dir"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source, thousand, hundred; every twentieth is its directory's licence file."""
    part = lambda n: F.coalesce(F.floor(F.col("doc_id") / n).cast("string"), F.lit("none"))
    name = F.when(F.col("doc_id") % 20 == 0, F.lit("LICENSE")).otherwise(
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), part(1000), part(100), name).alias("path"), "text")


def op7_licences(spark, sf_dir):
    """Licence of every document, its own or its directory's."""
    return licensed(document_paths(table(spark, sf_dir, "documents")))
