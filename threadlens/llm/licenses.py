"""License scans: sparse TF-IDF cosine to templates, then directory inheritance.

Of every file the notices are compared: its header, the first HEAD_LINES lines
that are not blank, and its last TAIL_LINES, where notices that close a text
stand; of a licence file all lines.  They are cut into lines, the sentences of a
line, and paragraphs (a licence file is also one segment as a whole).  A segment is a sparse vector of
its terms, weighted by (1 + ln tf) * idf with document frequencies of all terms
counted over all files.  The license of a file is the template with the largest
cosine of any segment, if that reaches the threshold.  A short template counts
only if the segment has all of its terms, and the shortest ones only for a whole
line, as a sentence amid others may well say such words of something else.

Only template terms add to a dot product, so executors need the frequencies of
those alone to find the segments that can reach the threshold even if every
other term had the least weight there is; the other terms of these few segments
are then joined to the table of all frequencies for the exact cosine.

A license found in a licence file also holds for its directory.  Files without
a license of their own take that of the nearest ancestor directory that has a
licence file, by joining each directory's ancestor paths to those directories.
If that file's text matches no template, its license is unknown, not that of a
directory further up.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, small_batches

THRESHOLD = 0.6
#: Lines at the beginning and the end of a file, blank ones not counted, that its notices stand in.
HEAD_LINES, TAIL_LINES = 30, 5
#: Distinct terms up to which all terms of a template have to occur, and up to which it has to be a whole line.
SHORT, SHORTEST = 6, 4

#: Notices and opening paragraphs that name each license.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. CC BY 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
)

#: Identifiers as files state them; each is a template of its own.
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {name}{end}") for name in dict(TEMPLATES) if name != "Proprietary" for end in ("", "-only", "-or-later")[: 3 if "GPL" in name else 1])

#: Names of licence files.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([-._].*)?$"

_TERMS = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*").findall
_MARKS = re.compile(r"^[\s#/*;%!<>-]+|[\s*/>-]+$")
_SENTENCES = re.compile(r"(?<=[.;!?])\s+").split

#: Distinct terms that a task counts before it hands its counts on.
COUNTED_TERMS = 200_000


def terms(text: str) -> list[str]:
    return _TERMS(text.lower())


def notices(text: str) -> list[str]:
    """The lines of a text's beginning and of its end; a blank line parts them where lines between are left out."""
    lines = text.split("\n")
    full = [k for k, line in enumerate(lines) if line.strip()]
    if len(full) <= HEAD_LINES + TAIL_LINES:
        return lines
    return [*lines[: full[HEAD_LINES - 1] + 1], "", *lines[full[-TAIL_LINES] :]]


def segments(text: str, whole: bool) -> Iterator[tuple[list[str], bool]]:
    """(terms, whether it is a sentence amid others) of each line of the notices, of its sentences if there are several, of paragraphs of several lines, and for a licence file of the whole text."""
    every, run, lines = [], [], 0
    text = text.lower()
    for line in [*(text.split("\n") if whole else notices(text)), ""]:
        parts = [found for part in _SENTENCES(line) if (found := _TERMS(part))]
        if parts:
            found = [t for p in parts for t in p] if len(parts) > 1 else parts[0]
            yield found, False
            if len(parts) > 1:
                yield from ((p, True) for p in parts)
            run += found
            lines += 1
            if whole:
                every.append(found)
        elif not _MARKS.sub("", line):  # blank but for comment marks
            if lines > 1:
                yield run, False
            run, lines = [], 0
    if len(every) > 1:
        yield [t for found in every for t in found], False


def idf_of(df: int, files: int) -> float:
    return math.log((1 + files) / (1 + df)) + 1


class Scanner:
    """Finds the segments near a template, with given document frequencies of the templates' terms."""

    def __init__(self, templates, df: dict[str, int], files: int):
        vocab = sorted({t for _, text in templates for t in terms(text)})
        self.idf = {t: idf_of(df.get(t, 0), files) for t in vocab}
        self.by_term: dict[str, list[tuple[int, float]]] = {t: [] for t in vocab}
        self.sets = [frozenset(terms(text)) for _, text in templates]
        for k, (_, text) in enumerate(templates):
            weights = {t: (1 + math.log(n)) * self.idf[t] for t, n in Counter(terms(text)).items()}
            length = math.sqrt(sum(w * w for w in weights.values()))
            for t, w in weights.items():
                self.by_term[t].append((k, w / length))

    def candidate(self, found: list[str], threshold: float, amid: bool = False) -> tuple[int, float, float, list[str], list[int]] | None:
        """(template, dot product, squared length within the vocabulary, other terms, their counts), or None where the cosine can't reach the threshold.

        A term in every file has idf 1, and no term has less.
        """
        distinct = set(found)
        inside = distinct & self.idf.keys()
        if not inside:
            return None
        count = found.count if len(found) <= 200 else Counter(found).__getitem__
        weights = {t: (1 + math.log(count(t))) * self.idf[t] for t in sorted(inside)}
        within = sum(w * w for w in weights.values())
        least = threshold * threshold * (1 - 1e-9) * (within + len(distinct) - len(inside))
        if within < least:  # by Cauchy and Schwarz
            return None
        dots: dict[int, float] = {}
        for t, w in weights.items():
            for k, v in self.by_term[t]:
                dots[k] = dots.get(k, 0.0) + w * v
        fit = [k for k in dots if dots[k] * dots[k] >= least]
        fit = [k for k in fit if len(self.sets[k]) > SHORT or (self.sets[k] <= distinct and not (amid and len(self.sets[k]) <= SHORTEST))]
        if not fit:
            return None
        k = min(fit, key=lambda k: (-dots[k], k))
        others = sorted(distinct - inside)
        return k, dots[k], within, others, [count(t) for t in others]


def frequencies(files: DataFrame) -> DataFrame:
    """term, n: in how many files each term occurs, over all files; the row of a null term counts the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, rows = Counter(), 0
        for batch in batches:
            for text in batch["text"]:
                counts.update(set(terms(text or "")))
                if len(counts) > COUNTED_TERMS:
                    yield pd.DataFrame({"term": list(counts), "n": list(counts.values())})
                    counts = Counter()
            rows += len(batch)
        yield pd.DataFrame({"term": [*counts, None], "n": [*counts.values(), rows]})

    return small_batches(files.select("text")).mapInPandas(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def own_licenses(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """file_id, path, is_license_file, is_blank, own_license, own_score for each row of (file_id, path, text).

    Ties go to the earlier segment, then to the earlier template.
    """
    names = [name for name, _ in templates]
    df = cut(frequencies(files))
    vocab = sorted({t for _, text in templates for t in terms(text)})
    known = {r["term"]: r["n"] for r in df.where(F.col("term").isNull() | F.col("term").isin(vocab)).collect()}  # one row a template term
    n = int(known.pop(None, 0))
    scanner = Scanner(templates, known, n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = []
            for text, whole in zip(batch["text"], batch["is_license_file"]):
                found = ((k, scanner.candidate(s, threshold, amid)) for k, (s, amid) in enumerate(segments(text or "", bool(whole))))
                near.append([dict(zip(fields, (k, *c))) for k, c in found if c])
            yield batch[["uid", "file_id", "path", "is_license_file", "is_blank"]].assign(near=near)

    fields = ("segment", "template", "dot", "within", "others", "counts")
    kind = files.schema["file_id"].dataType.simpleString()
    name = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE), F.lit(False))
    rows = files.select(F.monotonically_increasing_id().alias("uid"), "file_id", "path", name.alias("is_license_file"), (~F.coalesce("text", F.lit("")).rlike(r"\S")).alias("is_blank"), "text")
    near = "array<struct<segment int, template int, dot double, within double, others array<string>, counts array<int>>>"
    scanned = cut(small_batches(rows).mapInPandas(run, f"uid bigint, file_id {kind}, path string, is_license_file boolean, is_blank boolean, near {near}"))
    found = scanned.select("uid", F.inline("near"))
    words = found.where(F.size("others") > 0).select("uid", "segment", F.inline(F.arrays_zip(F.col("others").alias("term"), F.col("counts").alias("tf"))))
    idf = F.log(F.lit(1.0 + n) / (1 + F.col("n"))) + 1
    outside = words.join(df.where("term IS NOT NULL"), "term").groupBy("uid", "segment").agg(F.sum(F.pow((1 + F.log("tf")) * idf, F.lit(2.0))).alias("outside"))
    scored = found.drop("others", "counts").join(outside, ["uid", "segment"], "left")
    scored = scored.withColumn("score", F.col("dot") / F.sqrt(F.col("within") + F.coalesce("outside", F.lit(0.0)))).where(F.col("score") >= threshold)
    best = scored.groupBy("uid").agg(F.min(F.struct((-F.col("score")).alias("s"), "segment", "template")).alias("best"))
    listed = F.array(*[F.lit(x) for x in names]).cast("array<string>")
    best = best.select("uid", F.get(listed, F.col("best.template")).alias("own_license"), (-F.col("best.s")).alias("own_score"))
    return scanned.drop("near").join(best, "uid", "left").select("file_id", "path", "is_license_file", "is_blank", "own_license", "own_score")


def directory(path: Column) -> Column:
    """The path up to its last slash, '' for a file at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds license and licensed_by to own_licenses(): own, else that of the nearest ancestor with a licence file.

    licensed_by is 'self', the directory's path ('' for the root), or null where
    there is neither.  Where the licence files of that directory match no
    template, license is null; blank ones don't count.  Of several licence files in a directory the best
    score decides, then the smallest path, then the smallest license.  A null
    path has no directory.  Inheritance is worked out once for each directory
    that occurs, so its size follows the directories, not the files.
    """
    scanned = cut(scanned.withColumn("dir", directory(F.col("path"))))
    best = F.min(F.struct((-F.coalesce("own_score", F.lit(0.0))).alias("s"), "path", F.col("own_license").alias("license")))
    licensed = scanned.where("is_license_file AND NOT is_blank").groupBy("dir").agg(best.alias("best"))
    licensed = cut(licensed.select(F.col("dir").alias("ancestor"), F.col("best.license").alias("dir_license")))
    dirs = scanned.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    dirs = dirs.withColumn("parts", parts).select("dir", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"), "parts")
    dirs = dirs.select("dir", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("ancestor"))
    nearest = dirs.join(licensed, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "dir_license")).alias("near"))
    nearest = cut(nearest.select("dir", F.col("near.ancestor").alias("ancestor"), F.col("near.dir_license").alias("dir_license")))
    out = scanned.join(nearest, "dir", "left")
    own = F.col("own_license").isNotNull()
    return out.select(
        "file_id", "path", "is_license_file", "own_license", "own_score",
        F.when(own, F.col("own_license")).otherwise(F.col("dir_license")).alias("license"),
        F.when(own, F.lit("self")).otherwise(F.col("ancestor")).alias("licensed_by"),
    )


def license_scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The license of each file of (file_id, path, text), its own or inherited; one row for each input row.

    Null or empty text has no license of its own.  Other columns are ignored;
    repeated rows and ids stay.  Empty input gives an empty result.
    """
    return inherit(own_licenses(files, templates, threshold))
