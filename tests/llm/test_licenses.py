import math
import re
from collections import Counter

from threadlens.llm.licenses import HEAD_LINES, LICENSE_FILE, SHORT, SHORTEST, TAIL_LINES, TEMPLATES, license_scan

SCHEMA = "file_id bigint, path string, text string, license string, dir string, own_score string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def terms(text):
    return re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())


def segments(text, whole):
    """(text, amid others) of lines, their sentences, paragraphs of several lines, the whole of a licence file."""
    lines = text.split("\n")
    full = [k for k, x in enumerate(lines) if x.strip()]
    if not whole and len(full) > HEAD_LINES + TAIL_LINES:
        lines = [x for k, x in enumerate(lines) if k <= full[HEAD_LINES - 1]] + [""] + [x for k, x in enumerate(lines) if k >= full[-TAIL_LINES]]
    lines = [line.strip(" \t#/*;%!<>-") for line in lines]
    out, run = [], []
    for line in [*lines, ""]:
        if line:
            run.append(line)
            if terms(line):
                out.append((line, False))
                sentences = [x for x in re.split(r"(?<=[.;!?])\s+", line) if terms(x)]
                out += [(x, True) for x in sentences] if len(sentences) > 1 else []
        else:
            out += [(" ".join(run), False)] if sum(bool(terms(x)) for x in run) > 1 else []
            run = []
    return out + ([(" ".join(lines), False)] if whole and sum(bool(terms(x)) for x in lines) > 1 else [])


def fits(segment, amid, template):
    need = set(terms(template))
    return len(need) > SHORT or (need <= set(terms(segment)) and not (amid and len(need) <= SHORTEST))


def brute(rows, threshold=0.6, scores_only=False):
    df = Counter(t for r in rows for t in set(terms(r[2] or "")))
    idf = lambda t: math.log((1 + len(rows)) / (1 + df[t])) + 1
    vector = lambda text: {t: (1 + math.log(n)) * idf(t) for t, n in Counter(terms(text)).items()}
    length = lambda v: math.sqrt(sum(w * w for w in v.values()))
    cosine = lambda a, b: sum(w * b.get(t, 0) for t, w in a.items()) / (length(a) * length(b)) if a else 0
    own = {}
    for k, (_, path, text) in enumerate(rows):
        is_license = bool(path and re.search(LICENSE_FILE, path.split("/")[-1]))
        scores = [(cosine(vector(s), vector(x)), -j) for s, amid in segments(text or "", is_license) for j, (_, x) in enumerate(TEMPLATES) if fits(s, amid, x)]
        best = max(scores, default=(0, 0))
        own[k] = (TEMPLATES[-best[1]][0] if best[0] >= threshold else None, best[0], is_license)
    if scores_only:
        return [(r[0], own[k][1]) for k, r in enumerate(rows)]
    out = []
    for k, (i, path, _) in enumerate(rows):
        license, by = own[k][0], "self" if own[k][0] else None
        if not license and path:
            parts = path.split("/")[:-1]
            for depth in range(len(parts), -1, -1):
                at = "/".join(parts[:depth])
                here = sorted((-own[j][1] if own[j][0] else 0, r[1], own[j][0]) for j, r in enumerate(rows) if own[j][2] and (r[2] or "").strip() and "/".join(r[1].split("/")[:-1]) == at)
                if here:
                    license, by = here[0][2], at
                    break
        out.append((i, path, own[k][0], license, by))
    return sorted(out, key=str)


def brute_scores(rows):
    return brute(rows, scores_only=True)


ROWS = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "some code\nno notice"), (3, "a/b/LICENSE.txt", "# Licensed under the Apache License, Version 2.0."),
    (4, "a/b/y.py", "// This work is licensed under the GNU General Public License, version 3.\ncode"), (5, "z/w.py", None), (6, "a/w.py", ""), (7, None, "All rights reserved."),
    (8, None, "text"), (9, "COPYING", "Licensed under CC BY-NC 4.0."), (9, "COPYING", "Licensed under CC BY-NC 4.0."), (None, "q/r/s", "word " * 20_000 + "\nReleased under the MIT License."),
    (11, "m/LICENSE-1", "All rights reserved."), (12, "m/LICENSE-0", "Released under the MIT License."), (13, "m/n/o/p/q", "x"), (14, "a/NOTICE", "nothing of the kind here"),
    (15, "p/lines", "Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above copyright notice\nand this permission notice appear in all copies."),
    (18, "h/one", "/* Copyright (c) 2024 Jane Doe, Example Corp. Released under the MIT License. See docs for usage. */ int main() { return 0; }"),
    (19, "h/two", "# tool of the lab; Licensed under the Apache License, Version 2.0. Made by us all in one long line of words that no template knows"),
    (20, "h/three", "rare words stand beside released under mit license"), (21, "h/four", "the the the of the license and the public work"),
    (30, "s/story", "It was so.\n" * 500 + "He said: All rights reserved.\n" + "It went on.\n" * 40), (31, "s/tale", "see the story. All rights reserved. And so it goes"), (32, "s/end", "It was so.\n" * 500 + "All rights reserved."),
    (33, "l/COPYING", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    (34, "x/a.c", "// SPDX-License-Identifier: MIT\nint x;"), (35, "x/b.c", "// SPDX-License-Identifier: Zlib\nint x;"), (36, "x/c.c", "# SPDX-License-Identifier: GPL-2.0-only"),
    (37, "a/u/LICENSE", "Apache License"), (38, "a/u/v/w.py", "code"), (39, "a/e/LICENSE", " \n"), (40, "a/e/w.py", "code"),
    (16, "r/license/file", "the license of the public"), (17, "unlicensed", "this is free"),
]


def test_matches_brute_force(spark):
    got = license_scan(frame(spark, ROWS)).collect()
    assert sorted(((r.file_id, r.path, r.own_license, r.license, r.licensed_by) for r in got), key=str) == brute(ROWS)
    by = {r.file_id: r for r in got}
    assert by[2].license == "Apache-2.0" and by[2].licensed_by == "a/b" and by[4].license == "GPL-3.0" and by[6].licensed_by == "a"
    assert by[5].licensed_by == "" and by[8].license is None and by[15].own_license == "ISC" and by[None].own_license == "MIT"
    assert by[18].own_license == "MIT" and by[19].own_license == "Apache-2.0"
    assert by[30].own_license is None and by[31].own_license is None and by[32].own_license == "Proprietary"
    assert by[33].own_license == "LGPL-2.1" and by[34].own_license == "MIT" and by[35].own_license is None and by[36].own_license == "GPL-2.0"
    assert (by[37].license, by[38].license, by[38].licensed_by) == (None, None, "a/u") and (by[40].license, by[40].licensed_by) == ("MIT", "a")
    want = {r[0]: r for r in brute_scores(ROWS)}
    assert all(abs((r.own_score or 0) - want[r.file_id][1]) < 1e-9 for r in got if r.own_score)


def test_empty_table(spark):
    assert license_scan(frame(spark, [])).collect() == []
