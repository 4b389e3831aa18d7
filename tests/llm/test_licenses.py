import math
import re
from collections import Counter

from tessera.llm import license_scan as L, queries


def brute(text, templates=L.TEMPLATES, only=None):
    """Best cosine and its license; ``only``: of the last template of these licenses."""
    rows = {}
    for i, name, term, weight, idf in L.template_weights(templates):
        rows.setdefault((i, name), {})[term] = weight
    last = {name: max(i for i, n in rows if n == name) for _, name in rows}
    rows = {k: v for k, v in rows.items() if only is None or (k[1] in only and last[k[1]] == k[0])}
    idf = {t: f for _, _, t, _, f in L.template_weights(templates)}
    unseen = math.log(1 + sum(map(len, templates.values()))) + 1
    w = {t: n * idf.get(t, unseen) for t, n in Counter(L.terms(text)).items()}
    size = math.sqrt(sum(x * x for x in w.values())) or 1
    c, name = min((-round(sum(w.get(t, 0) * x for t, x in v.items()) / size, 6), name) for (_, name), v in rows.items())
    return -c, name


def test_lines_files_and_inheritance(spark):
    mit = L.TEMPLATES["MIT"][1]
    files = [
        ("a/LICENSE", mit), ("a/b/c/code.py", "print(1)"), ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        ("d/x.py", "import os\nprint(2)"), ("top.txt", None), (None, "no path"), ("a/own.py", "# code\n# This work is licensed under the GNU General Public License, version 3.\nx = 1\n" * 3 + "y = 2\n" * 3000),
        ("a/deep.md", "license to speak of nothing in particular, dear reader, with many more words"), ("a/b/c/code.py", "print(1)"),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    got = {}
    for r in L.scan(df).collect():
        got.setdefault(r.path, []).append((r.license, r.origin, r.license_path))
    assert got["a/LICENSE"] == [("MIT", "own", None)]
    assert got["a/b/c/code.py"] == [("Apache-2.0", "inherited", "a/b/LICENSE.txt")] * 2
    assert got["d/x.py"] == [(None, None, None)] and got["top.txt"] == [(None, None, None)] and got[None] == [(None, None, None)]
    assert got["a/own.py"] == [("GPL-3.0", "own", None)]
    assert got["a/deep.md"] == [("MIT", "inherited", "a/LICENSE")]
    assert L.scan(df.limit(0)).count() == 0


def pieces(text):
    """The pieces of a text with a cue, by Python: (single, text)."""
    cue = re.compile(L.CUES, re.A)
    raw = re.split(r"\r\n|\n|\r", text)
    plain = [re.sub(L.MARKS, "", x, flags=re.A) for x in raw]
    at = [i for i in range(len(plain)) if cue.search(" ".join(plain[i : i + 2]))]
    near = lambda i, x, y: " ".join(plain[max(0, i - x) : i + y + 1])
    split = lambda x: re.split(L.SENTENCE, x, flags=re.A)
    single = [y for x in raw if cue.search(x) for y in split(x)]
    other = [y for i in at for y in split(near(i, L.AROUND, L.AROUND))] + [near(i, x, y) for i in at for x, y in L.WINDOWS]
    code = next((i for i, x in enumerate(raw) if not re.search(L.COMMENT, x, re.A)), 0)
    block = re.search(r"^\s*/\*([\s\S]*?)\*/", text, re.A)
    other += [" ".join(plain[:code]), block[1] if block else ""]
    return [(True, x) for x in dict.fromkeys(single) if cue.search(x)] + [(False, x) for x in dict.fromkeys(other) if cue.search(x)]


def own_license(text):
    """License, cosine and whether it is a license file, of one text, by Python."""
    if not re.search(L.CUES, text, re.A):
        return None, None, False
    full = L.full_texts()
    every = {name: [*L.TEMPLATES.get(name, []), *full.get(name, [])] for name in {*L.TEMPLATES, *full}}
    found, words = [], max(len(L.terms(text)), 1)
    for single, t in pieces(text):
        c, name = brute(t)
        if c >= L.LEAST:
            found.append((-c, name, len(L.terms(t)) / words if single else 0.0, False))
    for table in (L.TEMPLATES, every):
        c, name = brute(text, table, full if table is every else None)
        if c >= L.LEAST:
            found.append((-c, name, 0.0, True))
    if not found:
        return None, None, False
    best = min(found)
    return best[1], -best[0], any(f[3] for f in found) or sum(f[2] for f in found) >= L.SHARE


def test_query_against_brute_force(spark, sf):
    """Every document: its own license, or that of the best license file of its source."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    own = {r.doc_id: own_license(r.text) for r in docs}
    given = {}
    for r in docs:
        name, c, is_file = own[r.doc_id]
        if name and is_file:
            new = (-c, name, f"{r.source}/{r.doc_id}.txt")
            given[r.source] = min(given.get(r.source, new), new)
    got = {r.doc_id: (r.license, r.cosine, r.origin, r.license_path) for r in queries.op5_license_scan(spark, sf).collect()}
    want = {}
    for r in docs:
        name, c, _ = own[r.doc_id]
        if name:
            want[r.doc_id] = (name, c, "own", None)
        else:
            g = given.get(r.source)
            want[r.doc_id] = (g[1], -g[0], "inherited", g[2]) if g else (None, None, None, None)
    wrong = {i: (got[i], want[i]) for i in want if got[i][::2] != want[i][::2] or got[i][3] != want[i][3] or (want[i][1] is not None and abs(got[i][1] - want[i][1]) > 2e-6)}
    assert set(got) == set(want) and not wrong
    assert any(w[2] == "own" for w in want.values())


def test_ids_of_any_kind_and_clashing_columns(spark):
    text = "Licensed under the Apache License, Version 2.0."
    rows = [(None, "a/LICENSE", text, 1, "x"), (-5, "a/b.py", "x = 1", 2, "y"), (-5, "a/b.py", "x = 1", 3, "z"), (7, None, None, 4, None), (8, "a/c.py", "word " * 50_000, 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, key int, license string")
    got = sorted(((r.doc_id or 0), r.path or "", r.license or "", r.origin or "") for r in L.scan(df, id_col="doc_id").collect())
    assert got == [(-5, "a/b.py", "Apache-2.0", "inherited"), (-5, "a/b.py", "Apache-2.0", "inherited"), (0, "a/LICENSE", "Apache-2.0", "own"), (7, "", "", ""), (8, "a/c.py", "Apache-2.0", "inherited")]


def test_full_license_texts_of_any_length_give_their_directory_a_license(spark):
    full = L.full_texts()
    assert len(full["GPL-3.0"][0].split()) > 4000
    files = [(f"{name}/TERMS", text) for name, [text] in full.items()] + [(f"{name}/a/x.py", "print(1)") for name in full]
    files += [("own/COPYING", "GNU General Public License, version 3\n" + "lorem ipsum dolor\n" * 3000), ("own/x.py", "print(1)"), ("code/a.py", "# This work is licensed under the GNU General Public License, version 3.\n" + "x = 1\n" * 3000), ("code/x.py", "print(1)")]
    got = {r.path: (r.license, r.origin) for r in L.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    for name in full:
        assert got[f"{name}/TERMS"] == (name, "own") and got[f"{name}/a/x.py"] == (name, "inherited"), name
    assert got["own/x.py"] == ("GPL-3.0", "inherited")
    assert got["code/a.py"] == ("GPL-3.0", "own") and got["code/x.py"] == (None, None)


def test_notices_wrapped_over_lines_in_longer_files(spark):
    code = "value = compute(first, second)\nresult.append(value)\n" * 400
    mpl = ["This Source Code Form is subject to the terms of the Mozilla Public", "License, v. 2.0. If a copy of the MPL was not distributed with this", "file, You can obtain one at https://mozilla.org/MPL/2.0/."]
    gpl = ["This program is free", "software: you can redistribute it and/or modify it under the terms of", "the GNU General Public License as published by the Free Software", "Foundation, either version 3 of the License, or (at your option)", "any later version."]
    mit = L.full_texts()["MIT"][0].splitlines()
    wrap = {"hash": ("", "# ", ""), "slash": ("", "// ", ""), "star": ("/*\n", " * ", " */\n"), "bare": ("/*\n", "", "*/\n")}
    files, want = [("none.py", code)], {"none.py": None}
    for kind, (top, mark, end) in wrap.items():
        for name, lines in (("MPL-2.0", mpl), ("GPL-3.0", gpl), ("MIT", mit)):
            for place in ("top", "late"):
                notice = top + "".join(f"{mark}{x}\n" for x in lines) + end
                files.append((f"{kind}-{place}-{name}", notice + code if place == "top" else code + notice + code))
                want[files[-1][0]] = name
    got = {r.path: r.license for r in L.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == want
