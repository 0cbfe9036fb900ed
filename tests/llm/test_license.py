"""License scans against plain Python."""

import math
import re
import textwrap
from collections import Counter

from pyspark.sql import functions as F

import tallyweave.llm.license_scan as m
from tallyweave.llm import entries
from tests.llm.conftest import SF_DIR


SIGNS = ["/*", "*", "//", "#", "--", ";", "%", "<!--", '"""', "'''"]


def clean(line):
    """(the line without comment signs, whether it had one), sign by sign."""
    rest, sign = line.strip(), False
    for s in SIGNS:
        if rest.startswith(s):
            sign, repeated = True, s[-1] if s in ("/*", "*", "//", "#", "--", ";", "%") else ""
            rest = rest[len(s) :].lstrip(repeated) if repeated else rest[len(s) :]
            rest = rest[1:] if s == "*" and rest.startswith("/") else rest
            break
    rest = rest.strip()
    for s in ("*/", "-->", '"""', "'''"):
        if rest.endswith(s):
            rest = rest[: -len(s)].rstrip("*") if s == "*/" else rest[: -len(s)]
            break
    return rest.strip(), sign or not line.strip()


def sentences(part):
    out, start = [], 0
    for i, ch in enumerate(part):
        if ch in ".!?;:" and part[i + 1 : i + 2] in (" ", "\t") and not part[: i + 1].endswith("Identifier:"):
            out.append(part[start : i + 1])
            start = i + 1
    return [*out, part[start:]]


def candidates(path, text):
    cleaned = [clean(line) for line in text.split("\n")]
    lines, blocks, head = [c for c, _ in cleaned], [[]], []
    for c in lines:
        blocks[-1].append(c) if c else blocks.append([])
    for c, commented in cleaned:
        if not commented:
            break
        head.append(c)
    blocks = [" ".join(b) for b in blocks]
    found = {s for part in lines + blocks for s in sentences(part)} | set(blocks) | {" ".join(head)}
    name = (path or "").rpartition("/")[2].lower()
    if name.split(".")[0] in ("license", "licence", "copying", "notice"):
        found.add(" ".join(lines))
    return {c for c in found if re.search(m.ANCHOR, c)}


def brute(files):
    listed = [(name, Counter(re.findall("[a-z0-9]+", t.lower()))) for name, ts in m.TEMPLATES.items() for t in ts]
    seen = Counter(t for _, c in listed for t in c)
    weigh = lambda counts: {t: n * (math.log((1 + len(listed)) / (1 + seen.get(t, 1))) + 1) for t, n in counts.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(name, weigh(c)) for name, c in listed]

    def own(path, text):
        best = (0.0, None)
        for p in candidates(path, text or ""):
            tf = weigh(Counter(re.findall("[a-z0-9]+", p.lower())))
            for name, v in vectors:
                if all(n in tf for n in re.findall("[1-9]", name) if not name.startswith("BSD")):
                    dot = sum(x * tf.get(t, 0) for t, x in v.items()) / norm(v) / max(norm(tf), 1e-9)
                    if dot and (-round(min(1, dot), 9), name) < (-best[0], best[1] or "~"):
                        best = (round(min(1, dot), 9), name)
        return best

    found = [(p, *own(p, t)) for p, t in files]
    declared = {}
    for p, score, name in found:
        if p is not None and score >= m.FLOOR and re.match(m.LICENCE_FILE, p.rpartition("/")[2]):
            folder = p.rpartition("/")[0]
            declared[folder] = min(declared.get(folder, (1, "")), (-score, name))
    out = []
    for p, score, name in found:
        mine = name if score >= m.FLOOR else None
        at = None
        if mine is None and p is not None:
            folder = p.rpartition("/")[0]
            while at is None:
                if folder in declared:
                    at = folder
                elif not folder:
                    break
                folder = folder.rpartition("/")[0]
        out.append((p, mine, round(score, 6), at, mine or (declared[at][1] if at is not None else None)))
    return sorted(out, key=str)


FILES = [
    ("/LICENSE", "Some words.\nReleased under the MIT License."), ("/a/b/x.txt", "nothing"), ("/a/COPYING.md", "Licensed under the Apache License, Version 2.0."),
    ("/a/b/c/y.txt", None), ("/z.txt", ""), ("rel.txt", "no"), ("r/LICENSE", "Licensed under CC BY-NC 4.0."), ("r/s/t.txt", "x"), ("rr/t.txt", "x"), (None, "Licensed under CC BY 4.0."),
    (None, "x"), ("/a/NOTICE", "This work is licensed under the GNU General Public License, version 3."), ("/a/b/own.py", "q. Licensed under CC BY 4.0. z"), ("/d/LICENSE", "my license is secret"),
    ("/d/e", "x"), ("/a/b/x.txt", "nothing"), ("/long", "word " * 200000 + "\nReleased under the MIT License.\n" + "license " * 5000),
]


def test_files(spark):
    frame = spark.createDataFrame(FILES, "path string, text string").withColumn("license", F.lit("x")).withColumn("_row", F.lit(1))
    got = m.scan(frame, keep=["_row"]).collect()
    assert sorted(((r["path"], r["own_license"], round(r["score"], 6), r["inherited_from"], r["license"]) for r in got), key=str) == brute(FILES)
    assert got[0]["_row"] == 1
    assert m.scan(frame.limit(0)).count() == 0


def test_documents(spark):
    got = entries.QUERIES["op8_license_scan"](spark, SF_DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(SF_DIR + "/documents.parquet").collect()}
    want = brute([(r["path"], texts[r["doc_id"]]) for r in got])
    assert len(got) == len(texts)
    assert sorted(((r["path"], r["own_license"], round(r["score"], 6), r["inherited_from"], r["license"]) for r in got), key=str) == want
    assert any(r["own_license"] for r in got)


def wrapped(text, width, sign=""):
    return "\n".join(f"{sign}{line}" for line in textwrap.wrap(text, width))


BSD = m._SOURCE_AND_BINARY.replace(" 1.", "\n\n1.").replace(" 2.", "\n2.")
NOTICES = [
    ("a.c", "/*\n" + wrapped(m.TEMPLATES["GPL-3.0"][2], 60, " * ") + "\n *\n * This program is distributed in the hope that it will be useful.\n */\nint x;", "GPL-3.0"),
    ("a.py", "#!/usr/bin/env python\n# Copyright 2020 Some One\n#\n" + wrapped(m.TEMPLATES["GPL-2.0"][1], 50, "# ") + "\n\nimport os", "GPL-2.0"),
    ("b.h", wrapped(m.TEMPLATES["LGPL-2.1"][1], 55, "// ") + "\nint y;", "LGPL-2.1"),
    ("b3.h", wrapped(m.TEMPLATES["LGPL-3.0"][1], 55, "// ") + "\nint y;", "LGPL-3.0"),
    ("b.sql", wrapped(m.TEMPLATES["AGPL-3.0"][1], 70, "-- ") + "\nSELECT 1", "AGPL-3.0"),
    ("c.js", "/* " + wrapped(m.TEMPLATES["MPL-2.0"][1], 60) + " */\nlet z", "MPL-2.0"),
    ("c.java", "/*\n * Copyright 2021 The Owners\n *\n" + wrapped(m.TEMPLATES["Apache-2.0"][2], 70, " * ") + "\n */\nclass A {}", "Apache-2.0"),
    ("d.rs", "// SPDX-License-Identifier: MIT\nfn main() {}", "MIT"),
    ("d.c", "// SPDX-License-Identifier: GPL-2.0-only\nint main;", "GPL-2.0"),
    ("e.c", "/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"),
    ("x/LICENSE", "Copyright (c) 2019, Some One\nAll rights reserved.\n\n" + wrapped(BSD, 70) + "\n\n" + wrapped(m._NO_ENDORSEMENT, 70) + "\n\n" + wrapped(m._AS_IS, 70), "BSD-3-Clause"),
    ("y/LICENSE.txt", "Copyright (c) 2019, Some One\n\n" + wrapped(BSD, 70) + "\n\n" + wrapped(m._AS_IS, 70), "BSD-2-Clause"),
    ("z.c", "/*\n * Copyright (c) 2019\n *\n" + wrapped(m._SOURCE_AND_BINARY, 70, " * ") + "\n *\n" + wrapped(m._AS_IS, 70, " * ") + "\n */\nint z;", "BSD-2-Clause"),
    ("w/LICENSE", "MIT License\n\nCopyright (c) 2020 A B\n\n" + wrapped(m.TEMPLATES["MIT"][4], 72), "MIT"),
    ("v/COPYING", "      GNU GENERAL PUBLIC LICENSE\n       Version 3, 29 June 2007\n\n Copyright (C) 2007\n Everyone is permitted to copy.\n\n  Preamble\n\n" + "The licenses for most works are long. " * 300, "GPL-3.0"),
    ("u/COPYING", "      GNU GENERAL PUBLIC LICENSE\n       Version 2, June 1991\n\n Preamble", "GPL-2.0"),
    ("t/LICENSE", "       Apache License\n     Version 2.0, January 2004\n   http://www.apache.org/licenses/\n\n TERMS AND CONDITIONS", "Apache-2.0"),
    ("two.txt", "This work is licensed under the GNU General Public\nLicense, version 3.", "GPL-3.0"),
    ("cut.txt", "This work is licensed under the GNU General Public", None),
    ("none.txt", "Your driving license is a permission to drive; no warranty is given for the car.", None),
    ("own.txt", "Copyright 2020 Some One. All rights reserved.", None),
]


def test_notices(spark):
    frame = spark.createDataFrame([(p, t) for p, t, _ in NOTICES], "path string, text string")
    got = {r["path"]: r for r in m.scan(frame).collect()}
    assert {p: got[p]["own_license"] for p, _, _ in NOTICES} == {p: want for p, _, want in NOTICES}
    want = brute([(p, t) for p, t, _ in NOTICES])
    assert sorted(((r["path"], r["own_license"], round(r["score"], 6), r["inherited_from"], r["license"]) for r in got.values()), key=str) == want
