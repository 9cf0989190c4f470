import re
import textwrap
from pathlib import Path

from fairlineage.llm import licenses


def test_known_texts_hold_a_mark():
    for _, text in licenses.KNOWN:
        lowered = text.translate(str.maketrans(licenses._CAPITALS, licenses._SMALL))
        assert re.search(licenses.MARKS, lowered), text
    assert len(licenses.known_digests()) == len({licenses.canonical_text(t) for _, t in licenses.KNOWN})


def test_variants(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT")
    wrapped = "The MIT License (MIT)\n\nCopyright (c) 2001 Some One\nAll rights reserved.\n\n" + mit.replace("sublicense", "sub-license").upper()
    rows = [(1, wrapped), (2, "text\nReleased under the MIT licence\nmore\nLICENSED UNDER CC BY-NC 4.0!"), (3, "Released under the MIT License. Not"),
            (4, None), (5, ""), (6, mit.split("\n\n")[0]), (7, "intro\n\n" + "x" * 200_000 + "\n\nSPDX-License-Identifier: MIT\n"),
            (7, "intro\n\n" + "x" * 200_000 + "\n\nSPDX-License-Identifier: MIT\n"), (None, "Licensed under the Apache License, Version 2.0.")]
    got = sorted((tuple(r) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(1, "MIT", 1), (2, "CC-BY-NC-4.0,MIT", 2), (3, "", 0), (4, "", 0), (5, "", 0), (6, "", 0), (7, "MIT", 1), (7, "MIT", 1),
            (None, "Apache-2.0", 1)]
    assert got == sorted(want, key=str)


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["licenses"] for r in licenses.license_scan(docs).collect()}
    return [got[i] for i in range(len(texts))]


def wrapped(text, width):
    """Other line breaks; a paragraph with a notice, whose lines mean something, and lines of marks stay."""
    keep = lambda p: re.search(r"(?i)copyright \(c\)|copyright \[|[-=]{9}", p)
    return "\n\n".join(p if keep(p) else textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n[ \t]*\n", text))


def test_any_line_breaks(spark):
    notice = "Copyright (c) 2001-2004 Some One\n(C) Other One\n© 2005 Third One\nAll rights reserved.\n\n"
    known = {licenses.canonical_text(t): (n, t) for n, t in licenses.KNOWN}.values()
    cases = [(n, notice + wrapped(t, width)) for n, t in known
             for width in ((30, 55, 60, 64, 68, 72, 76, 80, 100, 100_000) if len(t) < 1500 else (55, 100_000))]
    assert [c for c, got in zip(cases, scanned(spark, [t for _, t in cases])) if got != c[0]] == []


def test_whole_texts_and_notices(spark):
    folder = Path(licenses.__file__).parent / "license_texts"
    cases = [(f.stem, f.read_text()) for f in folder.glob("*.txt")]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"} <= {n for n, _ in cases}
    apache = next(t for n, t in cases if n == "Apache-2.0")
    cases.append(("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2019 Some One")))
    cases.append(("GPL-2.0", next(t for n, t in cases if n == "GPL-2.0").replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
                                                                          "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA")))
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
           "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    mit = next(t for n, t in licenses.KNOWN if n == "MIT").split("\n")
    asl = ["Licensed under the Apache License, Version 2.0 (the \"License\");", "you may not use this file except in compliance with the License.",
           "You may obtain a copy of the License at", "", "    http://www.apache.org/licenses/LICENSE-2.0", "",
           "Unless required by applicable law or agreed to in writing, software", "distributed under the License is distributed on an \"AS IS\" BASIS,",
           "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
           "See the License for the specific language governing permissions and", "limitations under the License."]
    for name, lines in (("GPL-3.0", gpl), ("MIT", mit), ("Apache-2.0", asl)):
        for mark in (" * ", "# ", "// ", ";; ", "-- "):
            body = "\n".join(mark + x for x in ["Copyright (c) 2001 Some One", "Copyright 2002 Other", "", *lines])
            cases.append((name, (f"/*\n{body}\n */" if mark == " * " else body) + "\n\nint main();\n"))
    cases.append(("AGPL-3.0", " ".join(gpl).replace("GNU General", "GNU Affero General")))
    cases.append(("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."))
    assert [c for c, got in zip(cases, scanned(spark, [t for _, t in cases])) if got != c[0]] == []


def test_copyright_lines():
    notices = ["Copyright (c) 2001 A", "  COPYRIGHT 2001, 2002 A", "Copyright © A", "Copyright: 2001 A", "Copyright [yyyy] [name]", "(C) A B",
               "(c) 1999 You", "© A", "All rights reserved.", "Copyright A contributors. All rights reserved.", " * Copyright (c) 2001 A", "# (c) 2001 A", "// © A"]
    prose = ["copyright notice and this permission notice appear", "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", "Copyright license. Subject to",
             "(c) You must retain, in the Source form", "(c) under Patent Claims infringed", "copyright treaty adopted on 20 December 1996, or"]
    assert [licenses.canonical_text(x) for x in notices] == [""] * len(notices)
    assert all(licenses.canonical_text(x) == " ".join(re.findall("[a-z0-9]+", x.lower())) for x in prose)


def test_edges(edge_docs, edge_rows, no_docs):
    rows = licenses.license_scan(edge_docs).collect()
    assert len(rows) == len(edge_rows) and {r["doc_id"] for r in rows if r["n_units"]} == {11}
    assert licenses.license_scan(no_docs).collect() == []


def test_line_ends(spark):
    """Every known text, with line ends of both kinds, between other paragraphs."""
    known = [text for _, text in licenses.KNOWN if "\n\n" not in text]
    docs = [f"intro words\n\n{text}\n\nmore words\n" for text in known]
    plain = scanned(spark, docs)
    assert scanned(spark, [d.replace("\n", "\r\n") for d in docs]) == plain and all(plain)
