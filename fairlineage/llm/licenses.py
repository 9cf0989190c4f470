"""Licence scans by canonical digests.

Method. A text's canonical form is made of small letters and digits with single blanks: case and punctuation go,
copyright lines go, and equivalent spellings become one. Its SHA-256 is looked up among the digests of known licence
texts and notices. Looked up are entire texts: of a document, of each of its paragraphs (between empty lines), of each
of its lines. Units that hold none of the words which every known text has are dropped before they are normalised; this loses nothing.

The known digests are a fixed table given by the caller, so they are sent to all executors; documents are
not shuffled but for the findings, which are gathered per row.

Defined results: null and empty texts have no findings; repeated rows are all returned, each with its own; a null key is
kept; a text of any length is looked up whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is written in more than one way, in order of replacement.
SPELLINGS = (
    ("licence", "license"), ("licensor", "licenser"), ("sub-license", "sublicense"), ("sub license", "sublicense"),
    ("non-infring", "noninfring"), ("per cent", "percent"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("organisation", "organization"), ("authoris", "authoriz"), ("whilst", "while"), ("merchantibility", "merchantability"),
    ("https://", "http://"), ("&", " and "),
)
#: A line is a notice by what it begins with, behind comment marks, if any. Prose that is wrapped before 'copyright holders' or 'copyright notice' is none, nor
#: are the list items '(c) You ...' and '(c) under ...' of known texts, unless a year follows.
COPYRIGHT_LINE = (
    r"(^|\n)[\x20\t*#/;%!|<>~=+-]*(?:copyright[\x20\t:,]*(?:\(c\)|©|(?:19|20)[0-9]{2}|[\[<{])|copyright[^\n]*all rights reserved|©|all rights reserved"
    r"|\(c\)[\x20\t]*(?:[^\x20\tyu\n]|y[^o\n]|u[^n\n]|[^\n]*(?:19|20)[0-9]{2}))[^\n]*")
#: Every known text holds one of these words in its canonical form.
MARKS = r"licen[cs]e|permission|redistribution|warranty|public[^a-z0-9]+domain"

#: A paragraph of one line is looked up as that line.
TWO_LINES = r"\S\s*\n\s*\S"

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ZERO_BSD_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at"""
_ASF_NOTICE = """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE
file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you
under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at"""
_APACHE_TAIL = """http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
#: The licences of the Free Software Foundation: name, title, version.
_GNU = (("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
        ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"),
        ("AGPL-3.0", "GNU Affero General Public License", "3"))
#: Where the Foundation was and is.
_ADDRESSES = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
              "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA",
              "675 Mass Ave, Cambridge, MA 02139, USA")
_ADDRESS = re.compile(r"51 Franklin Street, Fifth Floor,\s+Boston, MA\s+02110-1301\s+USA")
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives",
       "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}


def _whole_texts() -> Iterator[tuple[str, str]]:
    """The texts in the folder ``license_texts``, with and without what follows their terms, and with every address."""
    for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = file.read_text()
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        for part in {text, terms, terms + end}:
            yield file.stem, part
            marked = _ADDRESS.sub("\0", part)
            if "\0" in marked:
                for address in _ADDRESSES:
                    yield file.stem, marked.replace("\0", address)
                # as published since the Foundation has no office: a link in the head, and in the notice
                linked = marked.replace("\0", "<https://fsf.org/>", 1)
                yield file.stem, re.sub(r"write to the Free\s+Software\s+Foundation, Inc.,\s+\0", "see <https://www.gnu.org/licenses/>", linked)



def _gnu_notices() -> Iterator[tuple[str, str]]:
    """The paragraph that grants, alone and with the two that follow it."""
    for name, title, version in _GNU:
        for what in ("program", "library", "software", "file"):
            may = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {title}"
            by = "as published by the Free Software Foundation"
            for grant in (f"{may} {by}, either version {version} of the License, or (at your option) any later version.",
                          f"{may} {by}, version {version} of the License.", f"{may} {by}, version {version}.",
                          f"{may} version {version} {by}.", f"{may}, version {version}, {by}.", f"{may}, version {version}."):
                yield name, grant
                for ends in (" If not, see <http://www.gnu.org/licenses/>.",
                             *(f" if not, write to the Free Software Foundation, Inc., {a}" for a in _ADDRESSES)):
                    yield name, (
                        f"{grant}\n\nThis {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
                        f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {title} for more details.\n\n"
                        f"You should have received a copy of the {title} along with this {what};{ends}")


def _cc_notices() -> Iterator[tuple[str, str]]:
    for code, title in _CC.items():
        name = f"CC-{code.upper()}-4.0"
        link = f"http://creativecommons.org/licenses/{code}/4.0/"
        for article in ("the", "a"):
            line = f"This work is licensed under {article} Creative Commons {title} 4.0 International License."
            visit = f"{line} To view a copy of this license, visit {link}"
            for text in (line, visit, visit + " or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."):
                yield name, text
        yield name, f"Licensed under CC {code.upper()} 4.0."
        yield name, f"This work is licensed under CC {code.upper()} 4.0."


def _identifiers() -> Iterator[tuple[str, str]]:
    names = ["MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "CC0-1.0", *(f"CC-{c.upper()}-4.0" for c in _CC)]
    for name in names:
        yield name, f"SPDX-License-Identifier: {name}"
    for name, _, _ in _GNU:
        for ends in ("", "+", "-only", "-or-later"):
            yield name, f"SPDX-License-Identifier: {name}{ends}"


#: Known texts, (licence, text). Titles are optional, so texts with and without them are listed.
KNOWN = (
    ("MIT", _MIT_BODY), ("MIT", "MIT License\n\n" + _MIT_BODY), ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("ISC", _ISC_BODY + "\n\n" + _ISC_TAIL), ("ISC", "ISC License\n\n" + _ISC_BODY + "\n\n" + _ISC_TAIL),
    ("0BSD", _ZERO_BSD_BODY + "\n\n" + _ISC_TAIL), ("0BSD", "BSD Zero Clause License\n\n" + _ZERO_BSD_BODY + "\n\n" + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + "\n\n" + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + "\n\n" + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "\n\n" + _BSD_THIRD + "\n\n" + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + "\n\n" + _BSD_THIRD + "\n\n" + _BSD_TAIL),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain."), ("CC0-1.0", "This work is in the public domain."),
    *((name, notice + "\n" + end) for name, notice in (("Apache-2.0", _APACHE_NOTICE), ("Apache-2.0", _ASF_NOTICE))
      for end in ("", _APACHE_TAIL.split("\n")[0], _APACHE_TAIL)),
    ("MPL-2.0", _MPL_NOTICE), *_whole_texts(), *_gnu_notices(), *_cc_notices(), *_identifiers(),
)

def canonical(text: Column) -> Column:
    """Canonical form of a text, as a column."""
    out = F.regexp_replace(F.translate(text, _CAPITALS, _SMALL), COPYRIGHT_LINE, "$1")
    for written, meant in SPELLINGS:
        out = F.replace(out, F.lit(written), F.lit(meant))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def canonical_text(text: str) -> str:
    """The same in Python, for the known texts."""
    out = re.sub(COPYRIGHT_LINE, r"\1", text.translate(str.maketrans(_CAPITALS, _SMALL)))
    for written, meant in SPELLINGS:
        out = out.replace(written, meant)
    return re.sub("[^a-z0-9]+", " ", out).strip()


def known_digests(known=KNOWN) -> Mapping[str, str]:
    """Digest → licence."""
    return {hashlib.sha256(canonical_text(text).encode()).hexdigest(): name for name, text in known}


def license_scan(docs: DataFrame, known=KNOWN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, licenses: distinct names in order, joined by commas; n_units: matching lines, paragraphs, whole texts)."""
    spark = docs.sparkSession
    digests = spark.createDataFrame(sorted(known_digests(known).items()), "digest string, license string")
    body = F.coalesce(F.col(text), F.lit(""))
    marked = lambda c: F.translate(c, _CAPITALS, _SMALL).rlike(MARKS)
    split = lambda by: F.split(body, by, -1)
    # a unit equal to a larger one (a text of one line) is looked up once
    lines, paragraphs = split("\n"), split(r"\n[\x20\t\r]*\n")
    units = F.concat(
        F.filter(lines, marked),
        F.filter(paragraphs, lambda p: marked(p) & p.rlike(TWO_LINES)),
        F.when((F.size(paragraphs) > 1) & marked(body), F.array(body)).otherwise(F.array().cast("array<string>")))
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(key).alias(key),
        F.when(marked(body), units).otherwise(F.array().cast("array<string>")).alias("_units"))
    looked = rows.select("_row", key, F.explode_outer("_units").alias("_unit")).select(
        "_row", key, F.sha2(canonical(F.col("_unit")), 256).alias("digest"))
    return (
        looked.join(F.broadcast(digests), "digest", "left")
        .groupBy("_row", key)
        .agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
             F.count("license").alias("n_units"))
        .drop("_row"))
