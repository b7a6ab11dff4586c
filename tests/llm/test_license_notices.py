"""Usual notices of many licences, near neighbours included."""

from pathlib import Path

from docframe.llm import license_notices
from docframe.llm.licenses import scan_licenses

NOTICES = [
    ("MIT", "MIT License"), ("MIT", license_notices._MIT[0]), ("MIT", "SPDX-License-Identifier: MIT"), ("Apache-2.0", f"{license_notices._APACHE} {license_notices._APACHE_REST}"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("MPL-2.0", "Mozilla Public License 2.0"), ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0"),
    ("CC-BY-4.0", "Released under CC BY 4.0"), ("CC0-1.0", "CC0 1.0 Universal"), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"), ("CC-BY-NC-SA-4.0", "License: CC BY-NC-SA 4.0"), ("CC0-1.0", "Released under CC0 1.0"),
    ("BSD-2-Clause OR BSD-3-Clause", license_notices._BSD), (None, "This is not licensed under the MIT license."), (None, "It is in the public domain of ideas that gardens grow."),
    (None, "You need no license or permission to walk in this park with your dog."), (None, "The driver showed a license and went on."),
]


def test_usual_notices(spark):
    texts = [(k, f"p{k}/x.py", f"code of {k}\n\n{text}\n\nmore code") for k, (_, text) in enumerate(NOTICES)]
    folder = Path(license_notices.__file__).parent / "license_texts"
    full = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0"}
    texts += [(100 + k, f"q{k}/LICENSE", "Copyright 2020 Jane Doe\n" + (folder / f"{name}.txt").read_text()) for k, name in enumerate(full)]
    got = {r.k: r.license for r in scan_licenses(spark.createDataFrame(texts, "k int, path string, text string")).collect()}
    want = {k: name for k, (name, _) in enumerate(NOTICES)} | {100 + k: name for k, name in enumerate(full.values())}
    assert got == want


def test_words_outside_the_templates_weigh_by_their_texts(spark):
    rows = [(k, f"a/{k}", "zorgon zorgon quux") for k in range(400)] + [(1000, "b/1", "Released under the MIT License zorgon quux flarb blip"), (1001, "b/2", "Released under the MIT License aa bb cc dd")]
    df = spark.createDataFrame(rows, "k int, path string, text string")
    score = {r.k: r.license_score or 0 for r in scan_licenses(df).filter("k >= 1000").collect()}
    assert score[1000] > score[1001]


N = license_notices
HOLDER = "Copyright (c) 2021, Jane Doe and the Foo Project\nAll rights reserved."
BODIES = {
    "BSD-2-Clause": [N._BSD, N._BSD_TWO.replace(" 2. ", "\n\n2. "), N._BSD_AS_IS], "BSD-3-Clause": [N._BSD, N._BSD_TWO.replace(" 2. ", "\n\n2. "), N._BSD_THIRD, N._BSD_AS_IS],
    "MIT": [*N._MIT, N._AS_IS], "ISC": [N._ISC + N._ISC_KEEP, N._ISC_AS_IS], "0BSD": [f"{N._ISC}.", N._ISC_AS_IS],
}


def test_full_texts_under_a_copyright_line(spark):
    """As licence files, in a README, as comment blocks and as a header of paragraphs; what folders inherit is the same."""
    rows = []
    for name, parts in BODIES.items():
        text = "\n\n".join([HOLDER, *parts])
        block = "\n".join("# " + line for line in text.replace("\n\n", "\n\n").split("\n"))
        rows += [(name, f"{name}/a/LICENSE", text), (name, f"{name}/b/COPYING", text), (name, f"{name}/c/README.md", f"Foo is a thing.\n\nIt does things.\n\n{text}\n\nBye.")]
        rows += [(name, f"{name}/d/x.py", f"{block}\n\nimport foo\n"), (name, f"{name}/e/y.txt", text), (name, f"{name}/a/deep/er/z.c", "int main;")]
    got = {r.path: r.license for r in scan_licenses(spark.createDataFrame(rows, "name string, path string, text string")).collect()}
    assert got == {path: name for name, path, _ in rows}
