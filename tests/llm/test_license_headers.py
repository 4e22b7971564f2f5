"""Notices as they stand in source files: identifiers, wrapped comments, short licences in full."""

import textwrap

from tidelog.llm import licenses

FULL = dict(licenses.full_texts())
GPL_HEADER = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope "
    "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; "
    "if not, see <https://www.gnu.org/licenses/>."
)
APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain "
    "a copy of the License at"
)


def comment(text, lead, width=72):
    """The text's paragraphs, wrapped, each line of it after the mark of a comment."""
    paragraphs = [" ".join(p.split()) for p in text.split("\n\n")]
    return "\n".join(f"{lead} {line}".rstrip() for p in paragraphs for line in [*textwrap.wrap(p, width), ""])


CODE = "\nint main(void) {\n    return 0;\n}\n"
FILES = {
    "a/1.c": ("// SPDX-License-Identifier: GPL-2.0-only" + CODE, "GPL-2.0"),
    "a/2.c": ("/* SPDX-License-Identifier: GPL-3.0-or-later */" + CODE, "GPL-3.0"),
    "a/3.py": ("# SPDX-License-Identifier: MIT\nx = 1", "MIT"),
    "a/4.py": ("# SPDX-License-Identifier: Apache-2.0\nx = 1", "Apache-2.0"),
    "a/5.py": ("# SPDX-License-Identifier: BSD-3-Clause\nx = 1", "BSD-3-Clause"),
    "a/6.py": ("# SPDX-License-Identifier: LGPL-2.1-or-later\nx = 1", "LGPL-2.1"),
    "b/1.c": (comment("Copyright (c) 2021 Some Body\n\n" + FULL["MIT"], "//") + CODE, "MIT"),
    "b/2.c": ("/*\n" + comment("Copyright 2019 The Authors. All rights reserved.\n\n" + FULL["BSD-2-Clause"], " *") + "\n */" + CODE, "BSD-2-Clause"),
    "b/3.c": (comment(FULL["BSD-3-Clause"], "//") + CODE, "BSD-3-Clause"),
    "b/4.c": (comment(FULL["ISC"], "#", 60) + CODE, "ISC"),
    "b/5.c": (comment(GPL_HEADER, " *") + CODE, "GPL-2.0"),
    "b/6.c": (comment(GPL_HEADER.replace("version 2", "version 3"), ";;") + CODE, "GPL-3.0"),
    "b/7.c": (comment(GPL_HEADER.replace("General", "Lesser General").replace("version 2", "version 2.1"), "--") + CODE, "LGPL-2.1"),
    "b/8.c": (comment(APACHE_HEADER, "#") + "\n#     http://www.apache.org/licenses/LICENSE-2.0\n" + CODE, "Apache-2.0"),
    "c/1.txt": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
    "c/2.go": ("// Copyright 2012 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n\npackage main", "BSD-3-Clause"),
    "c/3.txt": ("Some words on the licence of a long work that nobody knows\nby name and that says no more than this.", None),
    "d/code.c": ("int x;", None),
    "e/LICENSE": (comment(FULL["MIT"], "", 50), "MIT"),
}


def test_notices_in_source_files(spark):
    rows = [(i, path, text) for i, (path, (text, _)) in enumerate(FILES.items())]
    rows += [(1000 + i, f"plain/{i}.txt", f"The river {i} runs past the old mill and on to the sea, as it did {i} years ago.\n" * 3) for i in range(200)]
    rows += [(2000, "e/src/x.c", "int y;")]
    got = {r["path"]: (r["license"], r["evidence"]) for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert {path: got[path][0] for path in FILES} == {path: name for path, (_, name) in FILES.items()}
    assert got["e/src/x.c"] == ("MIT", "inherited") and got["b/5.c"][1] == got["a/1.c"][1] == "header" and got["e/LICENSE"][1] == "file"
    assert not any(name for path, (name, _) in got.items() if path.startswith("plain/"))


def test_wrapped_lines_of_any_text(spark):
    texts = ["", None, "short\nlines", "x" * 50 + "\ny", "x" * 50 + ".\ny", "x" * 50 + " \r\ny", "x" * 50 + "\n\ny", " " * 200_000 + "license", "z" * 200_000 + "\n// w", "/** a */\n<!-- b -->", "*" * 200_000 + " "]
    want = ["", None, "short\nlines", "x" * 50 + " y", "x" * 50 + ".\ny", "x" * 50 + " y", "x" * 50 + "\n\ny", " " * 200_000 + "license", "z" * 200_000 + " w", "a \nb ", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = dict(frame.select("id", licenses.unwrapped(frame["text"])).collect())
    assert [got[i] for i in range(len(texts))] == want
