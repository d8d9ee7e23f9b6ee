"""Real licence texts, source headers, and inheritance held against brute force."""

import random
from pathlib import Path

import pytest

from quillsieve.llm import license_tfidf

SYSTEM = Path("/usr/share/common-licenses")
NAMES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
HEADERS = {
    "GPL-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope\nimport os\n",
    "GPL-2.0": "/*\n * This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU General Public License\n * as published by the Free Software Foundation; either version 2\n * of the License, or (at your option) any later version.\n */\nint main() {}\n",
    "LGPL-2.1": "// This library is free software; you can redistribute it and/or\n// modify it under the terms of the GNU Lesser General Public\n// License as published by the Free Software Foundation; either\n// version 2.1 of the License, or (at your option) any later version.\n\nx();\n",
    "ISC": "/* Copyright (c) 2020 A. Person\n *\n * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided that the above\n * copyright notice and this permission notice appear in all copies.\n */\n",
    "Apache-2.0": '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n',
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n",
}


@pytest.mark.skipif(not SYSTEM.is_dir(), reason="no licence texts on this machine")
def test_whole_licence_files_are_told_apart(spark):
    rows = [(k, f"pkg{k}/LICENSE", (SYSTEM / name).read_text()) for k, name in enumerate(NAMES) if (SYSTEM / name).is_file()]
    got = {r["path"]: r["license"] for r in license_tfidf.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    want = {f"pkg{k}/LICENSE": NAMES[name] for k, name in enumerate(NAMES) if (SYSTEM / name).is_file()}
    assert got == want


def test_source_headers_over_several_lines_are_found(spark):
    rows = [(k, f"src/f{k}.c", text) for k, text in enumerate(HEADERS.values())] + [(99, "src/plain.c", "int license_count = 3; // counts what is read\n" * 3)]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in license_tfidf.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {**{k: (name, "notice") for k, name in enumerate(HEADERS)}, 99: (None, "none")}


def test_inheritance_equals_brute_force(spark):
    random.seed(4)
    notices = ["Released under the MIT License.", "Released under the ISC License.", "Licensed under CC BY 4.0.", "nothing of the kind", ""]
    names = ["a", "b", "LICENSE", "x.py", "COPYING.txt", "y"]
    rows = []
    for k in range(300):
        parts = [random.choice("pqr") for _ in range(random.randrange(0, 5))]
        rows.append((k, "/".join([*parts, random.choice(names)]), random.choice(notices)))
    rows += [(300, "", "Released under the MIT License."), (301, None, "nothing"), (302, "p/q", None)]
    known = {"Released under the MIT License.": "MIT", "Released under the ISC License.": "ISC", "Licensed under CC BY 4.0.": "CC-BY-4.0"}
    got = {r["doc_id"]: (r["license"], r["origin"], r["license_dir"]) for r in license_tfidf.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    cosine = {r["license"]: r["cosine"] for r in license_tfidf.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).filter("origin = 'notice'").select("license", "cosine").distinct().collect()}
    held = {}
    for _, path, text in rows:
        if path and path.split("/")[-1] in ("LICENSE", "COPYING.txt") and text in known:
            where = "/".join(path.split("/")[:-1])
            held.setdefault(where, set()).add(known[text])
    for k, path, text in rows:
        if text in known:
            want = (known[text], "notice", None)
        else:
            parts = path.split("/")[:-1] if path is not None else None
            ups = [] if parts is None else ["/".join(parts[:n]) for n in range(len(parts), -1, -1)]
            near = next((u for u in ups if u in held), None)
            want = (None, "none", None) if near is None else (min(held[near], key=lambda name: (-cosine[name], name)), "inherited", near)
        assert got[k] == want, path


def test_templates_that_no_notice_can_reach_are_an_error(spark):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id long, path string, text string")
    with pytest.raises(ValueError, match="gate"):
        license_tfidf.scan_licenses(df, templates=(("Own", "all rights are with us"),))
    rows = license_tfidf.scan_licenses(spark.createDataFrame([(1, "a", "all rights are with us")], "doc_id long, path string, text string"), templates=(("Own", "all rights are with us"),), gate="rights").collect()
    assert rows[0]["license"] == "Own"


def test_long_text_of_many_notices(spark):
    text = "Released under the MIT License.\n\n" * 20_000
    rows = license_tfidf.scan_licenses(spark.createDataFrame([(1, "a/LICENSE", text)], "doc_id long, path string, text string")).collect()
    assert (rows[0]["license"], rows[0]["origin"]) == ("MIT", "notice")
