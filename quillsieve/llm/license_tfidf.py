"""License scans by TF-IDF cosine to templates, inherited from the nearest ancestor directory; DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import materialize

# By SPDX identifier notices, the first paragraphs of standard source headers, and titles or first
# paragraphs of licence texts, as their publishers word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Artistic-1.0", 'The "Artistic License"'),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: A line that any notice has a word of.
GATE = r"(?i)licen[cs]e|copyright|spdx|public domain|redistribut|permission (?:is hereby|to use)|may be used to endorse|\bcc0?[ -](?:by|1\.0)"
LICENSE_FILE = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying|notice)(?:[.-][^/]*)?$"
#: What begins and ends the lines of comments.
OPENING, CLOSING = r"(?md)^[ \t]*(?://+|/\*+|\*+/?|#+|--+|;+|<!--|%+|\|)?[ \t]*", r"(?md)[ \t]*(?:\*+/|-->)?[ \t\r]*$"
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Template words go to every executor; more than this many is an error.
MAX_TEMPLATE_WORDS = 100_000
#: A word in at least this share of the notices is frequent. A notice has some dozens of words, so few words are.
FREQUENT = 1000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def notices(text: Column, path: Column, gate: str = GATE) -> Column:
    """What may be a notice: lines, paragraphs without their comment marks, and of a licence file its whole text too.

    Each holds a word of the gate. Null and empty texts have none.
    """
    ok = lambda x: x.rlike(gate)
    bare = F.regexp_replace(F.regexp_replace(text, OPENING, ""), CLOSING, "")
    paragraphs = F.transform(F.filter(F.split(bare, "\n\n+", -1), ok), lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(" "))))
    found = F.concat(F.filter(F.split(text, "\n", -1), ok), paragraphs, F.when(F.coalesce(path.rlike(LICENSE_FILE), F.lit(False)), F.array(text)).otherwise(F.array().cast("array<string>")))
    return F.when(ok(text), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def score_notices(found: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(key, license, cosine) of the best template of each distinct notice, given (key, notice, n) with counts n.

    A word's weight is its count times ln((1 + N) / (1 + df)) + 1, N and df counting all notices of the
    corpus with their repeats, and the templates. Ties go to the licence that sorts first. Words that
    many notices have are few and go to every executor; no task gets all notices of one word.
    """
    spark = found.sparkSession
    rows = [(f"t{i}", license_, text) for i, (license_, text) in enumerate(templates)]
    if sum(len(t.split()) for _, _, t in rows) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words")
    given = spark.createDataFrame(rows, "template string, license string, notice string").withColumn("word", F.explode(words(F.col("notice")))).groupBy("template", "license", "word").agg(F.count("*").alias("tf"))
    each = found.select("key", "n", words(F.col("notice")).alias("words"))
    counted = materialize(each.select("key", "n", F.explode("words").alias("word")).groupBy("key", "word").agg(F.count("*").alias("tf"), F.first("n").alias("n")), "counted")
    spread = counted.select("word", "n").unionByName(given.select("word", F.lit(1).cast("long").alias("n"))).groupBy("word").agg(F.sum("n").alias("df"))
    total = (found.agg(F.sum("n")).first()[0] or 0) + len(rows)
    idf = materialize(spread.select("word", "df", (F.log((F.lit(total) + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf")), "idf")
    frequent = F.col("df") * FREQUENT >= total
    often = F.broadcast(idf.filter(frequent).select("word", "idf"))
    with_idf = lambda df: df.join(often, "word").unionByName(df.join(often, "word", "left_anti").join(idf.filter(~frequent).select("word", "idf"), "word"))
    weighed = with_idf(counted).select("key", "word", (F.col("tf") * F.col("idf")).alias("w"))
    norm = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    sides = with_idf(given).select("template", "license", "word", (F.col("tf") * F.col("idf")).alias("tw"))
    lengths = sides.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    # bounded by MAX_TEMPLATE_WORDS
    sides = F.broadcast(sides.join(F.broadcast(lengths), "template"))
    dots = weighed.join(sides, "word").groupBy("key", "template", "license", "tnorm").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norm, "key").select("key", "license", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 9).alias("cosine"))
    return scored.groupBy("key").agg(F.min_by(F.struct("license", "cosine"), F.struct(-F.col("cosine"), "license")).alias("b")).select("key", "b.license", "b.cosine")


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = 0.6, templates=TEMPLATES, gate: str = GATE) -> DataFrame:
    """(id, path, license, cosine, origin, license_dir) for every row.

    origin is ``notice`` where the row's best own notice reaches ``threshold``, ``inherited`` where the
    nearest ancestor directory (its own first) with a licence file that reaches it gives the licence,
    else ``none`` with nulls. Of a directory's licence files the best notice counts, then the licence
    that sorts first. Only notices that match ``gate`` are weighed, and a template that does not match
    it is an error. Null paths have no directory; null and empty texts no notice; repeated rows stay;
    other columns are not read; an empty table gives an empty table.
    """
    lost = [text for _, text in templates if not re.search(gate, text)]
    if lost:
        raise ValueError(f"no notice like {lost[0]!r} would pass the gate")
    # One pass over the texts; what is kept of them is their notices.
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), notices(F.col(text_col), F.col(path_col), gate).alias("notices"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("dir", F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))), "files")
    lines = rows.select("row", "dir", "path", F.explode("notices").alias("notice")).withColumn("key", F.md5(F.col("notice").cast("binary")))
    distinct = materialize(lines.groupBy("key").agg(F.first("notice").alias("notice"), F.count("*").alias("n")), "notices")
    best = F.min_by(F.struct("license", "cosine"), F.struct(-F.col("cosine"), "license")).alias("b")
    # Tables of their own, so that a join on a popular notice or a directory above many others can be split.
    scored = materialize(score_notices(distinct, templates).filter(F.col("cosine") >= threshold), "scored")
    hits = materialize(lines.select("row", "dir", "path", "key").join(scored, "key"), "hits")
    own = hits.groupBy("row").agg(best).select("row", F.col("b.license").alias("own"), F.col("b.cosine").alias("own_cosine"))
    held = materialize(hits.filter(F.col("path").rlike(LICENSE_FILE)).groupBy("dir").agg(best).select(F.col("dir").alias("above"), F.col("b.license").alias("up"), F.col("b.cosine").alias("up_cosine")), "held")
    # A directory's ancestors, itself included, each with its depth; directories are resolved once, not per file.
    parts = F.split("dir", "/")
    climbs = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))
    tree = rows.select("dir").filter("dir IS NOT NULL").distinct().select("dir", F.explode(climbs).alias("c")).select("dir", "c.depth", "c.above")
    near = tree.join(held, "above").groupBy("dir").agg(F.max_by(F.struct("above", "up", "up_cosine"), "depth").alias("u")).select("dir", F.col("u.above").alias("license_dir"), "u.up", "u.up_cosine")
    out = rows.select("row", "id", "path", "dir").join(own, "row", "left").join(near, "dir", "left")
    mine = F.col("own").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.col("path").alias("path"),
        F.coalesce("own", "up").alias("license"),
        F.when(mine, F.col("own_cosine")).otherwise(F.col("up_cosine")).alias("cosine"),
        F.when(mine, "notice").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("license_dir")).alias("license_dir"),
    )
