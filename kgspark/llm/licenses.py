"""License scan: an index of the templates' shingles retrieves the places of a text, exact shingle containment verifies them.

All of it is DataFrame work. A text becomes its words (lower case, punctuation dropped), the words their shingles of one, two and
five words. These meet the shingles of all templates in one broadcast join, so every shared shingle is found and only shared ones are
shuffled; min-hash bands would need 24 hashes per word and size of template, and could miss. A template of ``SHORT`` words or more
matches where a stretch of three times its shingles (stretches start at each multiple of their number) holds ``CONTAINED`` of its
five-word shingles. A shorter one has shingles of two words (or one), which must all stand in their order without a gap, since
there one word more or less is another version.

The templates are ``TEMPLATES``, the short notices of ``notices()``, and the paragraphs of the whole texts in ``license_texts``
(``sections()``): each paragraph is a template of its own, so that a text with later clauses only is found too. Several templates have the
same name; a match is one row per text and name. Relatives that differ in a few words (GPL versions) are all reported, each
with its containment.

Defined results: a null or empty text has no match; a template that stands in a text several times is one match, with its
best containment and first place; repeated rows give repeated matches; an empty table gives an empty result; other columns may have any
name; a template without words is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .core import query, table

SHINGLE = 5
SHORT = 10  # words from which a template has shingles of SHINGLE words
CONTAINED = 0.8
SECTION = 10  # words that a section of a whole text has at least
WORDS = r"[\p{L}\p{N}]+(?:[.'\-][\p{L}\p{N}]+)*"
# fixed values: short notices, and openings of public license texts
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT (text)": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
                  "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
                  "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
                  "copies or substantial portions of the Software.",
    "Apache-2.0 (header)": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0 (header)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
                        "either version 3 of the License, or (at your option) any later version.",
    "BSD (text)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
                  "must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "MPL-2.0 (header)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "ISC (text)": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
                  "permission notice appear in all copies.",
    "GPL-2.0 (header)": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
                        "either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1 (header)": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
                         "either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0 (header)": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
                         "either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0 (header)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
                         "either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "Mozilla Public License, v. 2.0",
}
TEXTS = Path(__file__).parent / "license_texts"


def notices() -> list[tuple[str, str]]:
    """Name and text of the ways in which a license is named: what stands around them ("licensed under") does not matter."""
    out = [("MIT", t) for t in ("MIT License", "MIT Licence", "MIT licensed", "licensed under MIT", "license MIT", "licence MIT", "SPDX-License-Identifier: MIT", "Expat License")]
    for n, versions in (("Apache", ("2.0",)), ("Mozilla Public", ("1.1", "2.0")), ("Eclipse Public", ("1.0", "2.0")), ("Boost Software", ("1.0",)), ("Artistic", ("1.0", "2.0"))):
        short = {"Apache": "Apache", "Mozilla Public": "MPL", "Eclipse Public": "EPL", "Boost Software": "BSL", "Artistic": "Artistic"}[n]
        for v in versions:
            said = {v, v.removesuffix(".0")}
            forms = {f"{n} {w} {b}{x}" for w, x, b in product(("License", "Licence"), said, ("", "version ", "v", "v. ", "v "))} | {f"{short}-{v}"}
            forms |= {f"{short} {b}{x}" for x, b in product(said, ("", "v", "version "))}
            out += [(f"{short}-{v}", t) for t in forms]
    for full, short, versions in (("General", "GPL", "1 2 3"), ("Lesser General", "LGPL", "2.1 3"), ("Library General", "LGPL", "2"), ("Affero General", "AGPL", "3")):
        for v in versions.split():
            name = f"{short}-{v if '.' in v else v + '.0'}"
            said = {v, name.split("-")[1]}
            forms = {f"GNU {full} Public {w} {b}{x}" for w, x, b in product(("License", "Licence"), said, ("", "version ", "v", "v. ", "v "))}
            forms |= {f"version {x} of the GNU {full} Public License" for x in said} | {f"{short} {b}{x}" for x, b in product(said, ("", "v", "version ", "v. "))}
            forms |= {f"{short}{b}{x}{e}" for x, b, e in product(said, ("-", "v", "-v"), ("", "+", "-only", "-or-later"))}
            out += [(name, t) for t in forms]
    for short, full in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                        ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            forms = {f"CC {short} {v}", f"CC-{short} {v}", f"CC-{short}-{v}", f"CC {short}-{v}", f"CC {short.replace('-', ' ')} {v}"}
            forms |= {f"Creative Commons {f} {v}" for f in {full, full.replace("-", " "), full.replace("NonCommercial", "Non-Commercial").replace("ShareAlike", "Share Alike")}}
            out += [(f"CC-{short}-{v}", t) for t in forms]
    out += [("CC0-1.0", t) for t in ("CC0 1.0", "CC0-1.0", "Creative Commons Zero", "CC0 License", "licensed under CC0")]
    for n in "23":
        out += [(f"BSD-{n}-Clause", t) for t in (f"BSD {n}-Clause", f"BSD {n} Clause", f"BSD-{n}-Clause", f"{n}-Clause BSD", f"{n} Clause BSD")]
    out += [("BSD", "BSD License"), ("BSD", "BSD licensed"), ("ISC", "ISC License"), ("ISC", "licensed under ISC"), ("ISC", "SPDX-License-Identifier: ISC"), ("Zlib", "zlib License"), ("0BSD", "Zero-Clause BSD"), ("0BSD", "SPDX-License-Identifier: 0BSD")]
    out.append(("EPL-2.0 (header)", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"))
    return out + [("Unlicense", "The Unlicense"), ("Unlicense", "SPDX-License-Identifier: Unlicense"), ("Unlicense", "released into the public domain under the Unlicense")]


def sections() -> list[tuple[str, str]]:
    """Name and text of the sections of the whole texts: paragraphs, with short ones joined; without those that ``TEMPLATES`` has."""
    fixed = [set(shingles(template_words(t))) for t in TEMPLATES.values()]
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        parts, held = [], ""
        for paragraph in re.split(r"\n\s*\n", path.read_text(encoding="utf-8")):
            held += " " + paragraph
            if len(template_words(held)) >= SECTION:
                parts.append(held)
                held = ""
        if parts:
            parts[-1] += " " + held
        for part in parts:
            own = set(shingles(template_words(part)))
            if not any(len(own & f) >= CONTAINED * len(own) or len(own & f) >= CONTAINED * len(f) and len(f) > SHORT for f in fixed):
                out.append((f"{path.stem} (text)", part))
    return out


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.'\-][^\W_]+)*", text.lower())


def shingles(words: list[str]) -> list[str]:
    """The shingles of a template: five words, or two (one) in a short one."""
    k = SHINGLE if len(words) >= SHORT else min(2, len(words))
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if k else []


def default_templates() -> list[tuple[str, str]]:
    return [*TEMPLATES.items(), *notices(), *sections()]


def _places(words: Column, k: int) -> Column:
    """``at, shingle`` of every shingle of k words."""
    one = lambda i: F.struct((i - 1).alias("at"), F.xxhash64(F.array_join(F.slice(words, i, k), " ")).alias("shingle"))
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), one)).otherwise(F.array().cast("array<struct<at:int,shingle:bigint>>"))


def _index(spark, templates: Iterable[tuple[str, str]]) -> DataFrame:
    """``shingle, license, template, part, size, short``: ``part`` is the shingle's place in a short template, or its number among the distinct ones; ``size`` their count."""
    rows = []
    for i, (name, words) in enumerate(dict.fromkeys((n, tuple(template_words(t))) for n, t in templates)):
        short, own = len(words) < SHORT, shingles(list(words))
        own = own if short else list(dict.fromkeys(own))
        rows += [(s, name, i, j, len(own), short) for j, s in enumerate(own)]
    return spark.createDataFrame(rows, "text string, license string, template int, part int, size int, short boolean").select(F.xxhash64("text").alias("shingle"), "license", "template", "part", "size", "short")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, containment, at_word``: the templates that each text holds; ``at_word`` is the first word (from 0) that it shares there."""
    known = _index(docs.sparkSession, default_templates() if templates is None else templates.items())
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORDS), F.lit(0)).alias("words"))
    each = words.select("row", "doc_id", F.inline(F.concat(*[_places(F.col("words"), k) for k in (1, 2, SHINGLE)])))
    # written: numbers of rows must not be made twice
    hits = cut_lineage(each.join(F.broadcast(known), "shingle").select("row", "doc_id", "license", "template", "part", "size", "short", "at"))
    first = F.floor(F.col("at") / F.col("size")).cast("int")
    stretch = F.when(F.col("short"), F.array(F.col("at") - F.col("part"))).otherwise(F.sequence(first - 2, first))
    keys = ("row", "doc_id", "license", "template", "size", "short", "stretch")
    parts = hits.withColumn("stretch", F.explode(stretch)).groupBy(*keys, "part").agg(F.min("at").alias("at"))
    held = parts.groupBy(*keys).agg((F.count(F.lit(1)) / F.col("size")).alias("containment"), F.min("at").alias("at"))
    found = held.filter(F.col("containment") >= F.when(F.col("short"), 1.0).otherwise(CONTAINED))
    return found.groupBy("row", "doc_id", "license").agg(F.max("containment").alias("containment"), F.min("at").alias("at_word")).drop("row")


@query("op9_licenses")
def op9(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
