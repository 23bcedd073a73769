"""License scan by sentence rules: known sentences become identifiers, and ordered
rules are matched against the sequence of identifiers (native)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short references to public licences, each as one sentence, with the
# identifier that it becomes.
REFERENCES: dict[str, str] = {
    "All rights reserved": "reserved",
    "Licensed under the Apache License, Version 2.0": "apache-ref",
    "Released under the MIT License": "mit-ref",
    "Licensed under the MIT License": "mit-ref",
    "This project is licensed under the MIT License": "mit-ref",
    "Licensed under CC BY 4.0": "cc-by-ref",
    "Licensed under CC BY-SA 4.0": "cc-by-sa-ref",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-ref",
    "Licensed under CC BY-ND 4.0": "cc-by-nd-ref",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-ref",
    "This work is licensed under the GNU General Public License version 3": "gpl3-ref",
    "This work is licensed under the GNU General Public License version 2": "gpl2-ref",
    "This work is dedicated to the public domain": "public-domain",
}

# What public licences and their notices say, of which every sentence
# counts. They are cut like any text.
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution."""
LESSER = """This library is free software; you can redistribute it and/or modify it under the terms
of the GNU Lesser General Public License as published by the Free Software Foundation;
either version 2.1 of the License, or (at your option) any later version."""
TEXTS: dict[str, tuple[str, bool, str]] = {
    "mit": ("MIT", True, """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software."""),
    "bsd2": ("BSD-2-Clause", True, BSD_2),
    "bsd3": ("BSD-3-Clause", True, BSD_2 + """

3. Neither the name of the copyright holder nor the names of its contributors may be used
to endorse or promote products derived from this software without specific prior written
permission."""),
    "isc": ("ISC", True, """Permission to use, copy, modify, and/or distribute this software for any purpose with
or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies."""),
    "apache": ("Apache-2.0", True, """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License."""),
    "apache-full": ("Apache-2.0", True, "Apache License\nVersion 2.0, January 2004"),
    "gpl3": ("GPL-3.0-or-later", False, """you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""),
    "gpl3-full": ("GPL-3.0", False, "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    "gpl2": ("GPL-2.0-or-later", False, """you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""),
    "gpl2-full": ("GPL-2.0", False, "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"),
    "lgpl21": ("LGPL-2.1-or-later", False, LESSER),
    "lgpl21-full": ("LGPL-2.1", False, "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"),
    "lgpl3": ("LGPL-3.0-or-later", False, """you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version."""),
    "lgpl3-full": ("LGPL-3.0", False, "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    "agpl3": ("AGPL-3.0-or-later", False, """you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version."""),
    "agpl3-full": ("AGPL-3.0", False, "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"),
    "mpl2": ("MPL-2.0", False, """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If
a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/."""),
    "mpl2-full": ("MPL-2.0", False, "Mozilla Public License Version 2.0"),
    "cc0": ("CC0-1.0", True, """To the extent possible under law, the author(s) have dedicated all copyright and related
and neighboring rights to this software to the public domain worldwide."""),
    "cc0-full": ("CC0-1.0", True, "CC0 1.0 Universal"),
    "unlicense": ("Unlicense", True, "This is free and unencumbered software released into the public domain."),
}


@dataclass(frozen=True)
class Rule:
    """`sentences` must occur in this order, other sentences may stand between."""

    license: str
    sentences: tuple[str, ...]
    permissive: bool

    def within(self, other: "Rule") -> bool:
        """Whether the other rule has all of this one, in order, and more."""
        rest = iter(other.sentences)
        return len(other.sentences) > len(self.sentences) and all(s in rest for s in self.sentences)


# Licences of the short references, and whether they are permissive.
REFERRED: dict[str, tuple[str, bool]] = {
    "apache-ref": ("Apache-2.0", True),
    "mit-ref": ("MIT", True),
    "gpl3-ref": ("GPL-3.0", False),
    "gpl2-ref": ("GPL-2.0", False),
    "cc-by-nc-ref": ("CC-BY-NC-4.0", False),
    "cc-by-nd-ref": ("CC-BY-ND-4.0", False),
    "cc-by-sa-ref": ("CC-BY-SA-4.0", False),
    "cc-by-ref": ("CC-BY-4.0", True),
    "public-domain": ("Public-Domain", True),
    "reserved": ("All-Rights-Reserved", False),
}

# Texts are cut in two ways, as a reference may be a line of its own and a licence is
# wrapped: at every line break, or at blank lines only; in both at . ! ? ; : before a blank.
LINES = r"\n+|[.!?;:]+[\x20\x09-\x0D]+"
PARAGRAPHS = r"\n[\x20\t\r]*(?:\n[\x20\t\r]*)+|[.!?;:]+[\x20\x09-\x0D]+"


def _sentences(text: str) -> list[str]:
    """A known text's sentences, cut and normalised; those of less than three words are
    too common to count."""
    pieces = (re.sub("[^a-z0-9]+", " ", p.lower()).strip() for p in re.split(PARAGRAPHS, text))
    return [p for p in pieces if p.count(" ") >= 2]


def _known() -> tuple[dict[str, str], tuple[Rule, ...]]:
    """Normalised sentence to identifier, and the rules of all texts and references."""
    known, rules = {}, []
    for name, (license_, permissive, text) in TEXTS.items():
        ids = [known.setdefault(s, f"{name}-{k}") for k, s in enumerate(_sentences(text), 1)]
        rules.append(Rule(license_, tuple(ids), permissive))
    known |= {re.sub("[^a-z0-9]+", " ", s.lower()).strip(): i for s, i in REFERENCES.items()}
    rules += [Rule(license_, (i,), permissive) for i, (license_, permissive) in REFERRED.items()]
    return known, tuple(rules)


SENTENCES, RULES = _known()


def covered_by(rules: tuple[Rule, ...], k: int) -> list[int]:
    """The rules in whose presence rule k is not told: those that contain it, and earlier
    ones of the same licence."""
    return [j for j, r in enumerate(rules) if rules[k].within(r) or (j < k and r.license == rules[k].license)]


def pattern(rule: Rule) -> str:
    """Finds the rule in `;a;b;|;c;`, the identifiers of either cut."""
    return ";" + ";(?:[^|]*;)?".join(_quote(s) for s in rule.sentences) + ";"


def normalised(sentence: Column) -> Column:
    """Lower case, runs of anything but ASCII letters and digits as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, known: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_sentences, n_known, sequence, licenses, n_licenses, permissive of every document.

    n_sentences: lines and sentences in them. sequence: identifiers of the recognised
    sentences in text order, comma-joined, by the cut (into lines, or into paragraphs)
    that gives more; n_known their number. licenses: every licence of which a rule
    matches in either cut, unless another rule that contains it does, in rule order,
    comma-joined. permissive: null without a license, else whether all are. A null or
    empty text has no sentence and no license; texts are read whole; repeated rows are
    judged alike; other columns are not looked at. An empty table gives no rows.

    A row needs only its own text: the tables of sentences and rules are literals
    of fixed size, so there is no join and no shuffle.
    """
    known = SENTENCES if known is None else known
    # Only sentences that hold a cue are normalised: the regular expressions cost
    # most, and each known sentence holds one of these words.
    cues = "(?iu)" + "|".join(sorted({_cue(s) for s in known}))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def identified(name: str) -> Column:
        hinted = F.filter(F.col(name), lambda s: s.rlike(cues))
        return F.filter(F.transform(hinted, lambda s: F.try_element_at(table, normalised(s))), lambda x: x.isNotNull())

    def joined(name: str) -> Column:
        return F.concat(F.lit(";"), F.array_join(name, ";"), F.lit(";"))

    matched = [F.col("line").rlike(pattern(r)) for r in rules]
    hits = []
    for k, hit in enumerate(matched):
        for j in covered_by(rules, k):
            hit = hit & ~matched[j]
        hits.append(F.when(hit, F.lit(k)))
    names = F.array(*[F.lit(r.license) for r in rules])
    permissive = F.array(*[F.lit(r.permissive) for r in rules])
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.select("doc_id", F.filter(F.split(text, LINES), lambda s: F.trim(s) != "").alias("lines"), F.split(text, PARAGRAPHS).alias("parts"))
        .select("doc_id", F.size("lines").alias("n_sentences"), identified("lines").alias("a"), identified("parts").alias("b"))
        .select("doc_id", "n_sentences", F.when(F.size("a") > F.size("b"), F.col("a")).otherwise(F.col("b")).alias("ids"),
                F.concat(joined("a"), F.lit("|"), joined("b")).alias("line"))
        .select("*", F.when(F.col("line") == ";;|;;", F.array().cast("array<int>")).otherwise(F.array_compact(F.array(*hits))).alias("hits"))
        .select(
            "doc_id",
            F.col("n_sentences").cast("long").alias("n_sentences"),
            F.size("ids").cast("long").alias("n_known"),
            F.array_join("ids", ",").alias("sequence"),
            F.array_join(F.transform("hits", lambda k: F.get(names, k)), ",").alias("licenses"),
            F.size("hits").cast("long").alias("n_licenses"),
            F.when(
                F.size("hits") > 0, F.forall("hits", lambda k: F.get(permissive, k))
            ).alias("permissive"),
        )
    )


def _cue(sentence: str) -> str:
    """The longest word of a known sentence."""
    return max(sentence.split(" "), key=len)


def _quote(identifier: str) -> str:
    return "".join(c if c.isalnum() or c == "-" else "\\" + c for c in identifier)
