"""License scans by sentence rules, with DataFrame functions only.

Texts are normalised whole (lower case, other than a-z and 0-9 to one space, so line breaks, comment marks and
semicolons cut nothing) and searched for known licence sentences, the leftmost longest first; other words are left out.
The identifiers in order form a sequence, and the rules are matched against it in their own order: a rule that finds its
identifiers side by side takes them out, everywhere, so later, more general rules do not match them again.

Kinds of rules: "text" (the licence's own words), "notice" (the notice that it asks for), "reference" (a sentence that
names it), "tag" (an SPDX tag) and "clue" (a sentence of some licence, left over by the other rules).  A licence is
reported for all kinds but clues.

Rows: a null or empty text has no sentences.  Repeated sentences give repeated identifiers; a rule that matches more
than once is reported once.  Without a match ``licenses`` is "" and ``n_known`` counts the known sentences (0 or more).
Every row, repeated or not, is reported on its own, so there are no ties; texts of any length are scanned whole; no
shuffle.  An empty table gives an empty result.  Only id and text are read, so further columns play no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and their usual notices, normalised, some of them up to a known point.
SHORT = {
    "apache-by": "licensed under the apache license version 2 0",
    "apache-the": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-short": "released under the apache license 2 0",
    "mit-by": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "gpl3-by": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "bsd-redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "mpl-by": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "ccbync-by": "licensed under cc by nc 4 0",
    "ccbync-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "ccby-by": "licensed under cc by 4 0",
    "ccby-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0-by": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
}

_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation either version {} of the license or at your option any later version"
_RECEIVED = "you should have received a copy of the gnu {}general public license along with this program"
_CC = "this work is licensed under a creative commons attribution {} 4 0 international license"

#: Whole sentences, normalised.
WHOLE = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl2-free": _GPL.format("", "2"),
    "lgpl3-free": _GPL.format("lesser ", "3"),
    "lgpl21-free": _GPL.format("lesser ", "2 1"),
    "agpl3-free": _GPL.format("affero ", "3"),
    "lgpl-received": _RECEIVED.format("lesser "),
    "agpl-received": _RECEIVED.format("affero "),
    "gpl2-by": "this work is licensed under the gnu general public license version 2",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-licensed": "licensed under the bsd license",
    "bsd2-licensed": "licensed under the bsd 2 clause license",
    "bsd3-licensed": "licensed under the bsd 3 clause license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-licensed": "licensed under the isc license",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "epl-made": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "epl-licensed": "licensed under the eclipse public license 2 0",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "bsl-licensed": "distributed under the boost software license version 1 0",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "ccbysa-by": "licensed under cc by sa 4 0",
    "ccbysa-work": _CC.format("sharealike"),
    "ccbynd-by": "licensed under cc by nd 4 0",
    "ccbynd-work": _CC.format("noderivatives"),
    "ccbyncsa-by": "licensed under cc by nc sa 4 0",
    "ccbyncsa-work": _CC.format("noncommercial sharealike"),
    "ccbyncnd-by": "licensed under cc by nc nd 4 0",
    "ccbyncnd-work": _CC.format("noncommercial noderivatives"),
    "all-rights": "all rights reserved",
}

#: Names that may follow an SPDX tag.
TAGGED = ("Apache-2.0", "MIT", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0")


def normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


#: Identifiers of all forms: the sentences, the library's own wording of GNU notices, and tags.
FORMS = {s: i for i, s in [*SHORT.items(), *WHOLE.items()]}
FORMS |= {s.replace("this program", "this library"): i for s, i in FORMS.items() if "gpl" in i}
FORMS |= {s.replace("and or distribute", "and distribute"): i for s, i in FORMS.items() if i == "isc-grant"}
FORMS |= {s.replace("the copyright holder nor the names of its", who): i for s, i in FORMS.items() if i == "bsd-endorse" for who in ("the author nor the names of its", "the copyright holders nor the names of its", "the university nor the names of its")}
FORMS |= {normal(f"SPDX-License-Identifier: {name}"): f"tag:{name}" for name in TAGGED}

#: Rules in the order in which they are tried: (licence, kind, identifiers side by side).
RULES = (
    ("Apache-2.0", "notice", ("apache-the", "apache-use", "apache-copy")),
    ("Apache-2.0", "notice", ("apache-by", "apache-use", "apache-copy")),
    ("GPL-3.0-or-later", "notice", ("gpl-free", "gpl-hope", "gpl-received")),
    ("GPL-2.0-or-later", "notice", ("gpl2-free", "gpl-hope", "gpl-received")),
    ("LGPL-3.0-or-later", "notice", ("lgpl3-free", "gpl-hope", "lgpl-received")),
    ("LGPL-2.1-or-later", "notice", ("lgpl21-free", "gpl-hope", "lgpl-received")),
    ("AGPL-3.0-or-later", "notice", ("agpl3-free", "gpl-hope", "agpl-received")),
    ("BSD-3-Clause", "text", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", "text", ("bsd-redist", "bsd-source", "bsd-binary")),
    ("MIT", "text", ("mit-grant", "mit-notice", "as-is")),
    ("BSL-1.0", "text", ("bsl-grant",)),
    ("Zlib", "text", ("zlib-grant",)),
    ("ISC", "text", ("isc-grant",)),
    ("Unlicense", "text", ("unlicense-free", "unlicense-anyone")),
    ("MPL-2.0", "notice", ("mpl-by", "mpl-copy")),
    ("EPL-2.0", "notice", ("epl-made",)),
    ("MIT", "text", ("mit-grant",)),
    ("GPL-3.0-or-later", "reference", ("gpl-free",)),
    ("GPL-2.0-or-later", "reference", ("gpl2-free",)),
    ("LGPL-3.0-or-later", "reference", ("lgpl3-free",)),
    ("LGPL-2.1-or-later", "reference", ("lgpl21-free",)),
    ("AGPL-3.0-or-later", "reference", ("agpl3-free",)),
    ("GPL-3.0-only", "reference", ("gpl3-by",)),
    ("GPL-2.0-only", "reference", ("gpl2-by",)),
    ("MIT", "reference", ("mit-by",)),
    ("MIT", "reference", ("mit-licensed",)),
    ("Apache-2.0", "reference", ("apache-by",)),
    ("Apache-2.0", "reference", ("apache-the",)),
    ("Apache-2.0", "reference", ("apache-short",)),
    ("BSD-2-Clause", "reference", ("bsd-redist",)),
    ("BSD-2-Clause", "reference", ("bsd2-licensed",)),
    ("BSD-3-Clause", "reference", ("bsd3-licensed",)),
    ("BSD", "reference", ("bsd-licensed",)),
    ("ISC", "reference", ("isc-licensed",)),
    ("MPL-2.0", "reference", ("mpl-by",)),
    ("EPL-2.0", "reference", ("epl-licensed",)),
    ("BSL-1.0", "reference", ("bsl-licensed",)),
    ("Unlicense", "reference", ("unlicense-free",)),
    ("CC-BY-NC-4.0", "reference", ("ccbync-by",)),
    ("CC-BY-NC-4.0", "reference", ("ccbync-work",)),
    ("CC-BY-NC-SA-4.0", "reference", ("ccbyncsa-by",)),
    ("CC-BY-NC-SA-4.0", "reference", ("ccbyncsa-work",)),
    ("CC-BY-NC-ND-4.0", "reference", ("ccbyncnd-by",)),
    ("CC-BY-NC-ND-4.0", "reference", ("ccbyncnd-work",)),
    ("CC-BY-SA-4.0", "reference", ("ccbysa-by",)),
    ("CC-BY-SA-4.0", "reference", ("ccbysa-work",)),
    ("CC-BY-ND-4.0", "reference", ("ccbynd-by",)),
    ("CC-BY-ND-4.0", "reference", ("ccbynd-work",)),
    ("CC-BY-4.0", "reference", ("ccby-by",)),
    ("CC-BY-4.0", "reference", ("ccby-work",)),
    ("CC0-1.0", "reference", ("cc0-by",)),
    ("Proprietary", "notice", ("all-rights",)),
    *((name, "tag", (f"tag:{name}",)) for name in TAGGED),
    ("Apache-2.0", "clue", ("apache-use",)),
    ("Apache-2.0", "clue", ("apache-copy",)),
    ("MIT", "clue", ("mit-notice",)),
    ("MIT", "clue", ("as-is",)),
    ("GPL", "clue", ("gpl-hope",)),
    ("GPL", "clue", ("gpl-received",)),
    ("LGPL", "clue", ("lgpl-received",)),
    ("AGPL", "clue", ("agpl-received",)),
    ("BSD", "clue", ("bsd-source",)),
    ("BSD", "clue", ("bsd-binary",)),
    ("BSD", "clue", ("bsd-endorse",)),
    ("MPL-2.0", "clue", ("mpl-copy",)),
    ("Unlicense", "clue", ("unlicense-anyone",)),
)

#: Every known sentence holds one of these, unchanged by normalisation, so a text without them has none.
ANCHOR = "licen|permission|redistribut|warrant|copyright|free software|gnu general|public domain|anyone is free|one at|all[^a-z0-9]+rights[^a-z0-9]+reserved"
ANCHOR = ANCHOR.replace(" ", "[^a-z0-9]+")
ANY_FORM = r"\b(?:" + "|".join(sorted(FORMS, key=lambda s: (-len(s), s))) + r")\b"


def sentence_ids(text: Column) -> Column:
    """Identifiers of a text's known sentences, in order."""
    known = F.create_map(*[F.lit(x) for pair in FORMS.items() for x in pair])
    low = F.lower(text)
    found = F.regexp_extract_all(F.regexp_replace(low, "[^a-z0-9]+", " "), F.lit(ANY_FORM), F.lit(0))
    return F.when(low.rlike(ANCHOR), F.transform(found, lambda s: F.element_at(known, s))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_known, sentence_ids, rules, licenses) of each row; lists are joined with commas."""
    x = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(F.col(text_col)).alias("ids"))
    # the sequence with each identifier between marks of its own; a rule's match becomes a bar, which keeps sides apart
    marked = lambda i: F.concat(F.lit("<"), i, F.lit(">"))
    rules = F.array(*[F.struct(F.lit(f"{name}:{kind}").alias("rule"), F.lit("".join(f"<{i}>" for i in ids)).alias("pattern")) for name, kind, ids in RULES])
    start = F.struct(F.array_join(F.transform("ids", marked), "").alias("rest"), F.array().cast("array<string>").alias("found"))
    step = lambda s, r: F.when(F.contains(s["rest"], r["pattern"]), F.struct(F.replace(s["rest"], r["pattern"], F.lit("|")).alias("rest"), F.array_append(s["found"], r["rule"]).alias("found"))).otherwise(s)
    found = F.when(F.size("ids") > 0, F.aggregate(rules, start, step)["found"]).otherwise(F.array().cast("array<string>"))
    x = x.withColumn("found", F.array_sort(F.array_distinct(found)))
    names = F.transform(F.filter("found", lambda r: ~r.endswith(":clue")), lambda r: F.substring_index(r, ":", 1))
    return x.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join("found", ",").alias("rules"), F.array_join(F.array_distinct(names), ",").alias("licenses"))


def _oracle() -> str:
    """Rules by positions: each position of a sequence keeps the number of the rule that has taken it."""
    known = ", ".join(f"'{s}': '{i}'" for s, i in FORMS.items())
    rules = ", ".join(f"({k}, '{name}', '{kind}', {list(ids)})" for k, (name, kind, ids) in enumerate(RULES, 1))
    return rf"""
WITH RECURSIVE rules(k, name, kind, want) AS (VALUES {rules}),
texts AS (SELECT row_number() OVER () AS r, doc_id, lower(text) AS low FROM documents),
seqs AS (SELECT r, list_transform(regexp_extract_all(regexp_replace(low, '[^a-z0-9]+', ' ', 'g'), '{ANY_FORM}'), lambda s: (MAP {{{known}}})[s]) AS ids
  FROM texts WHERE regexp_matches(low, '{ANCHOR}')),
steps AS (
  SELECT 0 AS k, r, ids, list_transform(ids, lambda i: 0) AS taken FROM seqs WHERE len(ids) > 0
  UNION ALL
  SELECT u.k, r, ids, list_transform(range(1, len(ids) + 1), lambda p: CASE WHEN taken[p] > 0 THEN taken[p]
      WHEN len(list_filter(range(greatest(1, p - len(want) + 1), p + 1), lambda s: ids[s:s + len(want) - 1] = want AND list_sum(taken[s:s + len(want) - 1]) = 0)) > 0 THEN u.k ELSE 0 END)
  FROM steps t JOIN rules u ON u.k = t.k + 1),
hits AS (SELECT DISTINCT r, unnest(taken) AS k FROM steps WHERE k = {len(RULES)}),
said AS (SELECT r, string_agg(DISTINCT name || ':' || kind, ',' ORDER BY name || ':' || kind) AS rules,
    string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE kind <> 'clue') AS licenses FROM hits JOIN rules USING (k) GROUP BY r)
SELECT doc_id, coalesce(len(ids), 0)::BIGINT AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
FROM texts LEFT JOIN seqs USING (r) LEFT JOIN said USING (r)
"""


ORACLE_SQL = _oracle()
