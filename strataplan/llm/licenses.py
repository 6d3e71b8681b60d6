"""License scans by sentence rules.

A text is cut into sentences at . ! ? before white space or the end, and a sentence into its lines.
Lines are normalised (lower case, runs of anything but a-z and 0-9 become one space, so comment marks
go). Every run of whole lines of a sentence, up to the longest known one, is looked up among the known
licence sentences: texts wrapped at any width are found, as are notices on a line of their own; a blank
line (or one of marks alone) ends a run. The identifiers, in text order, are matched against rules: a
rule is an ordered sequence of identifiers and holds where they occur in that order, others may stand
between.

Native column logic. Sentences without any of ``HINTS`` hold no known sentence (each has one) and are not
looked into; nor are lines as beginnings that start with no known sentence's first word. A look-up reads
one hash bucket of the sentence table.

Defined results: null or empty text, like any text without known sentences, has no identifiers and no
licences; repeated rows are returned each; other columns are carried, whatever their names; sentences
of several licences give all their names in alphabetical order; an empty table gives an empty result.
"""

from __future__ import annotations

import json

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SENTENCE_END = r"[.!?]+(?:[ \t\n\f\r]+|\z)"
LINE_END = r"\r\n|\n|\r"
HINTS = ["licen", "permission", "redistribut", "warrant", "copyright", "domain", "rights", "released", "distribut", "permitted"]
BUCKETS = 512

_PREFIXES = ["licensed under the {}", "licensed under {}", "released under the {}", "released under {}", "this work is licensed under the {}", "this work is licensed under {}", "this software is licensed under the {}", "distributed under the {}", "distributed under the terms of the {}", "spdx license identifier {}", "license {}"]
# names by which a one-sentence notice calls a licence, as normalised words (fixed values)
_NAMES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0", "apache 2 0 license"],
    "MIT": ["mit license", "mit", "mit licence"],
    "ISC": ["isc license", "isc"],
    "BSD-2-Clause": ["bsd 2 clause license", "bsd 2 clause", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "bsd 3 clause", "new bsd license"],
    "GPL-2.0": ["gnu general public license version 2", "gpl version 2", "gpl 2 0", "gplv2", "gpl 2 0 only", "gpl 2 0 or later"],
    "GPL-3.0": ["gnu general public license version 3", "gpl version 3", "gpl 3 0", "gplv3", "gpl 3 0 only", "gpl 3 0 or later"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mpl 2 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "epl 2 0"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "bsl 1 0"],
    "Zlib": ["zlib license", "zlib"],
}
# sentences of longer notices and of full texts (fixed values), with the rules that order them
_SENTENCES = {
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd_head": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache_head": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache_grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "apache_comply": "you may not use this file except in compliance with the license",
    "apache_obtain": "you may obtain a copy of the license at",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_free_2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl3_preamble": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl2_preamble": "the licenses for most software are designed to take away your freedom to share and change it",
    "agpl3_preamble": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "lgpl3_terms": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "lgpl_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl_hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl_form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl_obtain": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "public_domain": "this work is in the public domain",
    "all_rights": "all rights reserved",
}
_RULES = [
    ("MIT", ["mit_grant", "mit_notice"]), ("ISC", ["isc_grant"]),
    ("BSD-2-Clause", ["bsd_head", "bsd_source", "bsd_binary"]), ("BSD-3-Clause", ["bsd_head", "bsd_source", "bsd_binary", "bsd_names"]),
    ("Apache-2.0", ["notice:Apache-2.0", "apache_comply", "apache_obtain"]), ("Apache-2.0", ["apache_head"]), ("Apache-2.0", ["apache_grant"]), ("GPL-3.0", ["verbatim", "gpl3_preamble"]), ("GPL-2.0", ["verbatim", "gpl2_preamble"]),
    ("AGPL-3.0", ["verbatim", "agpl3_preamble"]), ("LGPL-3.0", ["verbatim", "lgpl3_terms"]), ("LGPL-2.1-or-later", ["lgpl_free", "lgpl_hope"]), ("AGPL-3.0-or-later", ["agpl_free", "gpl_hope"]),
    ("MPL-2.0", ["mpl_form"]), ("Zlib", ["zlib_as_is", "zlib_grant"]), ("BSL-1.0", ["boost_grant"]), ("GPL-3.0-or-later", ["gpl_free", "gpl_hope"]),
    ("GPL-2.0-or-later", ["gpl_free_2", "gpl_hope"]), ("Unlicense", ["unlicense"]), ("Public-Domain", ["public_domain"]), ("All-Rights-Reserved", ["all_rights"]),
]


def names_table() -> dict[str, list[str]]:
    """Licences and the names of their notices; the attribution licences by rule."""
    out = {k: list(v) for k, v in _NAMES.items()}
    for terms in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            words = f"{terms} {version}".lower().replace("-", " ").replace(".", " ")
            out[f"CC-{terms}-{version}"] = [f"cc {words}", f"creative commons {words}"]
    return out


def tables() -> tuple[dict[str, int], dict[str, int], list[tuple[str, list[int]]]]:
    """Sentence -> identifier; identifier names; rules as identifier sequences."""
    ids = {name: i + 1 for i, name in enumerate([*_SENTENCES, *(f"notice:{k}" for k in names_table())])}
    sentences = {text: ids[name] for name, text in _SENTENCES.items()}
    for licence, names in names_table().items():
        for name in names:
            for prefix in _PREFIXES:
                sentences.setdefault(prefix.format(name), ids[f"notice:{licence}"])
                sentences.setdefault(prefix.format(name) + " the license", ids[f"notice:{licence}"])
    rules = [(licence, [ids[p] for p in parts]) for licence, parts in _RULES]
    rules += [(licence, [ids[f"notice:{licence}"]]) for licence in names_table()]
    return sentences, ids, rules


def _table(sentences: dict[str, int]) -> Column:
    """The sentences in ``BUCKETS`` buckets by hash, as a constant."""
    out: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for text, number in sentences.items():
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        out[h % BUCKETS].append({"s": text, "i": number})
    return F.from_json(F.lit(json.dumps(out)), "array<array<struct<s:string,i:int>>>")


def _identify(sentence: Column, table: Column) -> Column:
    bucket = F.get(table, F.xxhash64(sentence).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    return F.get(F.transform(F.filter(bucket, lambda x: x["s"] == sentence), lambda x: x["i"]), F.lit(0))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_sentence_ids array<int>``, in text order, and ``_licenses array<string>``."""
    sentences, _, rules = tables()
    body, restore = common.shield(docs, ["text"])
    table, longest = _table(sentences), max(len(s.split()) for s in sentences)  # a line has a word at least
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hints = "(?i)" + "|".join(HINTS)
    lines = lambda s: F.transform(F.split(s, LINE_END, -1), lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")))
    none = F.array().cast("array<array<string>>")
    cut = F.when(text.rlike(hints), F.transform(F.filter(F.split(text, SENTENCE_END, -1), lambda s: s.rlike(hints)), lines)).otherwise(none)
    starts = "^(?:" + "|".join(sorted({s.split()[0] for s in sentences})) + r")\b"

    def runs(x: Column, at: Column) -> Column:
        """Identifiers of the runs of lines that begin at a line."""
        sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.size(x) - at))
        return F.when(F.get(x, at).rlike(starts), F.array_compact(F.transform(sizes, lambda n: _identify(F.array_join(F.slice(x, at + 1, n), " "), table)))).otherwise(F.array().cast("array<int>"))

    def in_sentence(x: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda at: runs(x, at)))

    rows = body.withColumn("_sentence_ids", F.flatten(F.transform(cut, in_sentence)))
    line = F.concat(F.lit("<"), F.array_join("_sentence_ids", "><"), F.lit(">"))
    by_licence: dict[str, Column] = {}
    for licence, parts in rules:
        hit = line.like("%" + "%".join(f"<{p}>" for p in parts) + "%")
        by_licence[licence] = by_licence[licence] | hit if licence in by_licence else hit
    found = F.array_compact(F.array(*[F.when(by_licence[k], F.lit(k)) for k in sorted(by_licence)]))
    rows = rows.withColumn("_licenses", F.when(F.size("_sentence_ids") > 0, found).otherwise(F.array().cast("array<string>")))
    return restore(rows, ["_sentence_ids", "_licenses"])


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(common.load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("_sentence_ids").cast("long").alias("n_sentences"), F.array_join(F.transform("_sentence_ids", lambda i: i.cast("string")), ",").alias("sentence_ids"), F.array_join("_licenses", ",").alias("licenses"))


def scan_sql() -> str:
    """The same by joins of rows: a row a run of lines, a row a known sentence, a row a rule."""
    sentences, _, rules = tables()
    longest = max(len(s.split()) for s in sentences)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {i})" for s, i in sorted(sentences.items()))
    rule_rows = ", ".join(f"({quoted(k)}, {quoted('%' + '%'.join(f'<{p}>' for p in parts) + '%')})" for k, parts in rules)
    cut = "string_split_regex(coalesce(text, ''), '[.!?]+([ \\t\\n\\f\\r]+|\\z)')"
    return f"""WITH known(sentence, id) AS (VALUES {known}), rules(licence, pattern) AS (VALUES {rule_rows}),
sentences AS (SELECT doc_id, unnest({cut}) AS s, generate_subscripts({cut}, 1) AS c FROM documents),
lined AS (SELECT doc_id, c, list_transform(string_split_regex(s, '\\r\\n|\\n|\\r'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) AS l FROM sentences),
starts AS (SELECT doc_id, c, l, unnest(range(1, len(l) + 1)) AS i FROM lined),
runs AS (SELECT doc_id, c, i, n, array_to_string(l[i : i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, least({longest}, len(l) - i + 1) + 1)) AS n FROM starts WHERE l[i] <> '')),
seq AS (SELECT doc_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY c, i, runs.n) AS ids, '<' || string_agg(CAST(id AS VARCHAR), '><' ORDER BY c, i, runs.n) || '>' AS line
  FROM runs JOIN known ON known.sentence = s GROUP BY doc_id),
hits AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM seq JOIN rules ON seq.line LIKE rules.pattern GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licenses
FROM documents d LEFT JOIN seq USING (doc_id) LEFT JOIN hits USING (doc_id)"""


OP3_SQL = scan_sql()
