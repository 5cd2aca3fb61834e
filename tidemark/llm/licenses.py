"""Licence scans by sentence rules, with SQL functions only.

Texts are normalised: letters a to z in lower case and digits stay, the end of a sentence
becomes ` | `, a line break ` / `, all else a space. Sentences end at one of `.!?;:` before white space, so
that the colon of a URL and the dot of a version stay inside. Known licence sentences, which may be
wrapped over lines but begin and end where a sentence or line does, become identifiers in
the order of the text. Ordered rules then turn runs of identifiers into licences: long
rules first, and an identifier that a rule has used is gone. Identifiers that no rule
takes are reported as they are.

The sentences are those of the notices that the licences themselves give for the head of a
file (GPL, LGPL and AGPL: "How to Apply These Terms"; Apache-2.0: its appendix; MPL-2.0: Exhibit A), of the
texts of MIT, ISC and BSD as the SPDX license list has them, of short references, and
`SPDX-License-Identifier:` lines with one identifier.

Defined results: a null or empty text has no sentences; a null doc_id stays null; repeated
rows give repeated results; where several sentences fit at one place the longest is taken; an
empty table gives no rows; other columns are ignored. Very long texts are scanned as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences in normal form; `#` is a year or years and a holder in one line, `*` any words, `a|b` either word.
SENTENCES = {
    "copyright": "copyright #",
    "rights": "all rights reserved",
    "mit-ref": "released|licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind *",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability *",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software *",
    "isc-liable": "in no event shall the author be liable for any special direct indirect or consequential damages *",
    "apache-ref": "licensed under the apache license version 2 0",
    "apache-head": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http|https www apache org licenses license 2 0",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl2-ref": "this work is licensed under the gnu general public license version 2",
    "free": "this program|library|file|software is free software",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl3-only-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl2-only-terms": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl3-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl3-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "either-3": "either version 3 of the license or at your option any later version",
    "either-2.1": "either version 2 1 of the license or at your option any later version",
    "either-2": "either version 2 of the license or at your option any later version",
    "hope": "this program|library|file|software is distributed in the hope that it will be useful but without any warranty",
    "even": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl-see": "see the gnu affero general public license for more details",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program|library|file|software",
    "lgpl-received": "you should have received a copy of the gnu lesser general public license along with this program|library|file|software",
    "agpl-received": "you should have received a copy of the gnu affero general public license along with this program|library|file|software",
    "if-not": "if not see http|https www gnu org licenses",
    "if-not-write": "if not write to the free software foundation inc *",
    "lgpl-ref": "licensed under the gnu lesser general public license version 3",
    "agpl-ref": "licensed under the gnu affero general public license version 3",
    "mpl-ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http|https mozilla org mpl 2 0",
    "bsd-head": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties *",
    "bsd-liable": "in no event shall the copyright holder|owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages *",
    "bsd3-ref": "licensed under the bsd 3 clause license",
    "bsd2-ref": "licensed under the bsd 2 clause license",
    "cc-by-nc-ref": "licensed under cc by nc 4 0",
    "cc-by-sa-ref": "licensed under cc by sa 4 0",
    "cc-by-ref": "licensed under cc by 4 0",
    "cc0-ref": "licensed under cc0 1 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "spdx": "spdx license identifier *",
}

_HOPE = ("hope", "even")

# Licences and the sentences that make them, in order; earlier rules win.
RULES = (
    ("BSD-3-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-liable")),
    ("BSD-3-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liable")),
    ("BSD-2-Clause", ("bsd-head", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "as-is", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant", "isc-as-is", "isc-liable")),
    ("ISC", ("isc-grant", "as-is")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-head", "apache-comply", "apache-copy", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-head", "apache-comply", "apache-copy", "apache-unless")),
    ("Apache-2.0", ("apache-head",)),
    ("Apache-2.0", ("apache-ref",)),
    *((name, ("free", *terms, *more)) for name, terms, kind in (
        ("GPL-3.0-or-later", ("gpl3-terms",), "gpl"), ("GPL-3.0-or-later", ("gpl-terms", "either-3"), "gpl"), ("GPL-2.0-or-later", ("gpl-terms", "either-2"), "gpl"),
        ("GPL-3.0-only", ("gpl3-only-terms",), "gpl"), ("GPL-2.0-only", ("gpl2-only-terms",), "gpl"),
        ("LGPL-3.0-or-later", ("lgpl3-terms",), "lgpl"), ("LGPL-3.0-or-later", ("lgpl-terms", "either-3"), "lgpl"), ("LGPL-2.1-or-later", ("lgpl-terms", "either-2.1"), "lgpl"),
        ("AGPL-3.0-or-later", ("agpl3-terms",), "agpl"),
    ) for more in (
        *((*_HOPE, f"{kind}-see", f"{kind}-received", end) for end in ("if-not", "if-not-write")),
        (*_HOPE, f"{kind}-see", f"{kind}-received"), (*_HOPE, f"{kind}-see"), _HOPE, (),
    )),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("LGPL-3.0-only", ("lgpl-ref",)),
    ("AGPL-3.0-only", ("agpl-ref",)),
    ("MPL-2.0", ("mpl-ref", "mpl-copy")),
    ("MPL-2.0", ("mpl-ref",)),
    ("MIT", ("mit-ref",)),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("Unlicense", ("unlicense",)),
)

# Identifiers that were in use before those with -only and -or-later.
OLD_SPDX = {"GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later", "GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1+": "LGPL-2.1-or-later", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}


def _spdx(names: set[str]) -> dict[str, tuple[str, str]]:
    """A sentence for each SPDX identifier: its id, normal form and licence; `+` is written out as in normalised()."""
    known = {n: n for n in names} | OLD_SPDX
    return {f"spdx-{n.lower()}": ("spdx license identifier " + n.lower().replace("+", " plus").replace("-", " ").replace(".", " "), name) for n, name in sorted(known.items())}


_BY_SPDX = _spdx({name for name, _ in RULES} | {"LGPL-2.1-only", "0BSD", "BSL-1.0", "Zlib", "EPL-2.0"})
SENTENCES |= {i: sentence for i, (sentence, _) in _BY_SPDX.items()}
RULES += tuple((name, (i,)) for i, (_, name) in _BY_SPDX.items())

#: Every known sentence has one of these in it; texts without any need no normalising.
KEYWORDS = ("licen", "copyright", "permission", "rights", "warrant", "redistribut", "endorse", "software", "liable", "mozilla")

#: What would be taken for a boundary becomes a sign like any other; a plus after a letter or digit counts as a word.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ|/", "abcdefghijklmnopqrstuvwxyz__"
#: The colon of an SPDX line, the dot of `v. 2.0` and signs that begin a line, as comments do, end no sentence.
STEPS = (
    (r"[\r\n]+[ \t.!?;:]+", "\n"), (r"spdx-license-identifier[ \t]*:", " spdx-license-identifier "), (r"([^a-z0-9])v\.[ \t\r\n]+", " v "), (r"\.0\+", ".0 plus "), (r"\.1\+", ".1 plus "),
    (r"[.!?;:]+([ \t\r\n]|$)", " | "), (r"[\r\n]+", " / "), (r"[^a-z0-9|/]+", " "), (r"[|/ ]*\|[|/ ]*", " | "), (r" /( /)* ", " / "),
)
DOUBLED = ((" | ", " | | "), (" / ", " / / "))


def pattern(sentence: str) -> str:
    """A normal-form sentence as a regular expression; a line may break between words."""
    gap = "(?: / /)? "
    parts = {"#": "(?:c )?[0-9]{4}(?: [a-z0-9]+)*", "*": f"[a-z0-9]+(?:{gap}[a-z0-9]+)*?"}
    return gap.join(parts.get(w, f"(?:{w})" if "|" in w else w) for w in sentence.split())


ALL = r"[|/] (" + "|".join(f"(?:{pattern(s)})" for s in sorted(SENTENCES.values(), key=lambda s: (-len(s), s))) + r") [|/]"


def normalised(text: Column) -> Column:
    """With every boundary written twice, so that neighbouring sentences have one each."""
    out = F.concat(F.lit("\n"), F.translate(text, UPPER, LOWER), F.lit("\n"))
    # No | or / is left after translate; line breaks put on make boundaries of the ends.
    for find, put in STEPS:
        out = F.regexp_replace(out, find, put)
    for find, put in DOUBLED:
        out = F.replace(out, F.lit(find), F.lit(put))
    return out


def identifier(sentence: Column) -> Column:
    return reduce(lambda case, x: case.when(sentence.rlike(f"^(?:{pattern(x[1])})$"), x[0]), sorted(SENTENCES.items(), key=lambda x: (-len(x[1]), x[0])), F.when(F.lit(False), ""))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, sentence_ids (in order), licenses (in order), unmatched (ids no rule took), each joined by commas."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lowered = F.lower(text)
    some = reduce(lambda a, b: a | b, (lowered.contains(k) for k in KEYWORDS))
    found = F.when(some, F.regexp_extract_all(normalised(text), F.lit(ALL), F.lit(1))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(*keep, F.array_join(F.transform(found, identifier), ",").alias("sentence_ids"))
    # ids as ,a,,b,,c, so that a rule takes its own commas along
    left = F.when(F.col("sentence_ids") == "", "").otherwise(F.concat(F.lit(","), F.replace(F.col("sentence_ids"), F.lit(","), F.lit(",,")), F.lit(",")))
    for name, ids in RULES:
        left = F.replace(left, F.lit("".join(f",{i}," for i in ids)), F.lit(f"<{name}>"))
    rows = rows.withColumn("left", left)
    named = F.array_join(F.regexp_extract_all("left", F.lit("<([^>]+)>"), F.lit(1)), ",")
    unmatched = F.array_join(F.regexp_extract_all("left", F.lit(",([^,<>]+),"), F.lit(1)), ",")
    return rows.select(*keep, "sentence_ids", named.alias("licenses"), unmatched.alias("unmatched"))


def oracle() -> str:
    """DuckDB SQL for scan() over documents."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    norm = f"(chr(10) || translate(coalesce(text, ''), {q(UPPER)}, {q(LOWER)}) || chr(10))"
    for find, put in STEPS:
        norm = f"regexp_replace({norm}, {q(find)}, {q(put)}, 'g')"
    for find, put in DOUBLED:
        norm = f"replace({norm}, {q(find)}, {q(put)})"
    case = "case " + " ".join(f"when regexp_full_match(s, {q(pattern(s))}) then {q(i)}" for i, s in sorted(SENTENCES.items(), key=lambda x: (-len(x[1]), x[0]))) + " end"
    left = "case when sentence_ids = '' then '' else ',' || replace(sentence_ids, ',', ',,') || ',' end"
    for name, ids in RULES:
        left = f"replace({left}, {q(''.join(f',{i},' for i in ids))}, {q(f'<{name}>')})"
    return f"""
with n as (select doc_id, {norm} as norm from documents),
f as (select doc_id, coalesce(array_to_string([{case} for s in regexp_extract_all(norm, {q(ALL)}, 1)], ','), '') as sentence_ids from n),
l as (select doc_id, sentence_ids, {left} as rest from f)
select doc_id, sentence_ids, array_to_string(regexp_extract_all(rest, '<([^>]+)>', 1), ',') as licenses,
       array_to_string(regexp_extract_all(rest, ',([^,<>]+),', 1), ',') as unmatched from l
"""
