"""Licence notices as their licences give them, bare, in comments of several kinds, and wrapped elsewhere."""

import textwrap

import pytest

from tidemark.llm import licenses

MIT = """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS."""

BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_END = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES)."""

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

HOPE = """

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

"""
GPL, LGPL, AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"


def gnu(name, what, colon, either, end):
    terms = f"This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{either}, or (at your option) any later version."
    return terms + HOPE.format(what=what, name=name) + f"You should have received a copy of the {name} along with this {what}{end}"


SEE = ". If not, see <https://www.gnu.org/licenses/>."
WRITE = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."

NOTICES = {
    "mit": (MIT, "MIT"), "isc": (ISC, "ISC"), "bsd2": (BSD2 + BSD_END, "BSD-2-Clause"), "bsd3": (BSD3 + BSD_END, "BSD-3-Clause"), "apache": (APACHE, "Apache-2.0"), "mpl": (MPL, "MPL-2.0"),
    "gpl3": (gnu(GPL, "program", ":", ", either version 3 of the License", SEE), "GPL-3.0-or-later"), "gpl2": (gnu(GPL, "program", ";", "; either version 2 of the License", WRITE), "GPL-2.0-or-later"),
    "lgpl3": (gnu(LGPL, "library", ":", ", either version 3 of the License", SEE), "LGPL-3.0-or-later"), "lgpl21": (gnu(LGPL, "library", ";", "; either version 2.1 of the License", WRITE), "LGPL-2.1-or-later"),
    "agpl": (gnu(AGPL, "program", ":", ", either version 3 of the License", SEE), "AGPL-3.0-or-later"),
    "gpl2 only": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "GPL-2.0-only"),
    "gpl3 only": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.", "GPL-3.0-only"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Unlicense"),
}


def wrapped(text, width, mark):
    return "\n".join(mark + line for p in text.split("\n\n") for line in [*textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False), ""])


@pytest.mark.parametrize("name", NOTICES)
def test_notices(spark, name):
    text, license_ = NOTICES[name]
    rows = [("bare", text), ("prose around", f"Some prose before.\n{text}\nSome prose after it, and more"), ("crlf", text.replace("\n", "\r\n"))]
    rows += [(f"{mark!r} {width}", wrapped(text, width, mark)) for mark in ("", "# ", " * ", "// ", "-- ", ";; ") for width in (40, 72)]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        assert (r.doc_id, r.licenses) == (r.doc_id, license_), r.sentence_ids
        assert r.unmatched in ("", "copyright")


def test_spdx_lines(spark):
    lines = {
        "// SPDX-License-Identifier: MIT": ("MIT", ""), "/* SPDX-License-Identifier: GPL-2.0-only */": ("GPL-2.0-only", ""), "# SPDX-License-Identifier:  Apache-2.0\nimport x": ("Apache-2.0", ""), "# SPDX-License-Identifier: GPL-2.0+": ("GPL-2.0-or-later", ""),
        "# SPDX-License-Identifier: LGPL-2.1": ("LGPL-2.1-only", ""), "# SPDX-License-Identifier: MIT OR Apache-2.0": ("", "spdx"), "# SPDX-License-Identifier: LicenseRef-Own": ("", "spdx"),
    }
    got = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.scan(spark.createDataFrame([(x, x) for x in lines], "doc_id string, text string")).collect()}
    assert got == lines


def test_every_rule_has_its_licence(spark):
    """Each rule's sentences, in order, give its licence; every sentence but a few is in a rule."""
    first = lambda s: " ".join(w.split("|")[0] for w in s.split()).replace("#", "2020 holder").replace("*", "some words")
    rows = [(f"{k} {name}", ".\n".join(first(licenses.SENTENCES[i]) for i in ids)) for k, (name, ids) in enumerate(licenses.RULES)]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        assert (r.licenses, r.unmatched) == (r.doc_id.split()[1], "")
    used = {i for _, ids in licenses.RULES for i in ids}
    assert used <= set(licenses.SENTENCES) and set(licenses.SENTENCES) - used == {"copyright", "rights", "spdx"}
