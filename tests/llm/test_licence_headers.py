"""Every licence rule on the standard text that it is for, wrapped and as one line a paragraph."""

import re

from taskloom.llm import licences

GPL = """This program is free software{a} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{b} either version {v} of the License, or
(at your option) any later version."""
HOPE = """

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
NAMES = """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation{b} either
version {v} of the License, or (at your option) any later version."""
AGPL = GPL.replace("GNU General", "GNU Affero General").format(a=":", b=",", v=3)
V3, V2 = {"a": ":", "b": ",", "v": 3}, {"a": ";", "b": ";", "v": 2}
#: (licence, text), one for each rule, in the order of the rules.
TEXTS = [
    ("MIT", MIT), ("BSD-3-Clause", BSD + NAMES), ("BSD-2-Clause", BSD),
    ("GPL-3.0-or-later", GPL.format(**V3) + HOPE), ("GPL-3.0-or-later", GPL.format(**{**V3, "b": ";"}) + HOPE),
    ("GPL-2.0-or-later", GPL.format(**{**V2, "b": ","}) + HOPE), ("GPL-2.0-or-later", GPL.format(**V2) + HOPE),
    ("GPL-3.0-or-later", GPL.format(**V3)), ("GPL-3.0-or-later", GPL.format(**{**V3, "b": ";"})),
    ("GPL-2.0-or-later", GPL.format(**{**V2, "b": ","})), ("GPL-2.0-or-later", GPL.format(**V2)),
    ("LGPL-2.1-or-later", LGPL.format(v="2.1", b=",")), ("LGPL-2.1-or-later", LGPL.format(v="2.1", b=";")),
    ("LGPL-3.0-or-later", LGPL.format(v="3", b=",")), ("LGPL-3.0-or-later", LGPL.format(v="3", b=";")),
    ("AGPL-3.0-or-later", AGPL + HOPE), ("AGPL-3.0-or-later", AGPL),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all\ncopyright and related or neighboring rights to this work."),
    ("ISC", ISC), ("Apache-2.0", APACHE),
    *((name, f"SPDX-License-Identifier: {name}") for name in [*licences._LATER, *(n for n, *_ in licences.NAMED)]),
    ("MIT", "Released under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License version 3."), ("GPL-2.0-only", "This work is licensed under the GNU General Public License version 2."),
    ("LGPL-3.0-only", "This library is distributed under the GNU Lesser General Public License, version 3."), ("LGPL-2.1-only", "Released under the GNU Lesser General Public License version 2.1."),
    ("AGPL-3.0-only", "This program is released under the GNU Affero General Public License version 3."), ("MPL-2.0", "Distributed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "This code is licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("ISC", "Licensed under the ISC license."),
    ("CC0-1.0", "This work is licensed under CC0 1.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("proprietary", "All rights reserved."),
]


def test_every_rule_finds_its_standard_text(spark):
    assert [n for n, _ in licences.RULES] == [n for n, _ in TEXTS]
    flat = [re.sub(r"(?<!\n)\n(?!\n) *", " ", t) for _, t in TEXTS]
    rows = [(i, f"Words before.\n\n{t}\n\nWords after.") for i, t in enumerate([t for _, t in TEXTS] + flat)]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        name, ids = licences.RULES[i % len(TEXTS)]
        assert (got[i]["licences"], got[i]["sequence"]) == ([name], ids), t


def test_known_sentences_are_whole_cuts():
    for _, sentence in licences.SENTENCES:
        assert re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", sentence)
    assert len({s for _, s in licences.SENTENCES}) == len(licences.SENTENCES)
    used = {k for _, ids in licences.RULES for k in ids}
    assert used == {k for k, _ in licences.SENTENCES}


def test_headers_with_and_without_all_rights_reserved(spark):
    head = "Copyright (c) 2020, Someone\nAll rights reserved.\n\n"
    rows = [("BSD-2-Clause", head + BSD), ("BSD-2-Clause", BSD), ("BSD-3-Clause", head + BSD + NAMES), ("MIT", "This file is licensed under the MIT License."),
            ("MIT", "// SPDX-License-Identifier: MIT\n// All rights reserved.\nint x;"), ("proprietary", head), ("", "mit\nisc\nno tag before these names"),
            ("MIT", "word " * 200_000 + "\nReleased under the MIT License.\n")]
    docs = spark.createDataFrame([(i, t, "known", 1, "s") for i, (_, t) in enumerate(rows)], "doc_id long, text string, known string, cut int, sentence string")
    got = {r["doc_id"]: ",".join(r["licences"]) for r in licences.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in rows]
