import re
import textwrap

import pytest

from headway.llm.licenses import CUE, RULES, SENTENCES, scan_licenses


def test_rules_name_known_sentences():
    assert all(s in SENTENCES for rules in RULES.values() for rule in rules for s in rule)
    assert len(set(SENTENCES.values())) == len(SENTENCES) and all(re.search(CUE.replace(r"[^\p{L}\p{N}]+", " "), s) for s in SENTENCES.values())


DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
KEEP = ["1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
STANDARD = {
    "BSD-2-Clause": ["Copyright (c) 2020, A. Body", "All rights reserved.", GRANT, *KEEP, DISCLAIMER],
    "BSD-3-Clause": ["Copyright (c) 2020, A. Body. All rights reserved.", GRANT, *KEEP, "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", DISCLAIMER],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "LGPL-3.0": ["SPDX-License-Identifier: LGPL-3.0-or-later"],
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_standard_texts(spark, mark):
    """Wrapped at 78 columns, plain and as comments: each is named, and nothing else."""
    texts = {k: "\n".join(mark + line for part in parts for line in [*textwrap.wrap(part, 78), ""]) for k, parts in STANDARD.items()}
    got = {r.doc_id: r.licenses for r in scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id string, text string").selectExpr("hash(doc_id) AS doc_id", "text")).collect()}
    ids = {r.k: r.h for r in spark.createDataFrame([(k,) for k in texts], "k string").selectExpr("k", "cast(hash(k) AS long) AS h").collect()}
    assert {k: got.get(ids[k]) for k in texts} == {k: k for k in texts}


def test_long_sentence(spark):
    """No sentence is too long, however it is padded."""
    text = "Released under the MIT license" + " " * 70_000 + "."
    assert [r.licenses for r in scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == ["MIT"]


def test_scan(spark):
    grant = SENTENCES["mit-grant"].capitalize()
    rows = [
        (1, "Foo bar.\nReleased under the MIT License.\nBaz"),
        (2, f"Code. {grant}: x\nq. {grant}.\n\nThe above copyright notice, and this permission notice shall be included in all copies or substantial portions of the Software."),
        (3, "You may obtain a copy of the License at! You may not use this file, except in compliance with the License."),
        (4, "You may not use this file except in compliance with the License. Something else. You may obtain a copy of the License at"),
        (5, "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0."),
        (6, None), (7, ""), (8, "No licence here."), (8, "No licence here."), (9, "This work is licensed under the GNU General Public License, version 3.\n" * 3000),
        (1, "Foo bar.\nReleased under the MIT License.\nBaz"), (None, "MIT License"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, licenses string")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    assert {k: v.licenses for k, v in got.items()} == {1: "MIT", 2: "MIT", 3: "", 4: "Apache-2.0", 5: "Apache-2.0,CC-BY-NC-4.0", 9: "GPL-3.0", None: ""}
    assert got[2].sentences == "mit-grant mit-notice" and got[1].first_place == 2 and got[9].n_sentences == 3000
    assert scan_licenses(df.limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2020 Somebody

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """All rights
reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. more"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See more."""


def test_wrapped_texts(spark):
    squeezed = " ".join(MIT.split("Somebody")[1].split())
    padded = MIT.replace("\n", "\n" + " " * 100)
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."
    texts = [MIT, BSD, GPL, squeezed, padded, "All rights\nreserved", mpl, "This project is\nlicensed under the MIT License", "MIT License\nCopyright 2020", " ".join(BSD.split())]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {k: v.sentences for k, v in got.items()} == {
        0: "mit-head mit-grant mit-notice as-is", 1: "all-rights bsd-grant", 2: "gpl-free gpl-hope", 3: "mit-grant mit-notice as-is",
        4: "mit-head mit-grant mit-notice as-is", 5: "all-rights", 6: "mpl-form", 7: "mit-name-3", 8: "mit-head", 9: "all-rights bsd-grant",
    }
    assert [got[k].licenses for k in range(10)] == ["MIT", "BSD", "GPL-3.0", "MIT", "MIT", "", "MPL-2.0", "MIT", "", "BSD"]


def test_slots_and_markup(spark):
    """A holder or project of any name, up to eight words; tags around a sentence; licences that are granted in one version only."""
    clause = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    bsd3 = lambda holder: "\n".join([GRANT, *KEEP, textwrap.fill("3. " + clause.format(holder), 60), DISCLAIMER])
    gpl2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License {}as published by the Free Software Foundation{}."
    texts = {
        1: (bsd3("the University"), "BSD-3-Clause"), 2: (bsd3("Foo Bar, Inc."), "BSD-3-Clause"), 3: (bsd3(" ".join("abcdefghi")), "BSD-2-Clause"),
        4: ("<div><p>Licensed under the MIT license</p></div>", "MIT"), 5: ("Released under the MIT license by Foo Inc.\nOther", "MIT"), 6: ("Our\ntool is released under the MIT license.", "MIT"),
        7: ("Distributed under the terms of the MIT License.", "MIT"), 8: (gpl2.format("version 2 ", ""), "GPL-2.0"), 9: (gpl2.format("", "; version 2 of the License"), "GPL-2.0"), 10: ("a < b licensed under the mit license > c", None),
    }
    found = scan_licenses(spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string"))
    assert {r.doc_id: r.licenses for r in found.collect()} == {k: name for k, (_, name) in texts.items() if name}
