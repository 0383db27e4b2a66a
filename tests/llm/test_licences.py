import os
import sys
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.licences import _terms, document_path, oracle, scan_licences

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import rows_of_spark, rows_of_sql, same  # noqa: E402

RIGHTS = "Copyright (c) 2021, Some Person and others\nAll rights reserved.\n\n"
GNU = """This {what} is free software; you can redistribute it and/or
modify it under the terms of the GNU {kind}General Public
License as published by the Free Software Foundation; either
version {v} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.
"""
#: The licences as their publishers print them.
AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

""" + AS_IS
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
ADVERTISING = """3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement: This product includes software
   developed by the University of Nowhere and its contributors.

"""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

"""
DISCLAIMED = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
MPL_OLD = """The contents of this file are subject to the Mozilla Public License
Version 1.1 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
http://www.mozilla.org/MPL/

Software distributed under the License is distributed on an "AS IS"
basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the
License for the specific language governing rights and limitations
under the License."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:"""
NOTICES = {
    "GPL-1.0": GNU.format(what="program", kind="", v="1"), "GPL-2.0": GNU.format(what="program", kind="", v="2"), "GPL-3.0": GNU.format(what="program", kind="", v="3"),
    "LGPL-2.0": GNU.format(what="library", kind="Library ", v="2"), "LGPL-2.1": GNU.format(what="library", kind="Lesser ", v="2.1"),
    "LGPL-3.0": GNU.format(what="library", kind="Lesser ", v="3"), "AGPL-3.0": GNU.format(what="program", kind="Affero ", v="3"),
    "MIT": "MIT License\n\n" + MIT, "ISC": ISC, "BSD-2-Clause": BSD + DISCLAIMED, "BSD-3-Clause": BSD + ENDORSE + DISCLAIMED,
    "BSD-4-Clause": BSD + ADVERTISING + ENDORSE.replace("3.", "4.") + DISCLAIMED, "Apache-2.0": APACHE, "MPL-2.0": MPL, "MPL-1.1": MPL_OLD, "Zlib": ZLIB, "BSL-1.0": BOOST,
}
TITLES = {
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n", "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n", "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n", "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n",
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n",
}


def wrapped(text, width=70):
    """Lines of at most so many characters, paragraphs kept."""
    out = []
    for line in text.split("\n"):
        own = ""
        for w in line.split():
            if own and len(own) + len(w) >= width:
                out.append(own)
                own = ""
            own += (" " if own else "") + w
        out.append(own)
    return out


def dressed(text):
    lines = wrapped(RIGHTS + text)
    code = "".join(f"\nimport part{i}\n\ndef main{i}(argument{i}):\n    return part{i}.join{i}(argument{i}, 'some{i}', 'file{i}')\n" for i in range(80))
    return {
        "LICENSE": "\n".join(lines), "a.py": "\n".join("# " + x for x in lines) + "\n" + code, "b.c": "/*\n" + "\n".join(" * " + x for x in lines) + "\n */\n" + code,
        "c.c": "/* c.c\n   " + "\n   ".join(lines) + "\n*/\n" + code, "d.rs": "// " + "\n// ".join(lines) + "\n" + code,
    }


def test_stock_notices(spark):
    rows = [(f"{k}/{name}/{name}", t) for k, text in NOTICES.items() for name, t in dressed(text).items()]
    rows += [(f"{k}/title/COPYING", t + "\nPreamble\n\n" + "Some words about freedom and how to share it with others.\n\n" * 50) for k, t in TITLES.items()]
    out = scan_licences(spark.createDataFrame(rows, "doc_id string, text string").repartition(8), F.col("doc_id")).collect()
    wrong = [(r.path, r.licence, r.origin) for r in out if r.licence != r.path.split("/")[0] or r.origin != ("file" if r.path.endswith(("LICENSE", "COPYING")) else "header")]
    assert len(out) == len(rows) and not wrong


@pytest.mark.parametrize(
    ("text", "licence"),
    [
        ("// SPDX-License-Identifier: MIT\nint main;", "MIT"), ("# SPDX-License-Identifier: LGPL-2.1-or-later\nx = 1", "LGPL-2.1"), ("SPDX-License-Identifier: Other-1.0", None),
        ("Much was said of it. Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC-SA 4.0.", None), ("It is licensed under the GNU General Public License, version 4.", None),
        ("Copyright 2020 X. All rights reserved.", "proprietary"), ("All rights reserved. Released under the MIT License.", "MIT"), ("The license of the play was long.", None),
        ("Licensed under the Apache License, Version 1.1.", None), ("// SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"), ("SPDX: GPL-2.0-only WITH Classpath-exception-2.0\nx", "GPL-2.0-only WITH Classpath-exception-2.0"),
        ("This file is not released under the MIT License.", None), ("It isn't licensed under the Apache License, Version 2.0. Released under the MIT License.", "MIT"),
        ("GNU Library General Public License version 2", "LGPL-2.0"), ("This work is in CC0 1.0 Universal", "CC0-1.0"), ("zlib License", "Zlib"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("MIT OR death was the license", None),
    ],
)
def test_single_notices(spark, text, licence):
    assert [r.licence for r in scan_licences(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), F.lit("x/y")).collect()] == [licence]


def test_long_lines_of_distinct_words(spark):
    text = "license " + " ".join(f"w{i}" for i in range(1_000_000))
    began = time.time()
    out = scan_licences(spark.createDataFrame([(1, text), (2, "All rights reserved")], "doc_id bigint, text string").repartition(2), F.format_string("%d/x", "doc_id")).collect()
    assert {r.doc_id: r.licence for r in out} == {1: None, 2: "proprietary"} and time.time() - began < 60


def test_table_equals_sql(spark):
    out = scan_licences(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), document_path())
    names, got = rows_of_spark(out)
    sql_names, want = rows_of_sql(oracle(), "/root/testdata/sf0.01")
    assert names == sql_names and same(got, want)
    assert "Python" not in out._jdf.queryExecution().toString()
    assert sum(r[names.index("origin")] == "header" for r in got) > 10


def test_inheritance_and_odd_rows(spark):
    rows = [
        (1, "a/LICENSE", "MIT License text\n" + MIT + "\nmore words here and there about nothing in particular at all " * 5, "c"),
        (2, "a/b/c/x.py", "print(1)", "c"), (3, "a/b/COPYING", NOTICES["GPL-3.0"], None), (4, "d/y.py", "# Licensed under the Apache License, Version 2.0." + "\nimport os\n" * 20, "c"),
        (5, "d/z.py", "import os", "c"), (6, "a/w.py", None, "c"), (7, None, "", "c"), (None, "a/b/q", "x" * 100_000, "c"), (2, "a/b/c/x.py", "print(1)", "c"),
        (8, "deep/only.txt", "all rights RESERVED", "c"), (9, "deep/e/f/g/h", "word " * 50_000, "c"),
    ]
    files = spark.createDataFrame(rows, "doc_id bigint, p string, text string, licence string").repartition(3)
    out = {(r.doc_id, r.path): (r.licence, r.origin, r.licence_dir) for r in scan_licences(files, F.col("p")).collect()}
    assert out == {
        (1, "a/LICENSE"): ("MIT", "file", None), (2, "a/b/c/x.py"): ("GPL-3.0", "inherited", "a/b"), (3, "a/b/COPYING"): ("GPL-3.0", "file", None),
        (4, "d/y.py"): ("Apache-2.0", "header", None), (5, "d/z.py"): (None, "none", None), (6, "a/w.py"): ("MIT", "inherited", "a"),
        (7, ""): (None, "none", None), (None, "a/b/q"): ("GPL-3.0", "inherited", "a/b"), (8, "deep/only.txt"): ("proprietary", "file", None),
        (9, "deep/e/f/g/h"): ("proprietary", "inherited", "deep"),
    }
    assert scan_licences(files, F.col("p")).count() == len(rows)
    assert scan_licences(files.limit(0), F.col("p")).count() == 0


def test_terms():
    assert _terms("CC BY-NC 4.0. (the file)") == ["cc", "by-nc", "4.0", "file"]
