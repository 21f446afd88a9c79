"""Licence notices as projects write them, with results written down by hand."""

import pytest
from test_wrapped_licenses import AGPL, APACHE, BSD, LGPL, MIT

CLAUSE_3 = BSD[BSD.index("3. Neither") :]
TWO = BSD.replace(CLAUSE_3, "")


def bsd(clause, mark="3."):
    return TWO + f"{mark} {clause}\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES.\n"


CASES = [
    (bsd("Neither the name of Google LLC nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."), "BSD-3-Clause"),
    (bsd("Neither the name of Google Inc. nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."), "BSD-3-Clause"),
    (bsd("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."), "BSD-3-Clause"),
    (bsd("Neither the name of the <organization> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."), "BSD-3-Clause"),
    (bsd("The names of its contributors may not be used to endorse or promote products derived from this software without prior written permission of the authors.", "*"), "BSD-3-Clause"),
    (TWO.replace("1. ", "(a) ").replace("2. ", "(b) ") + "(c) The name of Jane Doe may not be used to endorse or promote products derived from this software without specific, written prior permission.", "BSD-3-Clause"),
    (TWO + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by Someone.\n4. Neither the name of Someone nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-4-Clause"),
    (TWO, "BSD-2-Clause"),
    (BSD, "BSD-3-Clause"),
    (LGPL, "LGPL-2.1-or-later"),
    (LGPL.replace("version 2.1", "version 3"), "LGPL-3.0-or-later"),
    (AGPL.replace("Foundation, either", "Foundation; either"), "AGPL-3.0-or-later"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", "GPL-2.0-only"),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
    ("This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details\n", "MIT"),
    ("Licensed under the Apache License 2.0 (see LICENSE).", "Apache-2.0"),
    (MIT.replace("this permission notice shall", "this permission notice (including the next paragraph) shall"), "MIT"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n", "Apache-2.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n", "GPL-3.0"),
    ("\t\t    GNU GENERAL PUBLIC LICENSE\n\t\t       Version 2, June 1991\n\n", "GPL-2.0"),
    ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n", "MPL-2.0"),
    ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to Great Tool.", "CC0-1.0"),
    ("To the extent possible under law, the author(s) have waived all copyright and related or neighboring rights to this work.", "CC0-1.0"),
    ("// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\n", "Apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note */", "GPL-2.0"),
    ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note OR MIT) */", "GPL-2.0-only MIT"),
    ("Copyright 2020 Foo Inc. All rights reserved.", "All-Rights-Reserved"),
    (APACHE, "Apache-2.0"),
    # What only looks like a grant.
    ("You may not use our name to endorse or promote products derived from milk.", ""),
    ("It is not licensed under the MIT License of old times, see there.", ""),
    ("To the extent possible under law we shall not pay.", ""),
]


def test_notices(spark):
    from millrace.llm.licenses import scan

    forms = [lambda x: x, lambda x: "".join(f"# {y}\n" for y in x.splitlines()), lambda x: x.replace("\n", "\r\n")]
    for form in forms:
        df = spark.createDataFrame([(i, form(t)) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
        got = {r.doc_id: r.licenses for r in scan(df).collect()}
        wrong = {CASES[i][0][-160:]: (got[i], want) for i, (_, want) in enumerate(CASES) if got[i] != want}
        assert not wrong


def test_notices_equal_sql(spark):
    import duckdb
    from millrace.llm.licenses import scan, sql

    texts = [t for t, _ in CASES] + ["".join(f" * {y}\n" for y in t.splitlines()) for t, _ in CASES] + ["a " * 300 + "endorse or promote products derived from x.", "word\n" * 200 + "endorse or promote products derived from this\n" + "word\n" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = scan(df).toPandas()
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    con.register("got", got)
    con.sql(f"CREATE TABLE want AS {sql()}")
    assert con.sql("SELECT * FROM want EXCEPT ALL SELECT * FROM got").fetchall() == []
    assert con.sql("SELECT * FROM got EXCEPT ALL SELECT * FROM want").fetchall() == []


