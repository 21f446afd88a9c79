"""Licence headers as they stand in files: wrapped, and behind comment marks."""

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may
not use this file except in compliance with the License. You may obtain
a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
HEADERS = {"MIT": MIT, "BSD-3-Clause": BSD, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL, "GPL-2.0-or-later": GPL.replace("version 3", "version 2").replace("software:", "software;").replace("Foundation,", "Foundation;")}


def test_wrapped_headers(spark):
    from millrace.llm.licenses import scan

    forms = {"plain": lambda x: x, "hash": lambda x: "".join(f"# {y}\n" for y in x.splitlines()), "stars": lambda x: "/*\n" + "".join(f" * {y}\n" for y in x.splitlines()) + " */\nint main;", "dos": lambda x: x.replace("\n", "\r\n"), "one line": lambda x: " ".join(x.replace("Someone\n", "Someone.\n").split())}
    cases = [(k, name, "Prose before\n\n" + f(text)) for k, text in HEADERS.items() for name, f in forms.items()]
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.unmatched) for r in scan(df).collect()}
    assert {(k, name): got[i] for i, (k, name, _) in enumerate(cases)} == {(k, name): (k, 0) for k, name, _ in cases}


def test_words_that_go_on_are_no_sentence(spark):
    from millrace.llm.licenses import scan

    texts = ["it is not\nreleased under the MIT license text of old", "all rights\n\nreserved", "Licensed under the MIT\nLicense\nReleased under the MIT License"]
    got = [r.sentences for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["", "", "mit-under mit-under"]


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
AGPL = GPL.replace("GNU General", "GNU Affero General")


def test_more_licences(spark):
    from millrace.llm.licenses import scan

    cases = [
        (ISC, "ISC"), (MPL, "MPL-2.0"), (LGPL.replace("Foundation; either", "Foundation, either"), "LGPL-2.1-or-later"), (AGPL, "AGPL-3.0-or-later"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
        ("Licensed under the BSD 3-Clause License", "BSD-3-Clause"), ("This project is released under the terms of the GNU AGPL v3.", "AGPL-3.0"),
        ("// SPDX-License-Identifier: BSD-3-Clause\nint x;", "BSD-3-Clause"), ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"), ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */", "MIT Apache-2.0"),
        ("SPDX-License-Identifier: GPL-2.0-or-later\n", "GPL-2.0-or-later"), ("SPDX-License-Identifier: LGPL-2.1+\n", "LGPL-2.1+"), ("SPDX-License-Identifier: Made-Up-1.0\n", ""),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("released under CC0 1.0", "CC0-1.0"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in scan(df).collect()}
    assert got == {i: x for i, (_, x) in enumerate(cases)}


def test_a_rule_does_not_reach_across_a_text(spark):
    from millrace.llm.licenses import scan

    one, two = "This program is free software.", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    near, far = " Words that mean nothing." * 5, " Words that mean nothing." * 50
    got = {r.doc_id: r for r in scan(spark.createDataFrame([(0, one + near + " " + two), (1, one + far + " " + two), (2, two + far + " " + one)], "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(3)] == ["GPL-3.0-or-later"] * 3
    assert [got[i].unmatched for i in range(3)] == [0, 1, 1]


def test_scan_equals_its_sql(spark):
    import duckdb
    from millrace.llm.licenses import scan, sql

    texts = [*HEADERS.values(), ISC, MPL, LGPL, AGPL, *("".join(f"# {y}\n" for y in x.splitlines()) for x in HEADERS.values()), MIT + "\n\n" + APACHE.replace("\n", "\r\n"), "SPDX-License-Identifier: (MIT OR GPL-3.0-or-later)", None, "", "\x01All rights reserved\x01.", "A. B. " * 30 + MIT]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = scan(df).toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    con.register("got", got)
    con.sql(f"CREATE TABLE want AS {sql()}")
    assert con.sql("SELECT * FROM want EXCEPT ALL SELECT * FROM got").fetchall() == []
    assert con.sql("SELECT * FROM got EXCEPT ALL SELECT * FROM want").fetchall() == []


def test_very_long_texts(spark):
    """Hundreds of thousands of sentences and blank lines."""
    from millrace.llm.licenses import scan

    long = "A word. " * 100_000 + "Released under the MIT License. " + "\n\n. " * 100_000
    assert [r.licenses for r in scan(spark.createDataFrame([(0, long), (1, "License.\n" * 50_000)], "doc_id long, text string")).orderBy("doc_id").collect()] == ["MIT", ""]
